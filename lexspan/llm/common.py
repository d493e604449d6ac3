"""Helpers shared by the operators: reading tables, shared scratch tables, null handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import scratch_path, shared_dir  # noqa: F401  (used by the operators)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: the lineage ends there, and a lost executor costs no more than its tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more: what was made of them is written itself."""
    for table in tables:
        spark, path = table.sparkSession, table._scratch_path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Rows of the driver as a local table.  They go by Arrow: a plain list goes through Python workers of its own on the executors, which stay beside those of the work."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows]) for i, c in enumerate(schema.names)}), schema)


#: Keys that join_unique sends to all tasks at most, and rows that such a key has at least.
HOT_KEYS, HOT_ROWS = 1_000, 1_000


def hot_keys(rows: DataFrame, key: str, most: int = HOT_KEYS, least: int = HOT_ROWS) -> DataFrame | None:
    """The up to `most` keys of most rows, of `least` rows or more, as a small local table; None if there are none.

    No other key has more than a `most`-th of all rows.  Rows are counted before they are shuffled.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), key).limit(most).select(key).collect()
    return small_table(rows.sparkSession, found, rows.select(key).schema) if found else None


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join of left with right, which has one row a key; no key of many left rows meets in one task.

    The right rows of hot keys (hot_keys, of left unless given) go to all tasks; the other rows are shuffled.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if hot is None:
        return left.join(right, key)
    some = F.broadcast(hot)
    far = left.join(some, key, "left_semi").join(F.broadcast(right.join(some, key, "left_semi")), key)
    near = left.join(some, key, "left_anti").join(right, key)
    return near.unionByName(far.select(*near.columns))


#: Texts that are sent to a Python worker at once; a batch of long ones stays small on both sides.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Batches of this session, as Arrow's and as read from Parquet, hold at most BATCH_ROWS rows; smaller numbers set by the user stay."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key, "0")) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


_KEPT: dict[str, list] = {}
_SERVED: list[str] = []


def keeps(operator: str, *caches) -> None:
    """Names the cached functions in which an operator keeps things between tasks."""
    _KEPT.setdefault(operator, []).extend(caches)


def serve(operator: str) -> None:
    """Called where a task begins: a worker that turns to another operator lets go of what the last one kept.

    Workers live through all stages of a job; without this each stage adds its caches, and
    freed memory that was not given back, to the executor.
    """
    if _SERVED == [operator]:
        return
    for other, caches in _KEPT.items():
        if other != operator:
            for cache in caches:
                cache.cache_clear()
    _SERVED[:] = [operator]
    release()


def release() -> None:
    """Gives memory that a task has freed back to the machine, as after training."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, rows: int = 1_000):
    """The same rows in smaller frames, for work that makes much of each row."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def whole_ids(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with key 0 in place of null, and `no_id` where it was: a nullable long would reach pandas as a rounded double."""
    return rows.withColumn("no_id", F.col(key).isNull()).withColumn(key, F.coalesce(key, F.lit(0).cast("long")))


def null_ids(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows of whole_ids with their nulls again, without `no_id`."""
    return rows.withColumn(key, F.when(~F.col("no_id"), F.col(key))).drop("no_id")


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as remainder 0 of an empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n
