"""Progress of runs folded from a stream of frames, kept as a table of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(frames: DataFrame, key: str, order: Column, fields: dict[str, Column]) -> DataFrame:
    """One row a key: frames seen, and for each field the last value (by order) that is not null."""
    last = [F.max_by(c, F.when(c.isNotNull(), order)).alias(name) for name, c in fields.items()]
    return frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), *last)


def follow(frames: DataFrame, key: str, order: Column, fields: dict[str, Column], path: str) -> None:
    """Fold all frames that have come and append the keys that changed, with their batch, to path/updates.

    State is one row a key.  A batch that is run again after a lost driver overwrites its own
    folder only, so no update is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")

    query = (
        fold(frames, key, order, fields).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()


def progress(spark, path: str, key: str) -> DataFrame:
    """The newest update of each key."""
    updates = spark.read.parquet(f"{path}/updates")
    newest = Window.partitionBy(key).orderBy(F.desc("batch"))
    return updates.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")
