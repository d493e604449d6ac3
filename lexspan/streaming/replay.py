"""Recorded frames played again as a stream, in the order of their schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "recorded_frames"


def record(frames: DataFrame, path: str, at_ms: Column, tick_ms: int) -> None:
    """Appends frames to the recording at a path, by the tick of their schedule; a tick is what one reading takes at least."""
    frames.withColumn("tick", F.floor(at_ms / tick_ms).cast("long")).write.mode("append").partitionBy("tick").parquet(path)


class _File(InputPartition):
    def __init__(self, tick: int, path: str):
        super().__init__(path)
        self.tick, self.path = tick, path


class _Reader(DataSourceStreamReader):
    """Offsets are ticks: a batch takes the files of the ticks from its start up to, and without, its end."""

    def __init__(self, path: str, columns: list[str], moments: set[str]):
        self.uri, self.columns, self.moments = path, columns, moments

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri) if ":/" in self.uri else (fs.LocalFileSystem(), self.uri)

    def _files(self) -> list[tuple[int, str]]:
        """(tick, path) of the files that are there, in order; those of unfinished writes are not."""
        from pyarrow import fs

        system, folder = self._folder()
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        ticks = [(f.path.split("/tick=")[1].split("/")[0], f.path) for f in found if f.is_file and "/tick=" in f.path and f.path.endswith(".parquet") and "/_" not in f.path]
        return sorted((int(t), p) for t, p in ticks)

    def initialOffset(self) -> dict:  # noqa: N802  (names of the interface)
        return {"tick": -(1 << 62)}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._files()
        return {"tick": files[-1][0] + 1} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        return [_File(t, p) for t, p in self._files() if start["tick"] <= t < end["tick"]]

    def read(self, partition: _File):
        import pyarrow as pa
        import pyarrow.parquet as pq

        with self._folder()[0].open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(columns=[c for c in self.columns if c != "tick"]):
                held = {c: pa.array([partition.tick] * batch.num_rows, pa.int64()) if c == "tick" else batch.column(c) for c in self.columns}
                yield pa.RecordBatch.from_pydict({c: x.cast(pa.timestamp("us", "UTC")) if c in self.moments else x for c, x in held.items()})

    def commit(self, end: dict) -> None:
        pass


class RecordedFrames(DataSource):
    """Streaming source `recorded_frames`: option path, a folder that all executors share; the schema is the reader's."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options["path"], schema.names, {f.name for f in schema if isinstance(f.dataType, T.TimestampType)})


def play(spark: SparkSession, path: str, schema) -> DataFrame:
    """The recording at a path as a stream of frames; a stopped query goes on at the tick where it stopped."""
    spark.dataSource.register(RecordedFrames)
    return spark.readStream.format(NAME).schema(schema).option("path", path).load()


