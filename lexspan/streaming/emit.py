"""Runs told node by node: a stream of state updates becomes frames in the order of the run, and one closing frame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FRAME = "seq int, event string, body string, at timestamp"
FAILED = '{"state":"failed"}'


def node_frame(node: Column, hits: Column, searched: Column, traversed: Column, dropped: Column, edges: Column, citations: Column) -> Column:
    """The JSON body of a node's frame: only what the update holds, ids in place of texts.

    hits: array<struct<provision_id,…>>, named once each where the update gives no searched ids itself;
    citations: array<struct<provision_id,…>>, whose repeats stay.
    """
    ids = lambda items: F.transform(items, lambda x: x["provision_id"])
    return F.to_json(F.struct(
        node.alias("node"), F.coalesce(searched, F.array_distinct(ids(hits))).alias("searched_ids"), traversed.alias("traversed_ids"),
        edges.alias("edges"), ids(citations).alias("supplied_ids"), dropped.alias("dropped_ids"),
    ))


class _Told(StatefulProcessor):
    """State of one run: the step to come, the last answer, whether it is over; and updates that came before their turn."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "step int, seq int, held int, seen long, timer long, answer string, over boolean")
        self.waiting = handle.getMapState("waiting", "step int", "at long, body string, answer string, failure string, last boolean")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803  (names of the interface)
        import pandas as pd

        step, seq, held, seen, timer, answer, over = self.run.get() if self.run.exists() else (0, 0, 0, None, None, None, False)
        text = lambda v: v if isinstance(v, str) else None
        here: dict[int, tuple] = {}  # of a step that came twice the first counts
        for pdf in rows:
            if not over:
                pdf = pdf[pdf["step"] >= step]
                moments = pdf["at"].astype("int64") // (1_000_000 if pdf["at"].dt.unit == "ns" else 1_000)
                for n, at, *said, last in zip(pdf["step"].tolist(), moments.tolist(), pdf["body"], pdf["answer"], pdf["failure"], pdf["last"].tolist()):
                    here.setdefault(n, (at, *map(text, said), bool(last)))
        out = []
        while not over:
            waits = held > 0 and self.waiting.containsKey((step,))
            if waits:
                at, body, said, failure, last = self.waiting.getValue((step,))
                self.waiting.removeKey((step,))
                here.pop(step, None)
                held -= 1
            elif step in here:
                at, body, said, failure, last = here.pop(step)
            else:
                break
            answer = said if said is not None else answer
            if seen is not None and at - seen > self.patience:  # it had stopped before this came
                out.append(("error", FAILED, seen + self.patience))
                over = True
            elif failure is not None:
                out.append(("error", '{"state":"%s"}' % failure, at))
                over = True
            else:
                out.append(("node", body, at))
                step, seen = step + 1, at
                if last:
                    out.append(("answer", answer, at) if answer is not None else ("error", FAILED, at))
                    over = True
        if not over:
            for n, update in here.items():  # before their turn
                if not (held and self.waiting.containsKey((n,))):
                    self.waiting.updateValue((n,), update)
                    held += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        if over and held:
            self.waiting.clear()
            held = 0
        if not over and seen is not None:
            timer = seen + self.patience
            self.handle.registerTimer(timer)
        self.run.update((step, seq + len(out), held, seen, timer, None if over else answer, over))
        if out:
            yield self._rows(key, seq, out, pd)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        step, seq, _, seen, _, _, over = self.run.get()
        if not over:
            self.waiting.clear()
            self.run.update((step, seq + 1, 0, seen, None, None, True))
            yield self._rows(key, seq, [("error", FAILED, seen + self.patience)], pd)

    @staticmethod
    def _rows(key, seq, out, pd):
        at = pd.to_datetime([a for _, _, a in out], unit="ms")
        return pd.DataFrame({"run": [key[0]] * len(out), "seq": range(seq, seq + len(out)), "event": [e for e, _, _ in out], "body": [b for _, b, _ in out], "at": at})

    def close(self) -> None:
        pass


def frames_of(updates: DataFrame, key: str, patience_ms: int, late_ms: int) -> DataFrame:
    """key with FRAME of a stream of updates (key, step, at, body, answer, failure, last).

    Steps count from 0; one that comes before its turn waits, one that comes twice counts once.
    After the last step the answer follows, or an error if no step gave any; a failure ends the
    run with its state; and a run that is silent for longer than its patience, by the times of
    its updates, ends as failed, whether a later update shows that or the watermark does.  What
    comes after the end is left out.  Updates may be late_ms behind the newest one of the stream.
    """
    kind = dict(updates.dtypes)[key]
    rows = updates.select(F.col(key).alias("run"), "step", "at", "body", "answer", "failure", "last").withWatermark("at", f"{late_ms} milliseconds")
    told = rows.groupBy("run").transformWithStateInPandas(_Told(patience_ms), f"run {kind}, {FRAME}", "Append", "EventTime")
    return told.withColumnRenamed("run", key)


def follow_frames(frames: DataFrame, path: str) -> None:
    """Takes all that has come and appends its frames to path/frames; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/frames/batch={number}")

    spark = frames.sparkSession
    # A stream without any frame yet is an empty table too.
    spark.createDataFrame([], frames.schema).write.mode("overwrite").parquet(f"{path}/frames/batch=-1")
    writer = frames.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write)
    before = {name: spark.conf.get(name, None) for name in SESSION}
    for name, value in SESSION.items():
        spark.conf.set(name, value)
    try:
        writer.start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: State of this kind is kept in RocksDB; a source of any kind is taken in batches, the last of which has no rows but the watermark.
SESSION = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.triggerAvailableNowWrapper.enabled": "true",
}
