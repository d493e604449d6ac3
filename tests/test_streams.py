"""Runs told as frames over several batches and a restart, and recordings played again."""

import datetime as dt

from pyspark.sql import functions as F

from lexspan.sources import scratch, stores
from lexspan.streaming import emit, progress, replay

UPDATE = "run long, step int, at timestamp, body string, answer string, failure string, last boolean"
FAILED = emit.FAILED


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def tell(spark, parts, patience_s=100, late_s=10):
    """All frames after each part of the updates was recorded and the query was started again."""
    path, out = scratch.scratch_path(spark, "told"), []
    for n, rows in enumerate(parts):
        replay.record(spark.createDataFrame(rows, UPDATE), f"{path}/recording", F.lit(1_000 * n), 1_000)
        source = replay.play(spark, f"{path}/recording", spark.createDataFrame([], UPDATE).schema)
        emit.follow_frames(emit.frames_of(source, "run", patience_s * 1_000, late_s * 1_000), path)
        got = spark.read.parquet(f"{path}/frames").orderBy("run", "seq").collect()
        assert [r.seq for r in got if r.run == 1] == list(range(sum(r.run == 1 for r in got)))
        out.append([(r.run, r.event, r.body) for r in got])
    return out


def test_steps_wait_for_their_turn_over_a_restart(spark):
    one = [(1, 2, at(3), "c", None, None, False), (1, 0, at(1), "a", "early", None, False), (2, 1, at(2), "b", None, None, False)]
    two = [(1, 1, at(2), "b", None, None, False), (1, 0, at(1), "again", None, None, False), (1, 3, at(4), "d", "late", None, True), (1, 4, at(5), "e", None, None, False)]
    three = [(1, 5, at(6), "f", None, None, False), (2, 0, at(1), "a", None, "invalid", False)]
    first, second, third = tell(spark, [one, two, three])
    assert first == [(1, "node", "a")]
    assert second == [(1, "node", "a"), (1, "node", "b"), (1, "node", "c"), (1, "node", "d"), (1, "answer", "late")]
    assert third == [*second, (2, "error", '{"state":"invalid"}')]


def test_a_run_that_stops_fails_without_a_closing_update(spark):
    one = [(1, 0, at(0), "a", "x", None, False), (2, 0, at(0), "a", None, None, False), (3, 0, at(95), "a", None, None, True)]
    two = [(4, 0, at(500), "a", None, None, False)]  # lifts the watermark
    three = [(2, 1, at(501), "b", None, None, False), (4, 1, at(650), "b", None, None, True)]
    first, second, third = tell(spark, [one, two, three])
    assert first == [(1, "node", "a"), (2, "node", "a"), (3, "node", "a"), (3, "error", FAILED)]
    assert second == [(1, "node", "a"), (1, "error", FAILED), (2, "node", "a"), (2, "error", FAILED), (3, "node", "a"), (3, "error", FAILED), (4, "node", "a")]
    assert third == [*second, (4, "error", FAILED)]  # silent for 150 s before its second update


def test_frames_hold_what_their_update_holds(spark):
    none = F.lit(None).cast("array<string>")
    edges = F.lit(None).cast("array<struct<source_id:string,target_id:string,hop:int>>")
    hits = F.array(*(F.struct(F.lit(i).alias("provision_id"), F.lit("text").alias("text")) for i in ("a", "b", "a")))
    no_hits = F.lit(None).cast("array<struct<provision_id:string,text:string>>")
    frame = lambda *cols: spark.range(1).select(emit.node_frame(F.lit("n"), *cols)).first()[0]
    assert frame(no_hits, none, none, none, edges, no_hits) == '{"node":"n"}'
    assert frame(hits, none, none, F.array().cast("array<string>"), edges, hits) == '{"node":"n","searched_ids":["a","b"],"supplied_ids":["a","b","a"],"dropped_ids":[]}'
    assert frame(hits, F.array(F.lit("z")), none, none, edges, no_hits) == '{"node":"n","searched_ids":["z"]}'


def test_a_recording_is_played_once_in_ticks(spark):
    path = scratch.scratch_path(spark, "played")
    schema = "run long, seq long, node string"
    rows = lambda k: spark.createDataFrame([(r, k, f"n{k}") for r in range(3)], schema)
    fold = lambda: progress.follow(replay.play(spark, f"{path}/recording", rows(0).schema), "run", F.col("seq"), {"last": F.col("node")}, path)
    replay.record(rows(1), f"{path}/recording", F.lit(5), 10)
    replay.record(rows(2), f"{path}/recording", F.lit(15), 10)
    fold()
    assert {tuple(r) for r in progress.progress(spark, path, "run").collect()} == {(r, 2, "n2") for r in range(3)}
    replay.record(rows(3), f"{path}/recording", F.lit(25), 10)
    fold()
    assert {tuple(r) for r in progress.progress(spark, path, "run").collect()} == {(r, 3, "n3") for r in range(3)}


def test_the_first_frame_that_ends_a_stream_counts(spark):
    node, broken = 'event: node\ndata: {"node": "a"}\n\n', 'event: node\ndata: {"node": \n\n'
    answer, error = "event: answer\ndata: {}\n\n", "event: error\ndata: {}\n\n"
    rows = [(1, node + answer + broken), (2, node + broken + answer), (3, node), (4, "event: note\ndata: {}\n\n" + error), (5, error), (6, "event: node\n\n"), (7, 'event: node\ndata: {"other": 1}\n\n' + answer), (8, ""), (9, node + 'event: answer\ndata: nonsense\n\n')]
    frames = stores.read_frames(spark.createDataFrame(rows, "id long, body string"), "id", "body", "node string")
    got = {r.id: (r.state, r.nodes) for r in stores.stream_state(frames, "id").collect()}
    assert got == {1: ("answered", 1), 2: ("failed", 1), 3: ("failed", 1), 4: ("failed", 0), 5: ("error", 0), 6: ("failed", 0), 7: ("failed", 0), 9: ("failed", 1)}
