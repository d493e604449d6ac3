"""Snapshots: whole commits, broken writes, writers at the same time."""

import threading

import pytest

from lexspan.sources import scratch, snapshots, stores


def frame(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "n long")


def held(table, name="a"):
    rows = table.rows(name)
    return None if rows is None else sorted(r.n for r in rows.collect())


def test_a_write_that_breaks_off_is_not_seen(spark):
    table = snapshots.Snapshots(spark, scratch.scratch_path(spark, "table"))
    assert held(table) is None and table.latest().number == 0
    table.append(frame(spark, 1), "a", "b")
    table.stage(frame(spark, 2))  # and then the writer is lost
    with pytest.raises(Exception):
        table.update("a", lambda old: old.selectExpr("raise_error('lost') as n"))
    assert held(table) == held(table, "b") == [1] and table.latest().number == 1


def test_a_reader_keeps_its_state(spark):
    table = snapshots.Snapshots(spark, scratch.scratch_path(spark, "table"))
    before = table.append(frame(spark, 1), "a")
    rows = table.rows("a")
    table.update("a", lambda old: frame(spark, 5))
    assert [r.n for r in rows.collect()] == [1] and held(table) == [5]
    assert [r.n for r in table.rows("a", table.read(before.number)).collect()] == [1]


def test_a_stale_commit_is_refused_and_changes_are_made_again(spark):
    path = scratch.scratch_path(spark, "table")
    one, two = snapshots.Snapshots(spark, path), snapshots.Snapshots(spark, path)
    parent = one.latest()
    two.append(frame(spark, 1), "a")
    with pytest.raises(snapshots.Conflict):
        one.commit(parent, {"a": []})
    seen = []

    def slow(old):
        seen.append(sorted(r.n for r in old.collect()))
        if len(seen) == 1:
            two.append(frame(spark, 2), "a")
        return old.selectExpr("n + 10 as n")

    one.update("a", slow)
    assert seen == [[1], [1, 2]] and held(one) == [11, 12]


def test_writers_at_once_lose_no_rows(spark):
    path = scratch.scratch_path(spark, "table")
    folders = [snapshots.Snapshots(spark, path).stage(frame(spark, n)) for n in range(3)]

    def add(folder):
        table = snapshots.Snapshots(spark, path)
        for _ in range(4):
            table.change(lambda m: m.parts | {"a": [*m.parts.get("a", []), folder]})

    writers = [threading.Thread(target=add, args=(f,)) for f in folders]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    table = snapshots.Snapshots(spark, path)
    assert table.latest().number == 12 and sorted(table.latest().parts["a"]) == sorted(folders * 4)


def test_versions_are_replaced_apart(spark):
    path = scratch.scratch_path(spark, "index")
    both = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "x int, version string")
    stores.write_versions(both, path)
    stores.write_versions(both.where("version = 'b'").selectExpr("x + 10 as x", "version"), path)
    stores.write_versions(both.where("false"), path)
    assert [sorted(r.x for r in stores.read_version(spark, path, v).collect()) for v in ("a", "b")] == [[1], [12, 13]]


def test_captures_of_failures_change_nothing(spark):
    path = scratch.scratch_path(spark, "captures")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, error string")
    stores.capture(rows((1, "a", None), (2, "b", None)), path, ["k"])
    got = stores.capture(rows((1, "x", "Timeout"), (2, "y", None), (3, "z", None)), path, ["k"])
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a"), (2, "y"), (3, "z")]


def test_a_question_without_gold_is_named(spark):
    path = scratch.scratch_path(spark, "questions")
    rows = [("q1", "d", "ask", {"original": ["a"], "consolidated": ["b", "c"]}, False), ("q2", "d", "ask", {"original": ["a"]}, True)]
    stores.write_questions(spark.createDataFrame(rows, stores.QUESTION), path)
    assert stores.read_questions(spark, path, ("original",)).count() == 2
    with pytest.raises(Exception, match="question q2 has no gold for consolidated"):
        stores.read_questions(spark, path).collect()
