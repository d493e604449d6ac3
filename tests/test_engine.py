"""Stores, search, diffs, walks and arms on small cases."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import arms, compare, intervals, layout, order, reader, scoring, search, walk
from lexspan.sources import scratch, stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain_common(a, b):
    best = {}
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            best[i, j] = 0 if i == len(a) or j == len(b) else best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_common_words_take_the_same_way_in_little_memory():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        assert compare.common_words(a, b) == plain_common(a, b), (a, b)
    long = [str(i % 97) for i in range(3_000)]
    assert len(compare.common_words(long, long[500:] + long[:500])) >= 2_500


def test_spans_are_cut_joined_and_trimmed():
    spans = [{"text": "the ", "changed": False}, {"text": "old", "changed": True}, {"text": " ", "changed": False}, {"text": "rule", "changed": True}, {"text": ".  ", "changed": False}]
    assert [s["text"] for s in compare.cut_spans(spans, 2, 9)] == ["e ", "old", " ", "r"] and compare.cut_spans(spans, 99) == []
    assert [s["text"] for s in compare.join_spans(spans)] == ["the ", "old rule", ".  "]
    assert [s["text"] for s in compare.trim_spans([{"text": " \n", "changed": False}, {"text": " a", "changed": True}, *spans[-1:]])] == ["a", "."]
    assert compare.trim_spans([{"text": " ", "changed": False}]) == []


def test_nearest_by_blocks_and_by_broadcast_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    small = {(r.query_id, r.rank): r.vec_id for r in search.nearest(v, q, 5).collect()}
    for name, value in (("BROADCAST_QUERIES", 0), ("QUERY_BLOCK", 4), ("VECTOR_BLOCK", 50)):
        monkeypatch.setattr(search, name, value)
    assert small == {(r.query_id, r.rank): r.vec_id for r in search.nearest(v, q, 5).collect()} and len(small) == 75
    assert search.nearest(v.limit(0), q.limit(0), 5).count() == 0
    with pytest.raises(PySparkException, match="must hold 3 components"):
        search.check_width(v, "embedding", 3).collect()


def test_ties_of_spans(spark):
    e = spark.createDataFrame([(1, 5, "s", 1), (1, 5, "s", 2), (1, 5, "t", 3), (1, 7, "t", 4), (1, 9, "s", 5)], "k int, at long, kind string, n int")
    got = intervals.spans(e, "k", "at", F.lit(20).cast("long"), F.col("kind") == "s", F.col("kind") == "t", ["n"])
    assert {r.n: r.span_end for r in got.collect()} == {1: 5, 2: 7, 5: 20}


def test_numbers_over_ranges(spark):
    rows = spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("k"))
    assert order.numbered(rows, ["k"], "n").where("n <> k").count() == 0
    assert order.numbered(rows.limit(0), ["k"], "n").count() == 0


def test_walk_lifts_holders_after_seeds(spark):
    seeds = spark.createDataFrame([(1, "p.1", 1), (1, "x", 2), (1, "p.1", 3)], "query_id long, id string, pos int")
    parents = spark.createDataFrame([("p.1", "p"), ("x", "gone")], "id string, parent_id string")
    nodes = spark.createDataFrame([("p",), ("p.1",), ("x",), ("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("p", "a", 1), ("x", "a", 2), ("x", "b", 3), ("a", "p.1", 4)], "source_id string, target_id string, ord long")
    lifted = walk.lift(seeds, parents, nodes)
    got = [(r.id, r.hop, r.src) for r in walk.walk(seeds, edges, 2, 40, lifted).orderBy("rank").collect()]
    assert got == [("p", 0, "p.1"), ("a", 1, "x"), ("b", 1, "x")]
    assert walk.walk(seeds, edges, 2, 40, lifted, enabled=False).count() == 0


def test_scores_of_nothing(spark):
    none = F.array().cast("array<string>")
    s = one(spark, scoring.retrieval_score(F.array(F.lit("art_1")), none, none, none))
    assert (s.recall, s.precision_over_nodes, s.precision_over_articles, s.missed) == (0.0, 0.0, 0.0, ["art_1"])
    claims = F.array().cast("array<struct<statement:string,cited:array<string>>>")
    a = one(spark, scoring.answer_score(F.lit(True), F.lit(True), claims, F.array(F.lit("art_1")), none, F.lit("")))
    assert a.faithfulness is None and a.refusal_correct and a.cited_ids == []


def test_missing_partitions_and_labels_are_named(spark):
    path = scratch.scratch_path(spark, "none")
    with pytest.raises(stores.MissingPartition, match="original"):
        stores.read_version(spark, path, "original")
    stores.write_versions(spark.createDataFrame([(1, "a")], "x int, version string"), path)
    with pytest.raises(stores.MissingPartition):
        stores.read_version(spark, path, "b")
    for bad in ("", ".x", "a/b", "a b"):
        with pytest.raises(ValueError):
            stores.run_label(bad)
    assert stores.run_label("v0.6-x_y") == "v0.6-x_y"
    out = scratch.scratch_path(spark, "export")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, version string")
    assert sorted(r.rows for r in stores.export_provisions(rows, out, {"commit": "c"}).collect()) == [1, 1]
    assert [r.x for r in stores.read_export(spark, out, rows.schema, "b").collect()] == [2]


def test_generators_fail_as_rows(spark):
    def scripted(prompt):
        if prompt == "slow":
            raise TimeoutError("late")
        if prompt == "broken":
            raise KeyError("bug")
        return prompt.upper(), 2, 1

    rows = spark.createDataFrame([(1, "a"), (2, "slow")], "k long, prompt string")
    got = {r.k: r for r in arms.generate(rows, "k", scripted).collect()}
    assert got[1].text == "A" and got[2].error == "TimeoutError: late" and got[2].text is None
    with pytest.raises(PySparkException, match="bug"):
        arms.generate(spark.createDataFrame([(3, "broken")], "k long, prompt string"), "k", scripted).collect()


def test_small_rules_of_arms(spark):
    assert one(spark, arms.embedding_text(F.lit("x"), "snowflake-arctic-embed2:latest", "query")) == "query: x"
    assert one(spark, arms.embedding_text(F.lit("x"), "other", "query")) == "x"
    assert [one(spark, arms.search_k(F.lit(k).cast("int"))) for k in (0, None, 3)] == [12, 12, 3]
    assert one(spark, arms.request_is_sound(F.lit(" \n"), F.lit(1))) is False and one(spark, arms.request_is_sound(F.lit("ok"), F.lit(16_384))) is True
    assert one(spark, scoring.prompt_was_cut(F.lit(650), F.lit(99))) is True and one(spark, scoring.hit_window(F.lit("length"), F.lit(900), F.lit(40), 1_000)) is True
    part = lambda t, f: F.struct(F.lit(t).alias("text"), F.lit(f).alias("finish"), F.lit(5).alias("prompt_tokens"), F.lit(7).alias("completion_tokens"))
    assert tuple(one(spark, arms.retried(part("a", "length"), part("b", "stop"), F.lit(False)))) == ("b", "stop", 10, 14)
    assert tuple(one(spark, arms.retried(part("a", "length"), part("b", "stop"), F.lit(True)))) == ("a", "length", 5, 7)
    chunks = spark.createDataFrame([("c1", "x" * 10), ("c2", "y" * 40)], "chunk_id string, text string")
    assert arms.refuse_truncated(chunks, len, 100).count() == 2
    with pytest.raises(PySparkException, match="c2 is 40 tokens"):
        arms.refuse_truncated(chunks, len, 10).collect()
    sweep = spark.createDataFrame([("a", "v", 0), ("a", "v", 1), ("b", "v", 0)], "arm string, version string, call_index int")
    assert arms.narrowed(sweep, ["a"], None, 1).count() == 1 and arms.narrowed(sweep, first=0).count() == 3
    results = spark.createDataFrame([(1, None), (1, "x"), (2, None)], "question int, error string")
    assert tuple(arms.header(results).first()) == (2, 3, 1)
    assert [r.arm for r in arms.in_arm_order(sweep.select("arm", "version").distinct(), ["b", "a"]).orderBy("place").collect()] == ["b", "a"]
    hits = spark.createDataFrame([(1, "v", "b", 1), (1, "v", "a", 2), (1, "v", "b", 3)], "question int, version string, id string, rank int")
    found = arms.search_only(hits)
    walked = spark.createDataFrame([(1, "v", "z", 1)], "question int, version string, id string, rank int")
    assert found.first().searched == ["b", "a"] and arms.search_traversal(found, walked).first().traversed == ["z"]


def test_reading(spark):
    blocks = F.array(F.struct(F.lit("art_1.1").alias("id"), F.array(F.lit("1"), F.lit("1.a")).alias("paths")))
    assert one(spark, reader.landing(blocks, F.lit("art_1"), F.lit("1.a"))) == "art_1.1#1"
    assert one(spark, reader.landing(blocks, F.lit("art_1"), F.lit("9"))) == "art_1" and one(spark, reader.landing(blocks, F.lit(None).cast("string"), F.lit("1"))) is None
    p = spark.createDataFrame([("v", 1, "h1", "article", None), ("v", 2, "p1", "paragraph", "h1"), ("v", 3, "h2", "roman", None)], "g string, ord int, id string, kind string, parent_id string")
    ids = spark.createDataFrame([("v", "p1"), ("v", "h2"), ("v", "nope")], "g string, id string")
    assert {r.id: r.place for r in reader.section_places(ids, p, reader.sections(p, "g"), "g").collect()} == {"p1": 0, "h2": 1, "nope": 0}
    assert layout._rows(["s"], ["q", "h"], [("s", "h", 0), ("h", "t", 1)]) == [(0, "s", 0, None, "s", -1), (0, "s", 1, "s", "h", 0), (0, "s", 2, "h", "t", 1), (0, "s", 3, "s", "q", None)]
    assert one(spark, reader.matches_filter(F.lit("Article 5(1)"), F.lit("article 5"))) is True and one(spark, reader.matches_filter(F.lit("Article 53"), F.lit("5"))) is False


def test_drafts_of_any_shape(spark):
    got = one(spark, tx.parse_draft(F.lit(None).cast("string"), F.lit(2)))
    assert got.refused and got.reason == tx.FALLBACK
    got = one(spark, tx.parse_draft(F.lit("a [1]\x0bb [3] - c. [2][1][2]"), F.lit(2)))
    assert [(c.statement, c.cited) for c in got.claims] == [("a", [1]), ("c", [2, 1])] and not got.refused
