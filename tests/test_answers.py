import re

import pytest
from oracle import compare
from pyspark.sql import functions as F

from lexspan.operators import passages, verify
from lexspan.plans import answers, catalogue

SF = "/root/testdata/sf0.001"


def test_passages_nest_and_skip_mentions():
    got = passages.passages("Scope 1. One: (a) first; (b) second; and (c) third. 2. Two, see (b) above and Article 60. 3. Three (i) x.")
    assert [".".join(p[2]) for p in got] == ["1", "1.a", "1.b", "1.c", "2", "3"]
    assert passages.passages(None) == [] == passages.passages("nothing numbered")
    assert [".".join(p[2]) for p in passages.passages("3. Starts late: (a) here; (b) there.")] == ["3", "3.a", "3.b"]


def test_point_names(spark):
    words = "alpha bravo charlie delta echoes foxtrot golfing hotels"
    cases = [
        ("Article 6", f"1. None here. 2. {words}.", "Article 6(2)"),
        ("Article 6(3)", f"3. Lead: (a) other; (b) {words}.", "Article 6(3), point (b)"),
        ("Article 3", f"Terms: (1) other; (2) {words}.", "Article 3, point (2)"),
        ("Schedule III", f"1. None: (a) other; (b) {words}.", "Schedule III, point 1(b)"),
    ]
    rows = spark.createDataFrame([(c, t, n) for c, t, n in cases], "c string, t string, n string")
    got = rows.select("n", passages.closest_point(F.col("c"), F.col("t"), F.lit(words)).alias("p")).collect()
    assert all(r.p.kind == "point" and r.p.name == r.n and r.p.shared == 8 for r in got)
    kinds = spark.createDataFrame([("1. One. 2. Two.",), ("none",), (None,)], "t string").select(passages.closest_point(F.lit("Article 1"), F.col("t"), F.lit(words)).alias("p")).collect()
    assert [r.p.kind for r in kinds] == ["top", "whole", "whole"]


def test_dates_must_be_cited(spark):
    claim = F.array(F.struct(F.lit("Rules apply from May 2026").alias("statement"), F.array(F.lit("Rules apply from 2 May 2026")).alias("cited")))
    other = F.array(F.struct(F.lit("Rules apply from May 2026").alias("statement"), F.array(F.lit("Rules apply from May 2027")).alias("cited")))
    ask = F.lit("From when does it apply?")
    r = spark.range(1).select(verify.verify_answer(ask, claim, F.lit(False)).alias("a"), verify.verify_answer(ask, other, F.lit(False)).alias("b")).first()
    assert r.a.outcome == "answered" and r.b.outcome == "timing" and r.b.kept == []


def test_registered(spark):
    for name in ("verify_answers", "containment_supplied", "closest_point", "first_vs_later", "cost_projection", "progress_stream"):
        compare(spark, name, getattr(answers, name), catalogue.SQL[name], SF)


def test_small_rules_of_reports(spark):
    from lexspan.operators import reader, report

    questions = spark.createDataFrame([("q1", {"original": ["a"]})], "question string, gold map<string, array<string>>")
    asked = lambda *q: spark.createDataFrame([(x,) for x in q], "question string")
    assert report.must_know(asked("q1"), questions).count() == 1
    with pytest.raises(Exception, match="no question q9"):
        report.must_know(asked("q1", "q9"), questions).collect()
    assert [tuple(r) for r in report.gold_rows(questions).collect()] == [("q1", "original", ["a"])]
    one = spark.range(2).select(
        report.correlation_id().alias("id"), report.preview(F.array(*map(F.lit, range(12)))).alias("first"), report.preview(F.array(F.lit(1))).alias("few"),
        report.merged_tokens(F.lit(3), F.lit(None).cast("long"), F.lit(4)).alias("tokens"), report.cited_root(F.lit("Article 5(2)")).alias("root"),
        reader.file_name(F.lit("q1"), F.lit("original")).alias("file"),
    ).collect()
    assert one[0].first == list(range(8)) and one[0].few == [1] and one[0].tokens == 7 and one[0].root == "art_5" and one[0].file == "q1.original.json"
    assert re.fullmatch("[0-9a-f]{4}-[0-9a-f]{4}", one[0].id) and one[0].id != one[1].id


def test_steps_among_cited(spark):
    from lexspan.operators import reader

    rows = [(None, ["a", "b", "c"]), ("a", ["a", "b"]), ("b", ["a", "b"]), ("x", ["a", "b"]), ("a", [])]
    got = spark.createDataFrame(rows, "now string, cited array<string>").select(reader.cited_steps(F.col("now"), F.col("cited")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [("c", "a"), (None, "b"), ("a", None), ("b", "a"), (None, None)]


def test_ways_back_are_whole_and_end(spark):
    from lexspan.operators import layout

    chain = [{"source": f"n{i}", "target": f"n{i + 1}", "hop": i + 1} for i in range(40)]
    loop = [{"source": "a", "target": "b", "hop": 1}, {"source": "b", "target": "a", "hop": 2}]
    rows = [(2**60 + 1, ["n0"], [f"n{i + 1}" for i in range(40)], chain), (None, ["a", "a"], ["b"], loop), (3, None, None, None)]
    schema = "query_id long, searched array<string>, traversed array<string>, edges array<struct<source:string,target:string,hop:int>>"
    got = layout.walk_rows(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert [r.path for r in got if r.id == "n40"] == [[f"n{i}" for i in range(40, -1, -1)]] and {r.query_id for r in got} == {2**60 + 1, None}
    assert [(r.id, r.path) for r in got if r.query_id is None] == [("a", ["a", "b"]), ("b", ["b", "a"])]


def test_slices_of_runs_are_cuts():
    import random

    from lexspan.operators import compare

    r = random.Random(2)
    for _ in range(200):
        spans = [{"text": "x" * r.randrange(1, 5), "changed": bool(r.randrange(2))} for _ in range(r.randrange(8))]
        n = sum(len(s["text"]) for s in spans)
        cuts = sorted(r.randrange(n + 1) for _ in range(4))
        bounds = list(zip(cuts, cuts[1:]))
        assert compare.slice_spans(spans, bounds) == [compare.cut_spans(spans, a, b) for a, b in bounds]


def test_segments_begin_with_the_lead():
    assert [p[3] for p in passages.segments("Scope. 1. One. 2. Two.")] == ["Scope.", "1. One.", "2. Two."]
    assert passages.segments("1. One. 2. Two.")[0][2] == ["1"] and passages.segments(None) == [] and passages.segments("  plain ") == [(0, [], [], "plain")]
