"""Exact search by cells, walks over edges in buckets, model calls in batches, prompts in pieces."""

import numpy as np
from pyspark.sql import functions as F

from lexspan.operators import arms, order, search, walk
from lexspan.sources import scratch


def clustered(spark, n=1_500, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 6)) * 20
    rows = [(i, (middles[i % 12] + rng.normal(size=6)).tolist()) for i in range(n)]
    rows += [(5_000 + i, rows[i][1]) for i in range(30)] + [(None, rows[0][1]), (9_000, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_pruned_search_gives_the_same_rows_with_fewer_distances(spark):
    v = clustered(spark)
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    counted = spark.sparkContext.accumulator(0)
    for k in (1, 12):
        got = [tuple(r) for r in search.nearest_pruned(v, q, k, counted=counted).orderBy("query_id", "rank").collect()]
        assert got == [tuple(r) for r in search.nearest(v, q, k).orderBy("query_id", "rank").collect()]
    assert counted.value < 2 * v.count() * q.count() / 4


def test_pruned_search_of_few_or_no_vectors(spark):
    v = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert sorted((r.query_id, r.vec_id, r.rank) for r in search.nearest_pruned(v, q, 5).collect()) == [(1, 2, 1), (2, 1, 1)]
    assert search.nearest_pruned(v.where("false"), q, 5).count() == 0 and search.nearest_pruned(v, q.where("false"), 5).count() == 0


def test_many_parts_of_a_cell(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 40)
    v = clustered(spark, 400)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = lambda d: [tuple(r) for r in d.orderBy("query_id", "rank").collect()]
    assert rows(search.nearest_pruned(v, q, 7, centres=3)) == rows(search.nearest(v, q, 7))


def test_a_hop_does_not_move_the_edges(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges, name = walk.by_bucket(spark.range(1_000).select(F.col("id").alias("src"), (F.col("id") * 7 % 1_000).alias("id"), F.col("id").alias("ord")), "src")
        plan = spark.range(50).select(F.col("id").alias("src")).join(edges, "src")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(src") == 1 and plan.count("Exchange") == 1
        spark.sql(f"DROP TABLE {name}")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_running_sums_go_over_ranges(spark):
    rows = [(g, i, (i * 7 + (g or 0)) % 5) for g in (1, 2, None) for i in range(500)]
    got = order.running(spark.createDataFrame(rows, "g long, i long, c long").repartition(5), "g", ["i"], F.col("c")).collect()
    total: dict = {}
    for r in sorted(got, key=lambda r: (str(r.g), r.i)):
        total[r.g] = total.get(r.g, 0) + r.c
        assert (r.place, r.running) == (r.i, total[r.g])
    assert len(got) == 1_500


def test_calls_are_filled_and_rows_keep_their_vectors(spark):
    seen = spark.sparkContext.accumulator(0)

    def scripted(texts):
        seen.add(1)
        return [(i, [float(t), float(len(texts))]) for i, t in reversed(list(enumerate(texts)))], len(texts)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(2**60 + i if i else None, str(i)) for i in range(50)] + [(1, None)]
        got = arms.embed(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", scripted, size=16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.id, r.vector[0]) for r in got] == [(i, float(t)) for i, t in rows[:50]] and seen.value == 4
    assert [r.call_tokens for r in got] == [16] * 48 + [2] * 2


def test_failed_calls_are_made_good_by_the_next_run(spark):
    path = scratch.scratch_path(spark, "vectors")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, text string").repartition(3)

    def broken(texts):
        return [(0, [0.0])] * (2 if "t5" in texts else 1), 1

    def working(texts):
        if "t7" in texts:
            raise AssertionError("sent again")
        return [(0, [1.0])], 1

    vectors, failures = arms.embed_missing(rows, "id", broken, path, size=1)
    assert vectors.count() == 19 and [tuple(r) for r in failures.collect()] == [(5, "ValueError: asked for 1 vectors and got 2")]
    vectors, failures = arms.embed_missing(rows, "id", working, path, size=1)
    assert {r.id: r.vector[0] for r in vectors.collect()} == {i: float(i == 5) for i in range(20)} and failures.count() == 0


def test_null_keys_of_a_generator(spark):
    got = arms.generate(spark.createDataFrame([(2**60 + 1, "a"), (None, "b")], "id long, prompt string").coalesce(1), "id", lambda p: (p, 1, 1)).collect()
    assert [(r.id, r.text) for r in got] == [(2**60 + 1, "a"), (None, "b")]


def test_a_prompt_in_pieces_is_the_whole_prompt(spark, monkeypatch):
    monkeypatch.setattr(arms, "PIECE_CHARS", 60)
    rows = [("v", i, f"art_{i:02d}", "paragraph" if i % 5 == 4 else "article", f"Article {i}", None if i == 3 else f"text of {i}") for i in range(40)] + [("w", 0, "art_0", "article", "Article 0", "x" * 900)]
    p = spark.createDataFrame(rows, "version string, ord long, id string, kind string, citation string, text string")
    asked, prompts = arms.full_context(spark.createDataFrame([(1, "v"), (2, "v"), (3, "w")], "question long, version string"), p, 300)
    told = {r.prompt_key: r.prompt for r in prompts.collect()}
    held, cost = [], 0
    for _, _, _, kind, citation, text in rows[:40]:
        if kind != "paragraph":
            cost += len(text or "") + len(citation) + 8
            held += [f"[{len(held) + 1}] {citation}\n{text or ''}"] if cost <= 300 else []
    got = {r.question: r for r in asked.collect()}
    assert told[got[1].prompt_key] == told[got[2].prompt_key] == "\n\n".join(held) and got[1].supplied == len(held) and got[1].supplied + got[1].dropped == 32
    assert told[got[3].prompt_key] == f"[1] Article 0\n{'x' * 900}" and len(told) == 2
