"""Odd rows of every operator: empty tables, nulls, repeats, ties, very long texts and clashing columns."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexspan.llm import alignment, common, fingerprints, html_text, jaccard, language, licenses, packing, queries, sentencepiece_bpe, token_counts, toxicity, vector_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, a long, b long, token string, c long, digest binary, k long, bin long, score double, label int, rep long, u long, v long"
LONG = " ".join(f"word{i % 977} and{i % 31}," for i in range(120_000))
TEXTS = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (1, "another text of this id"), (2, None), (None, "no id here at all"), (None, None), (3, ""), (4, " \t "), (5, LONG), (6, LONG), (7, "½ ² Ⅷ ①")]

RUNS = {
    "op1": lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "op2": lambda d: language.identify(d, language.train(d)),
    "op3": lambda d: jaccard.similar_groups(d),
    "op4": lambda d: licenses.scan_licenses(d),
    "op5": lambda d: fingerprints.fingerprint_documents(d),
    "op6": lambda d: sentencepiece_bpe.encode_digests(d, public_tokenizers.path("piece_bpe_32k.model")),
    "op7": lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), common.scratch_path(d.sparkSession, "cache")),
    "op13": lambda d: alignment.align(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
    "op10": lambda d: toxicity.score_toxicity(d, toxicity.train(d, d.select("doc_id", F.col("n").alias("toxic")))),
}


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    width = len(SCHEMA.split(", "))
    return spark.createDataFrame([(i, t, "en" if n % 2 else None, "s", len(t or ""), n, n % 2, *([None] * (width - 7))) for n, (i, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, name):
    got = RUNS[name](table(spark, TEXTS)).collect()
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    if name == "op1":  # the long texts are cut
        assert {k: n[k] for k in (1, 2, 3, 4, 7)} == {1: 3, 2: 1, 3: 1, 4: 1, 7: 1} and n[5] == n[6] > 50 and n[None] == 2
        assert sum(r.length for r in got if r.doc_id == 5) == sum(r.length for r in got if r.doc_id == 6)
    else:
        assert n == {1: 3, 2: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    by = {r.doc_id: r for r in got}
    if name == "op2":
        assert by[7].lang_pred == by[2].lang_pred == "und" and by[5].lang_pred == "en"
    if name == "op3":
        assert by[6].component_id == 5 and by[2].n_shingles == 0 and by[2].component_id == 2 and by[None].component_id is None
    if name == "op5":
        assert by[5].fingerprint == by[6].fingerprint and by[6].near_next == 1.0 and by[5].n_chars == len(LONG)
    if name == "op7":
        assert by[2].n_tokens == 0 and by[5].n_tokens == by[6].n_tokens and by[5].over_limit
    if name == "op10":
        assert all(0 <= r.score <= 1 for r in got) and by[5].score == by[6].score


@pytest.mark.parametrize("name", sorted(RUNS))
def test_large_ids_beside_null_ones(spark, name):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**60) - 5]
    docs = table(spark, [(i, f"a text of some words, number {k} of them all") for k, i in enumerate(ids)]).coalesce(1)
    got = [r.doc_id for r in RUNS[name](docs).collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)


def test_large_page_ids_beside_null_ones(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    pages = spark.createDataFrame([(i, "u", f"<article><p>text {k}</p></article>") for k, i in enumerate(ids)], "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id for r in html_text.extract_text(pages, html_text.train(pages)).collect()), key=str) == sorted(ids, key=str)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name](table(spark, TEXTS).where("false")).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, label int, one int"
    page = "<body><nav><a href=/>menu</a></nav><article><h1>T</h1><p title=it's>one</p><p>two don't &amp; &#233;</p><p>three</p></article><footer>© x</footer></body>"
    rows = [(i, f"u{i}", page.replace("one", f"one {i} " + "word " * 30), None, None, None) for i in range(80)] + [(1, None, None, "x", 1, 1), (None, "u", "", None, None, None), (900, "u", "<p>" + "x <b" * 50_000, None, None, None)]
    pages = spark.createDataFrame(rows, schema)
    model = html_text.train(pages)
    got = [(r.page_id, r.url, r.text) for r in html_text.extract_text(pages, model).collect()]
    assert len(got) == 83 and (1, None, "") in got and (None, "u", "") in got
    want = "T\n\none 7 " + ("word " * 30).strip() + "\n\ntwo don't & é\n\nthree"
    assert [t for i, _, t in got if i == 7] == [want]
    assert html_text.extract_text(pages.where("false"), html_text.train(pages.where("false"))).count() == 0


def test_vectors_with_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label int, rep long, v long, cell long, n long"
    more = (None,) * 4
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 3.0], 1), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, float("inf")], 1), (8, [1.0, None], 1), (9, [1.0], 1), (10, [5.0], 1), (None, [1.0, 0.0], 1)]
    frame = spark.createDataFrame([r + more for r in rows], schema)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(frame).collect()]
    assert sorted(g for g in got if g[0]) == [
        (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False),
    ]
    assert vector_dedup.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    from oracle import compare

    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_edited_texts_are_the_contracts(spark):
    rows = [(3, "abcdefghi"), (2, "xy"), (1, "12345678901"), (None, "zz"), (2, "aa")]
    got = {(r.doc_id, r.n_chars): r.edited_sha256 for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [(3, "abcdefghi"), (2, "aa"), (2, "xy"), (1, "12345678901"), (None, "zz")]
    want = {}
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        want[i, len(t)] = hashlib.sha256((t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]).encode()).hexdigest()
    assert got == want


def test_next_texts_over_many_parts(spark, monkeypatch):
    for name, value in (("RANGES", 4), ("RANGE_ROWS", 50), ("PART_ROWS", 10)):
        monkeypatch.setattr(fingerprints, name, value)
    ids = [i * i * (1 if i % 3 else -1) for i in range(400)] + [5, 5, 5]
    rows = [(i, f"t{n}") for n, i in enumerate(ids)] + [(None, "n1"), (None, "n0")]
    got = {r.text: r.next_text for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert got == dict(zip(order, [*order[1:], order[0]]))


def test_sketches_merge_to_the_union(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(40))
    every = lambda t: fingerprints.shingle_hashes(fingerprints.word_hashes(F.lit(t)))
    sketch = lambda e: F.struct(fingerprints.retained(e).alias("kept"), fingerprints.bound(fingerprints.retained(e), F.size(e)).alias("bound"))
    both = F.array_sort(F.array_union(every(a), every(b)))
    merged = fingerprints.merge(sketch(every(a)), sketch(every(b)))
    r = spark.range(1).select(merged.alias("m"), both.alias("u"), sketch(both).alias("s"), fingerprints.containment(sketch(every(b)), sketch(both)).alias("c")).first()
    assert r.m.kept == [h for h in r.u if h <= r.m.bound] and r.c == 1.0
    assert set(h for h in r.m.kept if h <= r.s.bound) == set(h for h in r.s.kept if h <= r.m.bound)


def test_hot_contents_and_hot_classes(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common.hot_keys, "__defaults__", (common.HOT_KEYS, 5))
    rows = [(i, "the same text again and again and again") for i in range(40)] + [(100 + i, f"text number {i} of its own kind and so on") for i in range(9)] + [(7, "x"), (None, "the same text again and again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = RUNS["op7"](docs).collect()
    assert len(got) == 51 and [r.n_tokens for r in got if (r.doc_id is None or r.doc_id < 40) and r.n_bytes > 1] == [8] * 41
    assert sorted(r.component_id for r in jaccard.similar_groups(docs, 4, 85, 100).collect() if r.doc_id is not None and r.doc_id < 40) == [0] * 41


def test_many_labels_and_labels_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LABELS", 60)
    rows = [(i, f"wort{i % 70} und text{i % 70} aus {i % 70}", f"l{i % 70:02d}", "s", 0) for i in range(700)] + [(9_000, "zebra zebra quagga", "zz", "s", 0)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.train(docs, 100)
    assert len(model.languages) == 60 and "zz" in model.languages and model.weights.dtype == "float32"
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert len(got) == 701 and got[9_000] == "zz"


@pytest.mark.parametrize("lengths", [
    lambda r: r.integers(1, 4_097, 16_384), lambda r: r.integers(900, 1_501, 8_000), lambda r: r.integers(1_300, 2_601, 8_000),
    lambda r: np.minimum(4_096, r.lognormal(6, 1.2, 16_000).astype(int) + 1),
])
def test_never_more_sequences_than_best_fit_by_falling_length(lengths):
    n = lengths(np.random.default_rng(7)).tolist()
    bins = packing.pack_lengths(n, 4_096)
    assert sorted(i for b in bins for i in b) == list(range(len(n))) and max(sum(n[i] for i in b) for b in bins) <= 4_096
    assert len(bins) <= len(packing.best_fit(sorted(n, reverse=True), 4_096))


def test_references_end_with_their_run():
    got = html_text.order(html_text.parse("<p>AT&<b>amp;</b> x &amp;lt; &eacute;</p><p>&l<!-- -->t; y</p>"))
    assert [x.text for x in got if x.tag == "text"] == ["AT&amp; x &lt; é", "&lt; y"]


def test_rows_of_one_id_do_not_break_the_sample(spark):
    docs = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang")).unionByName(
        spark.range(900).select("id", F.format_string("text %d", "id").alias("text"), F.lit("de").alias("lang")).withColumnRenamed("id", "doc_id"))
    n = {r.lang: r["count"] for r in language.sample_rows(docs, "lang", 500, "doc_id", "text").groupBy("lang").count().collect()}
    assert n.get("en", 0) <= 500 and 300 <= n["de"] <= 500
