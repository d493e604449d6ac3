"""The pipeline's stages on a small table, each against its rule by brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexspan.llm import common, language, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    """English and German texts, letterless ones, toxic ones, copies, near copies and repeated ids."""
    folder = common.scratch_path(spark, "corpus")
    en, de = "the and of with from that this which about where because people water house".split(), "der und die das mit von nicht auch werden haben sein kann wasser haus".split()
    rows, labels = [], []
    for i in range(240):
        words = [(en if i % 2 else de)[(i * 7 + k * (3 + i % 11)) % 14] + ("" if k % 5 else str(i)) for k in range(40)]
        toxic = i % 12 == 1
        if toxic:
            words[3:3] = ["vilest", "scoundrel"]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], None, "s", 0) for i in range(0, 40, 2)]
    rows += [(2000 + i, rows[i][1] + " end", None, "s", 0) for i in range(0, 40, 2)]
    rows += [(3000, None, None, "s", 0), (3001, "", "en", "s", 0), (3002, "12 34 ½", "en", "s", 0), (4, rows[4][1], "de", "s", 0), (None, rows[6][1] + " more words than before here", None, "s", 0)]
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(common.materialize(stage(spark, out[-1], folder), name))
    return out


def test_stages(spark, corpus):
    docs, known, clean, kept, packed = stages(spark, corpus)
    assert known.columns == clean.columns == kept.columns == pipeline.COLUMNS
    ids = lambda d: sorted((r.doc_id is None, r.doc_id) for r in d.select("doc_id").collect())
    model = language.train(docs.where(~language.held_out()))
    said = [(r.doc_id, *model.predict(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert ids(known) == sorted((i is None, i) for i, lang, p in said if lang != "und" and p >= pipeline.LEAST_LANGUAGE_SCORE)
    assert not {3000, 3001, 3002} & {i for _, i in ids(known)}
    chain = toxicity.train(known, spark.read.parquet(f"{corpus}/labels.parquet").where(~toxicity.held_out()).select("doc_id", "toxic"))
    assert ids(clean) == sorted((r.doc_id is None, r.doc_id) for r in known.collect() if chain.score(toxicity._TOKEN.findall(r.text)) < 0.5)
    left = {i for _, i in ids(clean)}
    assert not [i for i in left if i is not None and i < 240 and i % 12 == 1] and len(left) > 200
    sets = {r.doc_id: frozenset(zip(*(r.text.lower().split()[k:] for k in range(5)))) for r in clean.collect() if r.doc_id is not None}
    gone = {i for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {i for _, i in ids(kept)} - {None} == set(sets) - gone and len(ids(kept)) == len(set(ids(kept))) and gone
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {i for _, i in ids(kept)} and len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)


def test_run_gives_the_last_stage(spark, corpus):
    assert sorted((r.doc_id or -1, r.length) for r in pipeline.run(spark, corpus).collect()) == sorted((r.doc_id or -1, r.length) for r in stages(spark, corpus)[-1].collect())


def test_empty_tables(spark, corpus):
    folder = common.scratch_path(spark, "none")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    assert pipeline.run(spark, folder).count() == 0
