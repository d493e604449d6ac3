"""What the toxicity fit, small local tables and batches of the session hold."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspan.llm import common, language, toxicity


def rows(n, words, seed=0):
    """Texts, every fourth with words of its own kind, and whether they have them; each tenth is empty."""
    rng, kinds = random.Random(seed), ["".join(p) for p in zip(*[iter("abcdefghijklmnopqrstuvwxyz" * 40)] * 5)]
    toxic = [i % 4 == 1 for i in range(n)]
    return ["" if i % 10 == 0 else " ".join([*rng.choices(kinds, k=words), *(["vilest scoundrel"] if bad else [])]) for i, bad in enumerate(toxic)], toxic


def test_fit_holds_a_run_of_tokens_at_once(monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 20_000)
    texts, toxic = rows(400, 2_000)
    tokens = sum(len(t.split()) for t in texts)
    tracemalloc.start()
    try:
        assert toxicity.fit(texts, toxic, [i % 4 == 3 or i % 8 == 1 for i in range(400)], steps=2)
        assert tracemalloc.get_traced_memory()[1] < 36 * tokens
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("part", [1, 700, 10**9])
def test_fit_is_the_same_by_parts(monkeypatch, part):
    texts, toxic = rows(120, 60, 1)
    whole = toxicity.fit(texts, toxic, steps=10)
    monkeypatch.setattr(toxicity, "PART", part)
    chain = toxicity.fit(texts, toxic, steps=10)
    assert chain.weights.keys() == whole.weights.keys() and np.allclose(chain.trans, whole.trans)
    assert np.allclose(chain.scale, whole.scale) and np.allclose([chain.weights[k] for k in whole.weights], list(whole.weights.values()), atol=2e-6)
    assert all((chain.score(toxicity._TOKEN.findall(t)) > 0.5) == (bad and t != "") for t, bad in zip(texts, toxic))


@pytest.mark.parametrize("schema, values", [("k string, n long", [("a", 1), (None, 2)]), ("k boolean, n long", [(True, 1), (False, None)]), ("k binary", [(b"x\x00",)]), ("k int, n double", []), ("k string", [(None,)])])
def test_small_tables_need_no_python_workers(spark, schema, values):
    schema = StructType.fromDDL(schema)
    table = common.small_table(spark, values, schema)
    assert table.schema == schema and [tuple(r) for r in table.collect()] == values
    assert table._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation")


def test_samples_need_no_python_workers(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 3 == 0).alias("toxic"))
    got = language.sample_rows(docs, "toxic", 20, "doc_id", "text")
    assert 0 < got.where("toxic").count() <= 20 and 0 < got.where("not toxic").count() <= 20
    assert "RDD" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_small_batches_bound_what_parquet_gives(spark):
    session, keys = spark.newSession(), ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    common.small_batches(session)
    assert [session.conf.get(k) for k in keys] == [str(common.BATCH_ROWS)] * 2
    session.conf.set(keys[1], "10")
    common.small_batches(session)
    assert session.conf.get(keys[1]) == "10"
