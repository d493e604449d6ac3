"""From raw documents to packed training sequences.

language ID -> toxicity -> n-gram Jaccard join -> best-fit packing.  Every stage works on all
that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import common, jaccard, language, packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected only if it has no letters or no language is likelier than this.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null and letterless texts and those of no recognised language; if nothing is labelled, all stay.

    Rows that repeat an id are judged each by its own text; null ids are no harm.
    """
    common.small_batches(spark)
    model = language.train(docs.where(~language.held_out()))
    if not model.languages:
        return docs.select(*COLUMNS)
    got = docs.select(*COLUMNS).withColumn("_p", language.predictor(model)("text"))
    return got.where((F.col("_p.lang") != language.UNKNOWN) & (F.col("_p.score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are rather toxic than not; without labels of both kinds all stay.

    Null and empty texts have no tokens and stay; rows that repeat an id are judged each.
    """
    common.small_batches(spark)
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    chain = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = docs.select(*COLUMNS).withColumn("_s", toxicity.scorer(chain)("text"))
    return got.where("_s < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group; one row of a repeated id; null ids stay.

    Null and empty texts are like nothing and stay.
    """
    common.small_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = common.materialize(jaccard.similar_groups(docs), "groups")
    gone = common.materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # A checked number of ids is sent to all tasks; more are joined by key.
    small = gone.count() <= jaccard.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, in pieces of at most 4,096 tokens; a null or empty text is its end id alone."""
    common.small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, random fields and packing can't be expressed in SQL; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
