"""Token counts through a digest cache.

A text's cache key is the SHA-256 of its normalised content (null: empty; byte-level BPE
has no other normalisation) with the digest of the tokenizer file.  Only distinct digests
that the stored table lacks are encoded, each once, and appended to it.  Digests of very
many rows are dealt with apart: one text of each is picked before anything is shuffled,
and their counts go to all tasks, so no group of copies meets in one task.

Defined cases: null or empty text: 0 tokens; null ids are kept; very long texts are encoded
whole; repeated rows come back as often as they came, and rows of one id with different
texts are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenize import byte_counts

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def extend_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the distinct contents that the cache lacks, append them, and return the cache's rows for this tokenizer."""
    return _extend(_keyed(docs, id_col, text_col), tokenizer_path, cache_path)[0]


def _extend(keyed: DataFrame, tokenizer_path: str, cache_path: str) -> tuple[DataFrame, DataFrame | None]:
    """The cache's rows, and the digests of very many rows (or None)."""
    spark = keyed.sparkSession
    version = tokenizer_version(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    k = F.coalesce("doc_id", F.lit(-1)).alias("k")
    contents = keyed.groupBy("digest").agg(F.min(k).alias("k"), F.count(F.lit(1)).alias("n"))
    contents = common.materialize(contents, "contents")
    found = contents.where(F.col("n") >= common.HOT_ROWS).orderBy(F.desc("n"), "digest").limit(common.HOT_KEYS).select("digest").collect()
    hot = spark.createDataFrame(found, "digest binary") if found else None
    missing = contents.join(stored, "digest", "left_anti").select("k", "digest")
    todo = keyed.select(k, "digest", "text")
    if hot is None:
        todo = todo.join(missing, ["k", "digest"], "left_semi").select("digest", "text")
    else:
        copies = F.broadcast(missing.join(F.broadcast(hot), "digest", "left_semi").select("digest"))
        one = todo.join(copies, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        todo = todo.join(F.broadcast(hot), "digest", "left_anti").join(missing, ["k", "digest"], "left_semi").select("digest", "text").unionByName(one)

    def encode(batches):
        common.serve("tokenize")
        counter = byte_counts(tokenizer_path)
        for pdf in batches:
            yield pdf[["digest"]].assign(version=version, n_tokens=counter.batch(pdf["text"].tolist()))

    encoded = todo.mapInPandas(encode, CACHE_SCHEMA)
    encoded.groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version), hot


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    keyed = _keyed(docs, id_col, text_col)
    cache, hot = _extend(keyed, tokenizer_path, cache_path)
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    # Appends of two runs at once may store one digest twice: one row a digest is taken.
    counts = cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    both = common.join_unique(rows, counts, "digest", hot) if hot is not None else rows.join(counts, "digest")
    return both.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir):
    """Token counts of all documents, through a cache that begins empty."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), common.scratch_path(spark, "token-cache"))
