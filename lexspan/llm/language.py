"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed n-grams of one to three characters.  Weights are
trained with follow-the-regularised-leader (elastic-net penalties) on a bounded sample of
labelled rows, a part of which is kept aside to fit the softmax temperature.  Prediction
runs over every whole text.

Every language of the labelled rows is learned, up to the MOST_LABELS of most rows.

Defined cases: a text that is null or has no letter (a character that Unicode calls one;
digits, fractions and numerals are none) is `und` with score 0; without any labelled row
everything is `und`; rows with null lang are predicted and never learned from; very long
texts are read whole; of equally likely languages the first by name is taken; repeated
rows, null ids and other columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
BITS = 16
#: Bounds of what is learned from: rows a language, and rows in all (where there are many languages).
ROWS_A_LANGUAGE = 1_500
ROWS = 60_000
#: Labels that are learned at most: those of most rows; rows of others are predicted as any.
MOST_LABELS = 300
#: Beyond so many labels weights are held as narrow numbers while they are learned.
WIDE_LABELS = 50


def ngram_features(text: str):
    """(bucket, count) arrays of the n-grams of one to three lower-case characters."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    out = [c * np.uint64(3)]
    if len(c) > 1:
        out.append((c[:-1] << np.uint64(21)) ^ c[1:] ^ np.uint64(1 << 60))
    if len(c) > 2:
        out.append((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:])
    buckets = ((np.concatenate(out) * mix) >> shift).astype(np.int64)
    counts = np.bincount(buckets, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


class LanguageModel:
    """Weights (buckets x languages), idf, languages and temperature."""

    def __init__(self, languages, idf, weights, temperature=1.0):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def vector(self, text: str):
        import numpy as np

        at, n = ngram_features(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, text: str):
        at, x = self.vector(text)
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def fit(texts: list[str], langs: list[str], aside: list[bool], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> LanguageModel:
    """FTRL-proximal over the rows not set aside, temperature from those that are."""
    import numpy as np

    languages = sorted(set(langs))
    n, k = 1 << BITS, len(languages)
    seen = np.zeros(n)
    for t in texts:
        seen[ngram_features(t)[0]] += 1
    kind = np.float64 if k <= WIDE_LABELS else np.float32
    model = LanguageModel(languages, np.log((1 + len(texts)) / (1 + seen)) + 1, np.zeros((n + 1, k), dtype=kind))
    if not texts:
        return model
    z, q, w = np.zeros((n + 1, k), kind), np.zeros((n + 1, k), kind), model.weights
    # The last weight is the bias; narrow types, as all rows are held at once.
    rows = [(np.append(at, n).astype(np.int32), np.append(x, 1.0).astype(np.float32)) for at, x in map(model.vector, texts)]
    target = [languages.index(v) for v in langs]
    order = [i for i in range(len(rows)) if not aside[i]] or list(range(len(rows)))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(order):
            at, x = rows[i]
            s = x @ w[at]
            p = np.exp(s - s.max())
            p /= p.sum()
            p[target[i]] -= 1
            g = x[:, None] * p
            old = np.sqrt(q[at])
            q[at] += g * g
            new = np.sqrt(q[at])
            z[at] += g - (new - old) / alpha * w[at]
            zi = z[at]
            w[at] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + new) / alpha + l2))
    held = [i for i in range(len(rows)) if aside[i]]
    if held:
        scores = np.array([rows[i][1] @ w[rows[i][0]] for i in held])
        truth = np.array([target[i] for i in held])

        def loss(t):
            s = scores / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), truth]).mean())

        model.temperature = min((2 ** (e / 8) for e in range(-24, 25)), key=loss)
    return model


def sample_rows(rows: DataFrame, label: str, most: int, *keys: str) -> DataFrame:
    """At most `most` rows of each label, chosen by a hash of their keys in whole buckets of the hash.

    Labels: the MOST_LABELS of most rows.  A bucket that would exceed the bound, as one of a row
    repeated very often, is passed over; a label of no other buckets gives its first rows by keys.
    Only rows of chosen buckets are ever shuffled.
    """
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS).collect()
    spark, kind = rows.sparkSession, rows.select(label).schema
    # Buckets of about a hundredth of the bound, as many as hold it twice.
    sizes = [(r[label], max(1, min(1 << 30, 100 * r["count"] // most))) for r in counts]
    sized = common.small_table(spark, sizes, kind.add("_buckets", "long"))
    bucket = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.col("_buckets"))
    near = rows.join(F.broadcast(sized), label).withColumn("_bucket", bucket).where("_bucket < 200")
    found = near.groupBy(label, "_bucket").count().orderBy(label, "_bucket").collect()  # at most 200 a label
    held: dict = {}
    chosen = []
    for r in found:
        if held.get(r[label], 0) + r["count"] <= most:
            held[r[label]] = held.get(r[label], 0) + r["count"]
            chosen.append((r[label], r["_bucket"]))
    picked = common.small_table(spark, chosen, rows.select(label).schema.add("_bucket", "long"))
    out = near.join(F.broadcast(picked), [label, "_bucket"]).select(*rows.columns)
    for value in [r[label] for r in counts if r[label] not in held]:
        out = out.unionByName(rows.where(F.col(label) == value).orderBy(*keys).limit(most))
    return out


def train(labelled: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of labelled (doc_id, text, lang), in one task."""
    import pickle

    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    usable = usable.select("doc_id", "text", "lang")
    languages = usable.select("lang").distinct().count()
    chosen = sample_rows(usable, "lang", min(rows_a_language, max(1, ROWS // max(1, languages))), "doc_id", "text")

    def learn(pdf):
        import pandas as pd

        common.serve("language")
        pdf = pdf.sort_values(["doc_id", "text"])
        model = fit(pdf["text"].tolist(), pdf["lang"].tolist(), [zlib_crc(i) % 5 == 0 for i in pdf["doc_id"].tolist()])
        common.release()
        return pd.DataFrame({"model": [pickle.dumps((model.languages, model.idf.astype("float32"), model.weights.astype("float32"), model.temperature))]})

    got = chosen.select("doc_id", "text", "lang", F.lit(1).alias("one")).groupBy("one").applyInPandas(learn, "model binary").collect()
    return LanguageModel(*pickle.loads(got[0]["model"])) if got else LanguageModel([], None, None)


def zlib_crc(doc_id) -> int:
    import zlib

    return zlib.crc32(f"aside {doc_id}".encode())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text)."""

    def run(batches):
        common.serve("language")
        for pdf in batches:
            got = [model.predict(t) for t in pdf["text"].tolist()]
            yield pdf[["doc_id", "no_id"]].assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got])

    return common.null_ids(common.whole_ids(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, no_id boolean, lang_pred string, score double"))


def held_out():
    return common.remainder(F.col("doc_id"), 3) == 1


def op2_language_id(spark, sf_dir):
    """The language of every document, learned from those not held out."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def predictor(model: LanguageModel):
    """A column function of a text: struct(lang, score)."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        common.serve("language")
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return predict
