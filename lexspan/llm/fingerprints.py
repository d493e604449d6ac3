"""Threshold-scaled document sketches (fractional min-hash), with DataFrame functions alone.

A sketch keeps every hash of a five-word shingle below a fixed share of the hash space, so
sketches of one threshold merge by union and containment is estimated between documents of
very unequal size.  So that short texts compare as well, the `floor` smallest hashes stay
even above the threshold (these merge too); a comparison looks only below the smaller of
the two bounds up to which both sketches are complete.

Words are runs of characters other than ASCII white space, with A-Z in lower case; a text
of fewer words is one shingle.  Defined cases: null text: as empty; an empty text has an
empty sketch, which is like another empty one (1) and unlike all else (0), and whose
containment in anything is 0; repeated rows come back as often as they came, each followed
by the next in the order of their texts; null ids come after all others; very long texts
are hashed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
SHARE = 8  # one hash in SHARE is kept
FLOOR = 24
_LOW = -(2**63)


def word_hashes(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashed: Column) -> Column:
    """The sorted distinct hashes of the shingles of word hashes."""
    n = F.size(hashed)
    at = F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1)))
    mix = lambda i: F.xxhash64(F.slice(hashed, i, WORDS))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(F.transform(at, mix))))


def retained(every: Column) -> Column:
    threshold = _LOW + 2**64 // SHARE
    return F.slice(every, 1, F.greatest(F.size(F.filter(every, lambda h: h < threshold)), F.lit(FLOOR)))


def bound(kept: Column, n_all: Column) -> Column:
    """Up to this hash a sketch is complete."""
    threshold = _LOW + 2**64 // SHARE
    top = F.greatest(F.element_at(kept, -1), F.lit(threshold))
    return F.when(F.size(kept) == n_all, F.lit(2**63 - 1)).otherwise(top)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard of two structs (kept, bound)."""
    most = F.least(a["bound"], b["bound"])
    x, y = F.filter(a["kept"], lambda h: h <= most), F.filter(b["kept"], lambda h: h <= most)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    # Nothing below the common bound: a small complete sketch against a large one.
    return F.when((F.size(a["kept"]) == 0) & (F.size(b["kept"]) == 0), 1.0).when(union == 0, 0.0).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds."""
    most = F.least(a["bound"], b["bound"])
    x = F.filter(a["kept"], lambda h: h <= most)
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, b["kept"])) / F.size(x))


def as_text(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprint(text: Column) -> Column:
    """struct(kept, bound) of a text column."""
    every = shingle_hashes(word_hashes(text))
    return F.struct(retained(every).alias("kept"), bound(retained(every), F.size(every)).alias("bound"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two shingle sets from their sketches, structs (kept, bound)."""
    most = F.least(a["bound"], b["bound"])
    return F.struct(F.array_sort(F.filter(F.array_union(a["kept"], b["kept"]), lambda h: h <= most)).alias("kept"), most.alias("bound"))


#: Ranges of ids of about equal numbers of rows, at most; each is cut evenly into as many parts as rows need.
RANGES, RANGE_ROWS, PART_ROWS = 500, 4_096, 65_536


def id_parts(docs: DataFrame) -> tuple[Column, int]:
    """The number of a row's part of the ids, rising with doc_id (null ids: -1), and the parts of a range."""
    n = docs.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    parts = max(1, n // (ranges * PART_ROWS))
    share = [i / ranges for i in range(ranges + 1)]
    edges = docs.agg(F.percentile_approx("doc_id", share, 10 * ranges).alias("e")).first()["e"]
    edges = sorted(set(edges or [0]))
    low, high = edges[:1] + edges[:-1], edges  # a range holds the ids above its low edge up to its high one

    def place(lo: int, hi: int) -> Column:  # binary search of the first high edge that is not below the id
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= edges[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    at = place(0, len(edges) - 1).cast("long")
    b = at * parts
    if parts > 1:
        edge = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int")).cast("double")
        share_of = (F.col("doc_id").cast("double") - edge(low)) / F.greatest(edge(high) - edge(low), F.lit(1.0))
        b = b + F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share_of * parts)))
    return F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(b), parts


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `next_text`, the text of the next document by descending doc_id.

    Rows of equal doc_id stand in the order of their texts; null ids come last.  Windows run
    within parts of the ids, then over the heads of a range's parts, then over the heads of
    the ranges, RANGES and one for null ids at most.
    """
    number, parts = id_parts(docs)
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), number.alias("b"))
    inner = Window.partitionBy("b").orderBy(F.desc_nulls_last("doc_id"), F.asc("text"))
    inside = cut.withColumn("next_text", F.lead("text").over(inner))
    # The head of the part below is the next text of a part's last row; of the very last one the first head of all.
    head = F.min_by("text", F.struct(-F.coalesce("doc_id", F.lit(_LOW + 1)), "text"))
    heads = cut.groupBy("b").agg(head.alias("head")).withColumn("range", F.floor(F.col("b") / parts))
    below = F.lead("head").over(Window.partitionBy("range").orderBy(F.desc("b")))
    tops = heads.groupBy("range").agg(F.max_by("head", "b").alias("top"))
    chain = Window.orderBy(F.desc("range"))
    tops = tops.select("range", F.coalesce(F.lead("top").over(chain), F.first("top").over(chain)).alias("top"))
    ends = heads.select("b", "range", below.alias("below")).join(tops, "range").select("b", F.coalesce("below", "top").alias("end"))
    return inside.join(ends, "b", "left").select("doc_id", "text", F.coalesce("next_text", "end").alias("next_text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): sketches of the text, its edited form and the next text, and likenesses."""
    base = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 3 as int))"), F.expr("left(next_text, cast(n_chars div 3 as int))"))
    rows = base.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    hashed = lambda c: word_hashes(F.col(c)).alias(f"w_{c}")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hashed("text"), hashed("edited"), hashed("next_text"))
    every = rows.select("doc_id", "n_chars", "edited_sha256", *(shingle_hashes(F.col(f"w_{c}")).alias(c) for c in ("text", "edited", "next_text")))
    kept = every.select("doc_id", "n_chars", "edited_sha256", *(F.struct(retained(F.col(c)).alias("kept"), F.size(c).alias("n")).alias(c) for c in ("text", "edited", "next_text")))
    full = kept.select("doc_id", "n_chars", "edited_sha256", *(F.struct(F.col(c)["kept"].alias("kept"), bound(F.col(c)["kept"], F.col(c)["n"]).alias("bound")).alias(c) for c in ("text", "edited", "next_text")))
    text, edit, following = F.col("text"), F.col("edited"), F.col("next_text")
    return full.select(
        "doc_id", "n_chars", "edited_sha256", as_text(text["kept"]).alias("fingerprint"), as_text(edit["kept"]).alias("edited_fingerprint"),
        likeness(text, edit).alias("near_edited"), likeness(text, following).alias("near_next"),
        containment(text, edit).alias("held_by_edited"),
    )


def op5_fingerprints(spark, sf_dir):
    """Sketches of all documents and their edited texts, with likenesses."""
    return fingerprint_documents(common.table(spark, sf_dir, "documents", "doc_id", "text"))
