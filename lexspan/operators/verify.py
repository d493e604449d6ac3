"""Verification of drafted answers against the texts they cite, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


# Why a verified answer is refused, and what is then said to be missing.
TIMING = "The question asks when an obligation applies, and no statement drafted from the retrieved provisions gives a date those provisions carry."
TIMING_MISSING = "the provision of the Act carrying the date this applies from"
GROUNDING = "Every statement drafted from the retrieved provisions failed the grounding check against the text it cited."
GROUNDING_MISSING = "a provision of the Act that settles the question as described"


def verify_answer(question: Column, claims: Column, refused: Column, threshold: float = tx.GROUNDED) -> Column:
    """struct(outcome, reason, missing, consulted, kept, n_dropped) for claims: array<struct<statement, cited: array<string>>>.

    Claims with too small a share of their content words in the cited texts go.  The outcome is
    `passed` for what was refused before, `timing` where the question asks for a time and no
    kept claim gives a date that its own cited texts carry, `grounding` where no claim is left,
    else `answered`.  Only an answer has kept claims; a refused one is passed on untouched.
    What is refused here was consulted on: the different texts that any claim cites, in order.
    """
    none = F.slice(claims, 1, 0)
    cited = lambda c: F.array_join(c["cited"], " ")
    grounded = F.filter(claims, lambda c: tx.share_grounded(tx.content_words(c["statement"]), tx.content_words(cited(c))) >= threshold)
    dated = F.exists(grounded, lambda c: F.arrays_overlap(tx.dates_in(c["statement"]), F.flatten(F.transform(c["cited"], tx.dates_in))))
    late = question.rlike(tx.ASKS_WHEN) & ~dated
    outcome = F.when(refused, "passed").when(F.size(grounded) == 0, "grounding").when(late, "timing").otherwise("answered")
    kept = F.when(refused, claims).when(outcome == "answered", grounded).otherwise(none)
    by_outcome = lambda timing, grounding: F.when(outcome == "timing", timing).when(outcome == "grounding", grounding)
    read = F.array_distinct(F.flatten(F.transform(claims, lambda c: c["cited"])))
    return F.struct(
        outcome.alias("outcome"), by_outcome(TIMING, GROUNDING).alias("reason"), by_outcome(TIMING_MISSING, GROUNDING_MISSING).alias("missing"),
        F.when(outcome.isin("timing", "grounding"), read).otherwise(F.slice(read, 1, 0)).alias("consulted"),
        kept.alias("kept"), (F.size(claims) - F.size(kept)).alias("n_dropped"),
    )


def containment(statements: DataFrame, supplied: DataFrame, group: str, at: str) -> DataFrame:
    """group, at, n_words, n_contained: content words of each statement that earlier texts of its group hold.

    Both tables have (group, at, text); statements of one place count as one.  Only the first
    place of each word of a group matters, so words meet by (group, word) and no group is
    ever gathered, however large.
    """
    words = lambda rows: rows.select(group, at, F.explode(tx.content_words(F.col("text"))).alias("word"))
    first = words(supplied).groupBy(group, "word").agg(F.min(at).alias("_first"))
    claimed = words(statements).distinct().join(first, [group, "word"], "left")
    counted = claimed.groupBy(group, at).agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("_first") < F.col(at)).alias("n_contained"))
    every = statements.select(group, at).distinct().join(counted, [group, at], "left")
    return every.select(group, at, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_words", "n_contained")))
