"""Evaluation: arm summaries, structure checks, keyed upserts, version comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable, projected_cost


def arm_summary(results: DataFrame) -> DataFrame:
    """One row for each arm and version; failed rows count as failed and in nothing else."""
    ok = F.col("error").isNull()
    mean = lambda c, when: F.avg(F.when(when, F.col(c)))
    zero = lambda c: F.coalesce(mean(c, ok), F.lit(0.0))
    answered = ok & ~F.col("refused")
    cost = projected_cost(F.sum(F.when(ok, F.col("prompt_tokens"))), F.sum(F.when(ok, F.col("completion_tokens"))))
    return results.groupBy("arm", "version").agg(
        F.count_if(ok).alias("answered"), F.count_if(~ok).alias("failed"),
        *(F.round(zero(c), 6).alias(c) for c in ("recall", "recall_reached", "precision_over_nodes", "precision_over_articles")), F.round(zero("nodes_supplied"), 6).alias("nodes_supplied"),
        F.round(mean("faithfulness", ok), 6).alias("faithfulness"), F.round(mean("answer_recall", answered), 6).alias("answer_recall"),
        F.count_if(answered & (F.col("claims_on_gold") == 0)).alias("no_gold_answers"),
        F.count_if(ok & F.col("expects_refusal")).alias("refusal_questions"), F.count_if(ok & F.col("expects_refusal") & F.col("refused")).alias("correct_refusals"),
        F.count_if(ok & ~F.col("expects_refusal")).alias("answer_questions"), F.count_if(ok & ~F.col("expects_refusal") & F.col("refused")).alias("false_refusals"),
        F.count_if(ok & F.col("truncated")).alias("truncated"),
        F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("duration_ms"),
        F.max(F.when(ok & (F.col("call_index") == 0), F.col("duration_ms"))).alias("first_call_ms"),
        F.round(mean("duration_ms", ok & (F.col("call_index") > 0)), 6).alias("later_calls_ms"),
        F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("projected_cost"),
    )


def structure_mismatches(rows: DataFrame, kind: str, expected: DataFrame) -> DataFrame:
    """kind, expected, found where the count of a kind is not as expected (kind, expected)."""
    found = rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("found"))
    both = expected.join(found, "kind", "left").select("kind", "expected", F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("expected <> found")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose key none of them has."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def version_status(one: DataFrame, two: DataFrame, key: str, text: str) -> DataFrame:
    """key, status of every row of two versions: added, removed, changed or same."""
    a = one.select(key, comparable(F.col(text)).alias("_a"), F.lit(True).alias("_in_a"))
    b = two.select(key, comparable(F.col(text)).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return a.join(b, key, "full").select(key, status.alias("status"))
