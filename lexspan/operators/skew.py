"""Joins whose left rows may crowd on a few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose right rows are sent to all tasks, at most, and left rows that such a key has at least.
HOT_KEYS, HOT_ROWS = 1_000, 1_000


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join with a right table of one row a key; left rows of hot keys are not shuffled.

    Keys other than the HOT_KEYS most frequent ones have at most a HOT_KEYS-th of the left rows.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_ROWS)
    found = counts.orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key).collect()
    if not found:
        return left.join(right, key)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, left.select(key).schema))
    far = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key)
    near = left.join(hot, key, "left_anti").join(right, key)
    return near.unionByName(far.select(*near.columns))
