"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id it reaches.

    Each round hangs every node's neighbours on the smallest among them, as rows of a
    written table; nothing is gathered on the driver but one count and the most frequent
    nodes, a bounded number, a round.
    """
    edges = common.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours hang on the smallest one.
        large = common.join_unique(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the node and its smaller neighbours hang on the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = common.materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    inner = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return inner.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
