"""Row numbers over a whole table, by ranges of its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with `name`, their place from 0 in the order, ties in any order.

    Rows are dealt to ranges of the order, numbered within each, and lifted by the sizes of
    the ranges before; only these sizes, one a range, meet in one task.
    """
    cut = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    inside = cut.withColumn("_place", place)
    return inside.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def running(rows: DataFrame, group: str, order: list, cost: Column) -> DataFrame:
    """rows with `place`, from 0 in the order of their group (ties in any order), and `running`, the cost of the group up to and with them.

    Rows are dealt to ranges of group and order.  Only the sums of a group in a range meet again,
    so a group of any size is never in one task.
    """
    # The order within equal places is drawn once and written, so that it is the same wherever the table is read.
    cut = materialize(rows.withColumn("_cost", cost).repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_cost").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lifts = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_range").orderBy(*order)
    numbered_ = cut.withColumn("place", F.row_number().over(inside) - 1).withColumn("running", F.sum("_cost").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    both = numbered_.join(lifts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return both.withColumn("place", F.col("place") + F.col("_rows")).withColumn("running", F.col("running") + F.col("_before")).select(*rows.columns, "place", "running")
