"""Offset joins: spans between markers, the state at an offset, anything within a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(rows: DataFrame, key: str, offset: str, limit: Column, is_start: Column, is_stop: Column, order: list | None = None) -> DataFrame:
    """Start rows with `span_end`: the next start in (offset, order), else the limit, cut at the first stop strictly inside.

    Of two starts at one offset the earlier gets an empty span.  Offsets are whole numbers.
    Frames grow from the far end of a key, so a key's rows are gone through once.
    """
    order = order or []
    back = Window.partitionBy(key).orderBy(F.desc(offset), *(F.desc(c) for c in order))
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy(key).orderBy(F.desc(offset)).rangeBetween(Window.unboundedPreceding, -1)
    next_start = F.last(F.when(is_start, F.col(offset)), ignorenulls=True).over(after)
    next_stop = F.min(F.when(is_stop, F.col(offset))).over(beyond)
    found = rows.withColumn("_start", is_start).withColumn("_end", F.coalesce(next_start, limit)).withColumn("_stop", next_stop).where("_start")
    return found.withColumn("span_end", F.when(F.col("_stop") < F.col("_end"), F.col("_stop")).otherwise(F.col("_end"))).drop("_start", "_end", "_stop")


def first_inside(spans_: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str, value: str, name: str) -> DataFrame:
    """spans with `name`, the value of the first point of the same key strictly between start and end, else null.

    Points and span starts of a key are put in order and the next point looked up backwards,
    so no span meets more than one point.
    """
    both = spans_.select(F.col(key), F.col(start).alias("_at")).distinct().withColumn("_point", F.lit(None).cast("struct<at: bigint, value: string>"))
    marks = points.select(F.col(key), F.col(at).alias("_at"), F.struct(F.col(at).cast("long").alias("at"), F.col(value).cast("string").alias("value")).alias("_point"))
    first = marks.groupBy(key, "_at").agg(F.min("_point").alias("_point"))
    beyond = Window.partitionBy(key).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    found = both.unionByName(first).withColumn("_next", F.min("_point").over(beyond)).where("_point is null").select(F.col(key), F.col("_at").alias(start), "_next")
    inside = F.when(F.col("_next.at") < F.col(end), F.col("_next.value"))
    return spans_.join(found, [key, start], "left").withColumn(name, inside).drop("_next")


def holder_of(points: DataFrame, spans_: DataFrame, key: str, at: str, start: str, end: str, order: str) -> DataFrame:
    """points with the columns of the span of their key that holds them (start <= at < end), for spans that do not overlap; others are left out.

    One sweep of each key's points and spans in order: a point is held by the last span that began, if by any.
    """
    named = [c for c in spans_.columns if c != key]
    opened = spans_.select(F.col(key), F.col(start).alias("_at"), F.lit(0).alias("_probe"), F.col(order).cast("long").alias("_order"), F.struct(*named).alias("_span"))
    asked = points.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast("long").alias("_order"), F.struct(*(c for c in points.columns if c != key)).alias("_point"))
    both = opened.unionByName(asked, allowMissingColumns=True)
    sweep = Window.partitionBy(key).orderBy("_at", "_probe", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_span", F.last("_span", ignorenulls=True).over(sweep)).where(f"_probe = 1 and _span is not null and _at < _span.{end}")
    return found.select(F.col(key), "_point.*", "_span.*")


def state_at(rows: DataFrame, key: str, order: list, state: Column) -> Column:
    """The last non-null state up to and including each row (backward as-of)."""
    return F.last(state, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def any_between(ranges: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str, width: float) -> DataFrame:
    """ranges with `hit`: whether a point of the same key lies in [start, end).

    Both sides are dealt to bins of `width` along the axis, so that the range condition runs
    inside an equi-join; a range meets a bin at most once.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    left = ranges.select(key, start, end).distinct().withColumn("_bin", F.explode(bins))
    right = points.select(F.col(key), F.col(at).alias("_at")).withColumn("_bin", F.floor(F.col("_at") / width))
    hits = left.join(right, [key, "_bin"]).where((F.col("_at") >= F.col(start)) & (F.col("_at") < F.col(end))).select(key, start, end).distinct()
    return ranges.join(hits.withColumn("_hit", F.lit(True)), [key, start, end], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
