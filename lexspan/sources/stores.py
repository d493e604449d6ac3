"""Stored tables: the vector index by version, run results, question sets, exports, captures and frames."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshots import Snapshots

# Fixed value: what a run may be called.
LABEL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class MissingPartition(LookupError):
    """A store holds nothing for what was asked."""


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_versions(rows: DataFrame, path: str, column: str = "version") -> None:
    """Replaces the rows of the versions that rows hold, and no others, in one commit."""
    Snapshots(rows.sparkSession, path).replace(rows, column)


def read_version(spark: SparkSession, path: str, version: str, column: str = "version") -> DataFrame:
    """One version's rows; MissingPartition names the version if the store or the version is missing."""
    rows = Snapshots(spark, path).rows(f"{column}={version}")
    if rows is None:
        raise MissingPartition(f"no {version} in {path}; write it first")
    return rows


def run_label(label: str) -> str:
    """The label, if it can name a partition."""
    if not LABEL.fullmatch(label):
        raise ValueError(f"{label!r} is not a run label: letters, digits, dots, dashes and underscores, the first a letter or digit")
    return label


def append_results(rows: DataFrame, path: str, label: str | None = None) -> None:
    """Appends result rows to the current run, and to a labelled one if asked for: written once, in both by one commit."""
    Snapshots(rows.sparkSession, path).append(rows, "current", *([run_label(label)] if label else []))


def read_results(spark: SparkSession, path: str, schema: T.StructType, defaults: dict, run: str = "current") -> DataFrame:
    """A run's rows under the schema; fields that older rows lack get their defaults."""
    rows = Snapshots(spark, path).rows(run, schema=schema)
    if rows is None:
        raise MissingPartition(f"no run {run} in {path}")
    return rows.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in schema.fieldNames()))


def export_provisions(rows: DataFrame, path: str, stamp: dict) -> DataFrame:
    """Provisions as JSON by version, and a manifest row a version: number of rows and the stamp's fields."""
    rows.write.mode("overwrite").partitionBy("version").json(f"{path}/provisions")
    counts = rows.groupBy("version").agg(F.count(F.lit(1)).alias("rows"))
    manifest = counts.select("version", "rows", *(F.lit(v).alias(k) for k, v in stamp.items()))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_export(spark: SparkSession, path: str, schema: T.StructType, version: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(f"{path}/provisions")
    return rows if version is None else rows.where(F.col("version") == version)


QUESTION = "id string, description string, flow string, gold map<string, array<string>>, expects_refusal boolean"


def write_questions(questions: DataFrame, path: str) -> None:
    """A question set (QUESTION) as JSON lines; a question without gold of every version it is asked of is for the reader to refuse."""
    questions.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str, versions: tuple[str, ...] = ("original", "consolidated")) -> DataFrame:
    """The question set at a path; its read fails with the name of a question that has no gold for one of the versions."""
    rows = spark.read.schema(QUESTION).json(path)
    lacking = F.filter(F.array(*map(F.lit, versions)), lambda v: ~F.map_contains_key("gold", v))
    whole = F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("question "), "id", F.lit(" has no gold for "), F.array_join(lacking, ", ")))).otherwise(F.col("id"))
    return rows.withColumn("id", F.when(F.col("id").isNotNull(), whole))


def write_summary(stamped: DataFrame, path: str) -> None:
    """Stamped summary rows as JSON lines, nulls written out."""
    stamped.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_summary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def capture(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Merges new captures over those of the table at a path by keys; failures (error set) change nothing."""
    good = new.where("error is null").drop("error")
    table = Snapshots(new.sparkSession, path)
    merged = lambda old: good if old is None else good.unionByName(old.join(good.select(*keys).distinct(), keys, "left_anti"))
    return table.rows("captures", table.update("captures", merged))


def frame(event: str, body: Column) -> Column:
    """A server-sent event: its name and a JSON body, closed by a blank line; absent fields are left out."""
    return F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(body), F.lit("\n\n"))


#: Events of a stream; the last two end it.
EVENTS = ("node", "answer", "error")


def read_frames(streams: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """key, at, event, body, unreadable of the frames of a stream's text, in order.

    Unreadable: of no known event, without data, no JSON of the schema, or a node's frame that names no node.
    """
    each = streams.select(key, F.posexplode(F.filter(F.split(text, r"\r?\n\r?\n"), lambda f: F.trim(f) != "")).alias("at", "frame"))
    field = lambda name: F.regexp_extract("frame", rf"(?m)^{name}: ?(.*)$", 1)
    data, event = field("data"), field("event")
    parsed = F.from_json(data, f"{schema}, _unread string", {"columnNameOfCorruptRecord": "_unread"})
    rows = each.select(key, "at", event.alias("event"), F.when(data != "", parsed).alias("b"))
    names = [f.name for f in rows.schema["b"].dataType.fields if f.name != "_unread"]
    unreadable = ~F.col("event").isin(*EVENTS) | F.col("b").isNull() | F.col("b._unread").isNotNull()
    if "node" in names:
        unreadable = unreadable | ((F.col("event") == "node") & F.col("b.node").isNull())
    body = F.when(F.col("b").isNotNull(), F.struct(*(F.col(f"b.{n}").alias(n) for n in names)))
    return rows.select(key, "at", "event", body.alias("body"), unreadable.alias("unreadable"))


def stream_state(frames: DataFrame, key: str) -> DataFrame:
    """key, state, nodes, ended of each stream: answered or error by the frame that closes it, failed where the first
    such frame can't be read or none came; the readable node frames before that; the closing frame's place or null."""
    ends = F.col("event").isin("answer", "error") | F.col("unreadable")
    first = F.min(F.when(ends, F.struct("at", F.when(F.col("unreadable"), "unreadable").otherwise(F.col("event")).alias("event"))))
    closed = frames.groupBy(key).agg(first.alias("end"), F.sort_array(F.collect_list(F.when(~ends, F.col("at")))).alias("nodes"))
    state = F.when(F.col("end.event") == "answer", "answered").when(F.col("end.event") == "error", "error").otherwise("failed")
    before = F.size(F.filter("nodes", lambda n: F.col("end").isNull() | (n < F.col("end.at"))))
    return closed.select(key, state.alias("state"), before.alias("nodes"), F.col("end.at").alias("ended"))
