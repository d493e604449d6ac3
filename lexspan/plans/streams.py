"""Registered queries on streams: runs told node by node, and recordings played again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..streaming import emit, progress, replay
from . import answers  # noqa: F401  (its SQL is shared)
from .catalogue import SQL, query, read

DAY_MS = 86_400_000
_MS = "epoch_ms(ts)"
#: Events of a user as updates of one run, numbered by time; what ends it, before its own row (silent, failed) or after it (last).
_RUNS = f"""u AS (SELECT user_id, event_id, event_type, value, {_MS} AS moment, row_number() OVER w - 1 AS step, {_MS} - lag({_MS}) OVER w > 2 * {DAY_MS} AS silent,
  event_type = 'error' AND event_id % 5 = 0 AS failed, event_type = 'signup' AND event_id % 3 = 0 AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
newest AS (SELECT max(moment) AS top FROM u),
ends AS (SELECT user_id, min(step) FILTER (silent OR failed OR last) AS stop, max(moment) AS seen FROM u GROUP BY user_id),
told AS (SELECT u.*, stop FROM u JOIN ends USING (user_id) WHERE stop IS NULL OR step < stop OR (step = stop AND last AND NOT coalesce(silent, false) AND NOT failed)),
closing AS (SELECT e.user_id, CASE WHEN u.step IS NULL THEN CASE WHEN e.seen + 2 * {DAY_MS} < top - {DAY_MS} THEN 'failed' END WHEN silent THEN 'failed' WHEN failed THEN 'invalid' ELSE 'last' END AS how
  FROM ends e CROSS JOIN newest LEFT JOIN u ON u.user_id = e.user_id AND u.step = e.stop)"""


def _updates(spark, d):
    """Events as updates of their users' runs."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")) - 1
    kind, item = F.col("event_type"), F.struct(F.concat(F.lit("art_"), (F.col("event_id") % 7).cast("string")).alias("provision_id"))
    twice = lambda on: F.when(kind == on, F.array(item, item))
    none = F.lit(None).cast("array<string>")
    body = emit.node_frame(kind, twice("view"), none, none, F.when(kind == "signup", F.array().cast("array<string>")), F.lit(None).cast("array<struct<source_id:string,target_id:string,hop:int>>"), twice("click"))
    return e.select(
        "user_id", step.alias("step"), "at", body.alias("body"), F.when(kind == "purchase", F.format_string('{"value":%d}', "event_id")).alias("answer"),
        F.when((kind == "error") & (F.col("event_id") % 5 == 0), "invalid").alias("failure"), ((kind == "signup") & (F.col("event_id") % 3 == 0)).alias("last"),
    )


@query(f"""WITH {_RUNS}, n AS (SELECT user_id, count(*) AS nodes, count(*) FILTER (event_type = 'view') AS with_searched, count(*) FILTER (event_type = 'click') AS with_supplied,
  count(*) FILTER (event_type = 'signup') AS with_dropped, max_by(event_id, step) FILTER (event_type = 'purchase') AS answer FROM told GROUP BY user_id)
SELECT c.user_id, coalesce(nodes, 0) AS nodes, coalesce(with_searched, 0) AS with_searched, coalesce(with_supplied, 0) AS with_supplied, coalesce(with_dropped, 0) AS with_dropped,
  CASE WHEN how = 'last' AND answer IS NOT NULL THEN 'answer' WHEN how IS NOT NULL THEN 'error' END AS closing,
  CASE WHEN how = 'last' AND answer IS NOT NULL THEN '{{"value":' || answer || '}}' WHEN how = 'last' THEN '{{"state":"failed"}}' WHEN how IS NOT NULL THEN '{{"state":"' || how || '"}}' END AS closing_body,
  coalesce(nodes, 0) + (how IS NOT NULL)::INT AS frames FROM closing c LEFT JOIN n USING (user_id)""")
def frames_emitted(spark, d):
    """Runs told node by node from a recorded stream that keeps no order: frames in step order, then the answer or an error; silent runs fail."""
    path = scratch_path(spark, "emitted")
    updates = _updates(spark, d)
    replay.record(updates, f"{path}/recording", F.unix_millis("at"), 4 * DAY_MS)
    emit.follow_frames(emit.frames_of(replay.play(spark, f"{path}/recording", updates.schema), "user_id", 2 * DAY_MS, DAY_MS), path)
    frames = spark.read.parquet(f"{path}/frames")
    node, body = F.col("event") == "node", F.from_json("body", "searched_ids array<string>, supplied_ids array<string>, dropped_ids array<string>")
    sized = lambda c, n: F.count_if(node & (F.size(body[c]) == n))
    closing = lambda c: F.max_by(c, F.when(~node, F.col("seq")))
    got = frames.groupBy("user_id").agg(
        F.count_if(node).alias("nodes"), sized("searched_ids", 1).alias("with_searched"), sized("supplied_ids", 2).alias("with_supplied"), sized("dropped_ids", 0).alias("with_dropped"),
        closing("event").alias("closing"), closing("body").alias("closing_body"), (F.max("seq") + 1).cast("long").alias("frames"),
    )
    return got


@query(SQL["progress_stream"])
def replay_progress(spark, d):
    """Events recorded by day, played again as a stream and folded as they come."""
    path = scratch_path(spark, "replayed")
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    replay.record(e, f"{path}/recording", F.unix_millis("ts"), 4 * DAY_MS)
    frames = replay.play(spark, f"{path}/recording", e.schema)
    fields = {"last_node": F.col("event_type"), "last_value": F.when(F.col("event_type") == "purchase", F.col("value"))}
    progress.follow(frames, "user_id", F.struct("ts", "event_id"), fields, path)
    return progress.progress(spark, path, "user_id")
