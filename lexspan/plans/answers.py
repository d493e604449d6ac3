"""Registered queries on answers, passages, reports and progress streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import compare, passages, verify
from ..sources.scratch import scratch_path
from ..streaming import progress
from .catalogue import _CW, _FACTS, alike, query, read

_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{4,}}'))"


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
g AS (SELECT conv_id, turn, role, {_CW.replace('{}', 'text')} AS c, {_CW.replace('{}', "coalesce(before, '')")} AS s FROM t WHERE role = 'assistant'),
h AS (SELECT conv_id, turn, role, len(c) > 0 AND len(list_intersect(c, s)) / len(c) >= 0.6 AS ok FROM g)
SELECT conv_id, turn, role, CASE WHEN turn % 5 = 0 THEN 'passed' WHEN NOT ok THEN 'grounding' WHEN turn % 3 = 0 THEN 'timing' ELSE 'answered' END AS outcome,
  CASE WHEN turn % 5 = 0 OR (ok AND turn % 3 <> 0) THEN 1 ELSE 0 END AS n_kept FROM h""")
def verify_answers(spark, d):
    """Assistant turns as claims on the turn before; some refused already, some asked for a time."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    t = c.withColumn("before", F.coalesce(before, F.lit(""))).where("role = 'assistant'")
    question = F.when(F.col("turn") % 3 == 0, "When does it apply?").otherwise("What does it say?")
    claims = F.array(F.struct(F.col("text").alias("statement"), F.array("before").alias("cited")))
    out = t.withColumn("v", verify.verify_answer(question, claims, F.col("turn") % 5 == 0))
    return out.select("conv_id", "turn", "role", F.col("v.outcome").alias("outcome"), F.size("v.kept").alias("n_kept"))


@query(f"""WITH w AS (SELECT DISTINCT conv_id, turn, role, unnest({_CW.replace('{}', 'text')}) AS word FROM conversations),
f AS (SELECT conv_id, word, min(turn) AS first FROM w GROUP BY 1, 2),
n AS (SELECT conv_id, turn, count(*) AS n_words, count(*) FILTER (first < turn) AS n_contained FROM w JOIN f USING (conv_id, word) WHERE role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(n_words, 0) AS n_words, coalesce(n_contained, 0) AS n_contained
FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant') LEFT JOIN n USING (conv_id, turn)""")
def containment_supplied(spark, d):
    """How many content words of each assistant turn the turns before it supply."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return verify.containment(c.where("role = 'assistant'"), c, "conv_id", "turn")


_SENTENCES = r"list_filter(string_split(regexp_replace({}, '[0-9()]', '', 'g'), '. '), lambda x: length(trim(x)) > 0)"


@query(f"""WITH docs AS (SELECT doc_id, text, sha256(lower(array_to_string(list_slice(regexp_split_to_array(trim(text), '\\s+'), 1, 8), ' '))) AS k FROM documents WHERE text IS NOT NULL),
first AS (SELECT k, min(doc_id) AS other FROM docs GROUP BY k),
pairs AS (SELECT d.doc_id, f.other, o.text AS base, coalesce(({_SENTENCES.format('d.text')})[-1], '') AS claim FROM docs d JOIN first f USING (k) JOIN docs o ON o.doc_id = f.other WHERE d.text <> o.text),
claims AS (SELECT doc_id, other, {_SENTENCES.format('base')} AS s, list_distinct(regexp_extract_all(lower(claim), '[\\pL\\pN]{{4,}}')) AS w FROM pairs),
points AS (SELECT doc_id, other, len(s) AS m, i, len(list_intersect(w, list_distinct(regexp_extract_all(lower(s[i]), '[\\pL\\pN]{{4,}}')))) AS n FROM claims, LATERAL (SELECT unnest(range(1, greatest(len(s), 1) + 1)) AS i)),
best AS (SELECT doc_id, other, max(m) AS m, coalesce(max(n), 0) AS n, arg_min(i, (-n, i)) AS i FROM points GROUP BY 1, 2)
SELECT doc_id, other, CASE WHEN m < 2 THEN 'whole' WHEN n < 8 THEN 'top' ELSE 'point' END AS kind,
  CASE WHEN m >= 2 AND n >= 8 THEN 'Article ' || other || '(' || i || ')' END AS name, CASE WHEN m >= 2 AND n >= 8 THEN n END AS shared FROM best""")
def closest_point(spark, d):
    """Where the last sentence of each document stands in the first one that begins as it does, its sentences numbered as points."""
    sentences = lambda c: F.filter(F.split(F.regexp_replace(c, "[0-9()]", ""), r"\. "), lambda s: F.trim(s) != "")
    rows = alike(spark, d).select("doc_id", "other", sentences("other_text").alias("s"), F.coalesce(F.try_element_at(sentences("text"), F.lit(-1)), F.lit("")).alias("claim"))
    numbered = F.array_join(F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), ". ")
    rows = rows.withColumn("p", passages.closest_point(F.format_string("Article %d", "other"), numbered, F.col("claim")))
    return rows.select("doc_id", "other", "p.kind", "p.name", "p.shared")


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES.format("coalesce(text, '')")} AS s FROM documents)
SELECT doc_id, 1 + len(s) AS n, 'Scope of this text.' AS lead, CASE WHEN len(s) > 0 THEN len(s)::VARCHAR ELSE '' END AS last_path,
  CASE WHEN len(s) > 0 THEN sha256(trim(len(s) || '. ' || s[-1], E' \\n\\t\\r')) ELSE sha256('Scope of this text.') END AS last_text FROM s""")
def document_segments(spark, d):
    """Documents with their sentences numbered after a lead: cut at their numbers, the lead first."""
    sentences = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9()]", ""), r"\. "), lambda s: F.trim(s) != "")
    numbered = F.concat_ws(" ", F.lit("Scope of this text."), F.when(F.size(sentences) > 0, F.array_join(F.transform(sentences, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), ". ")))
    rows = read(spark, d, "documents").select("doc_id", passages.segments_of(numbered).alias("p"))
    last = F.element_at("p", -1)
    return rows.select("doc_id", F.size("p").alias("n"), F.col("p")[0]["text"].alias("lead"), F.array_join(last["path"], ".").alias("last_path"), F.sha2(last["text"], 256).alias("last_text"))


@query(f"""WITH s AS (SELECT doc_id, len({_SENTENCES.format("coalesce(text, '')")}) AS m FROM documents)
SELECT doc_id, m AS n, (m + 1) // 2 AS n_changed, sha256(array_to_string(list_transform(range(1, m + 1, 2), lambda i: i || ':neww wordd' || i), '|')) AS changed FROM s""")
def segment_changes(spark, d):
    """Documents with words added to every other numbered sentence: the diff of the whole, sentence by sentence."""
    sentences = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9()]", ""), r"\. "), lambda s: F.trim(s) != "")
    number = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)
    joined = lambda f: F.array_join(F.transform(sentences, f), ". ")
    longer = joined(lambda x, i: F.when(i % 2 == 0, F.concat(number(x, i), F.lit(" neww wordd"), (i + 1).cast("string"))).otherwise(number(x, i)))
    rows = read(spark, d, "documents").select("doc_id", compare.passage_diff(joined(number), longer).alias("p"))
    changed = F.transform("p", lambda p: F.struct(F.array_join(p["path"], ".").alias("at"), F.array_join(F.transform(F.filter(p["spans"], lambda s: s["changed"]), lambda s: s["text"]), "/").alias("text")))
    told = rows.select("doc_id", F.size("p").alias("n"), F.filter(changed, lambda c: c["text"] != "").alias("c"))
    return told.select("doc_id", "n", F.size("c").alias("n_changed"), F.sha2(F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["at"], c["text"])), "|"), 256).alias("changed"))


@query(f"""WITH w AS (SELECT item_id, unnest({_CW.replace('{}', 'text')}) AS word FROM benchmark), have AS (SELECT DISTINCT unnest({_CW.replace('{}', 'text')}) AS word FROM documents),
n AS (SELECT item_id, count(*) AS n_words, count(have.word) AS n_contained FROM w LEFT JOIN have USING (word) GROUP BY 1)
SELECT item_id, coalesce(n_words, 0) AS n_words, coalesce(n_contained, 0) AS n_contained FROM benchmark LEFT JOIN n USING (item_id)""")
def containment_benchmark(spark, d):
    """How many content words of each benchmark item the documents supply."""
    words = lambda name, *keys: read(spark, d, name).select(*keys, F.explode(tx.content_words(F.col("text"))).alias("word"))
    have = words("documents").distinct().withColumn("known", F.lit(1))
    counted = words("benchmark", "item_id").join(have, "word", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_words"), F.count("known").alias("n_contained"))
    every = read(spark, d, "benchmark").select("item_id").join(counted, "item_id", "left")
    return every.select("item_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_words", "n_contained")))


@query(f"""WITH {_FACTS} SELECT arm, version, count(*) AS runs, max(ms) FILTER (NOT failed AND call_index = 0) AS first_call_ms,
  round(avg(ms) FILTER (NOT failed AND call_index > 0), 6) AS later_calls_ms FROM f GROUP BY arm, version""")
def first_vs_later(spark, d):
    """The opening call of each arm and version against the mean of the others."""
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("arm"), (F.col("user_id") % 2).alias("version"))
    opening = F.col("event_id") == F.col("first")
    whole = e.groupBy("arm", "version").agg(F.min("event_id").alias("first"))
    ok, ms = F.col("event_id") % 11 != 0, F.col("event_id") % 997
    return e.join(whole, ["arm", "version"]).groupBy("arm", "version").agg(
        F.count(F.lit(1)).alias("runs"), F.max(F.when(ok & opening, ms)).alias("first_call_ms"), F.round(F.avg(F.when(ok & ~opening, ms)), 6).alias("later_calls_ms"),
    )


@query("""SELECT event_type, round(sum(event_id % 1000)::DOUBLE / 1e6 * 3 + sum(event_id % 100)::DOUBLE / 1e6 * 15, 6) AS cost FROM events GROUP BY event_type""")
def cost_projection(spark, d):
    e = read(spark, d, "events").groupBy("event_type").agg(F.sum(F.col("event_id") % 1000).alias("p"), F.sum(F.col("event_id") % 100).alias("c"))
    return e.select("event_type", F.round(tx.projected_cost(F.col("p"), F.col("c")), 6).alias("cost"))


@query("""SELECT user_id, count(*) AS frames, max_by(event_type, (ts, event_id)) AS last_node,
  max_by(value, (ts, event_id)) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS last_value FROM events GROUP BY user_id""")
def progress_stream(spark, d):
    """The events read as a stream of frames and folded as they come; the newest row of each user."""
    path = scratch_path(spark, "progress")
    source = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    frames = source.select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    fields = {"last_node": F.col("event_type"), "last_value": F.when(F.col("event_type") == "purchase", F.col("value"))}
    progress.follow(frames, "user_id", F.struct("ts", "event_id"), fields, path)
    return progress.progress(spark, path, "user_id")
