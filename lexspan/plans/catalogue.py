"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import compare, evaluate, intervals, order, report, search, skew, walk

QUERIES: dict = {}
SQL: dict[str, str] = {}
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- search, budget, scores -------------------------------------------------------------

_KNN = """near AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS gold,
    round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS d
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM near) WHERE rank <= 12)"""


def _knn(spark, d, k=12):
    v = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.nearest(v.select("vec_id", "embedding"), q, k)


@query(f"WITH {_KNN} SELECT query_id, vec_id, d, rank FROM knn")
def knn_topk(spark, d):
    return _knn(spark, d)


@query(f"WITH {_KNN} SELECT query_id, vec_id, d, rank FROM knn")
def knn_pruned(spark, d):
    """The same by cells around centres, of which those out of reach are left out."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return search.nearest_pruned(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 12)


@query(f"""WITH {_KNN}, kept AS (SELECT *, sum(100 + vec_id % 50) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM knn)
SELECT query_id, count(*) AS n_searched, count(*) FILTER (run <= 1000 OR rank = 1) AS n_kept,
  count(*) FILTER (NOT (run <= 1000 OR rank = 1)) AS n_dropped,
  round(count(*) FILTER ((run <= 1000 OR rank = 1) AND label = gold) / count(*) FILTER (run <= 1000 OR rank = 1), 6) AS precision,
  round(count(*) FILTER ((run <= 1000 OR rank = 1) AND label = gold) / max(g.n), 6) AS recall
FROM kept JOIN (SELECT label AS l, count(*) - 1 AS n FROM embeddings GROUP BY 1) g ON g.l = gold WHERE g.n > 0 GROUP BY query_id""")
def retrieve_budget_score(spark, d):
    """Search, keep the prefix that the budget allows, score against rows of the query's label."""
    v = read(spark, d, "embeddings").select("vec_id", "label")
    gold = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    hits = _knn(spark, d).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id")
    cut = search.within_budget(hits, "query_id", ["rank"], 100 + F.col("vec_id") % 50, 1000)
    good = F.count_if(F.col("kept") & (F.col("label") == F.col("gold")))
    out = cut.join(gold.withColumnRenamed("label", "gold"), "gold").where("n_gold > 0").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_searched"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"),
        F.round(good / F.count_if("kept"), 6).alias("precision"), F.round(good / F.max("n_gold"), 6).alias("recall"),
    )
    return out


_BUDGET = """cut AS (SELECT lang, doc_id, position, run <= 73216 OR position = 1 AS kept FROM (SELECT lang, doc_id,
  row_number() OVER w AS position, sum(n_chars + 8) OVER (w ROWS UNBOUNDED PRECEDING) AS run
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY lang = 'en', doc_id)))"""


def _budget(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs, search.prefix_within(docs, "source", [F.col("lang") == "en", "doc_id"], F.col("n_chars") + 8, 73_216, 8)


@query(f"WITH {_BUDGET} SELECT doc_id, position FROM cut WHERE kept")
def budget_prefix(spark, d):
    return _budget(spark, d)[1].select("doc_id", "position")


@query(f"WITH {_BUDGET} SELECT lang, count(*) AS dropped FROM cut WHERE NOT kept GROUP BY lang")
def budget_dropped(spark, d):
    """All rows less the kept ones, by language."""
    docs, kept = _budget(spark, d)
    both = docs.select("lang", F.lit(1).alias("n")).unionByName(kept.select("lang", F.lit(-1).alias("n")))
    return both.groupBy("lang").agg(F.sum("n").alias("dropped")).where("dropped > 0")


# --- references and graph ---------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_linenumber AS a, l_linenumber + l_suppkey % 3 AS b FROM lineitem)
SELECT DISTINCT 'x_' || k AS source_id, 'art_' || g.n AS target_id FROM l, LATERAL (SELECT unnest(range(a, b + 1)) AS n) g""")
def ref_extract_edges(spark, d):
    """References written out from line items, read back as edges; those to other acts are dropped."""
    l = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + F.col("l_suppkey") % 3).cast("int").alias("b"))
    span = F.when(F.col("a") == F.col("b"), F.format_string("Article %d", "a")).otherwise(F.format_string("Articles %d to %d", "a", "b"))
    text = F.concat(F.lit("Subject to "), span, F.lit(" of this act and Article 99 of Directive 5, nothing else."))
    rows = l.select(F.concat(F.lit("x_"), F.col("k")).alias("id"), text.alias("text"))
    known = spark.range(1, 21).select(F.concat(F.lit("art_"), "id").alias("id"), F.lit("").alias("text"))
    return walk.extract_references(rows.unionByName(known)).select("source_id", "target_id").distinct()  # line numbers repeat


def _edges(spark, d):
    """Parts that follow one another in an order."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    e = l.select(F.col("l_partkey").alias("source_id"), nxt.alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    e = e.where("target_id is not null and source_id <> target_id")
    return e.groupBy("source_id", "target_id").agg(F.min("o").alias("ord"))


def _seeds(spark, d):
    return read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("id"), F.lit(1).alias("pos"))


_EDGES = """e AS (SELECT s, t, min(o) AS o FROM (SELECT l_partkey AS s, l_orderkey * 10 + l_linenumber AS o,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS t FROM lineitem)
  WHERE t IS NOT NULL AND s <> t GROUP BY s, t)"""
_HOPS = f"""{_EDGES}, seed AS (SELECT p_partkey AS q FROM part WHERE p_partkey % 20 = 0),
h1 AS (SELECT q, t AS id, q AS src, row_number() OVER (PARTITION BY q ORDER BY o, t) AS npos FROM seed JOIN e ON s = q),
h2 AS (SELECT * FROM (SELECT h1.q, e.t AS id, h1.id AS src, row_number() OVER (PARTITION BY h1.q, e.t ORDER BY h1.npos, e.o) AS n
  FROM h1 JOIN e ON e.s = h1.id WHERE e.t <> h1.q AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.q = h1.q AND x.id = e.t)) WHERE n = 1),
hops AS (SELECT q AS query_id, id, 1 AS hop, src FROM h1 UNION ALL SELECT q, id, 2, src FROM h2)"""


@query(f"WITH {_EDGES} SELECT s AS part, array_to_string(list(t ORDER BY o, t), ',') AS neighbours FROM e GROUP BY s")
def adjacency_out(spark, d):
    out = walk.adjacency(_edges(spark, d), "source_id", "target_id")
    return out.select(F.col("source_id").alias("part"), F.array_join("neighbours", ",").alias("neighbours"))


@query(f"WITH {_HOPS} SELECT query_id, hop, count(*) AS n FROM hops GROUP BY 1, 2")
def neighbours_depth2(spark, d):
    out = walk.walk(_seeds(spark, d), _edges(spark, d), 2, None)
    return out.groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_HOPS} SELECT * FROM (SELECT query_id, id, hop, src, row_number() OVER (PARTITION BY query_id ORDER BY hop, id::VARCHAR) AS rank FROM hops) WHERE rank <= 40""")
def traverse_ranked_cap(spark, d):
    return walk.walk(_seeds(spark, d), _edges(spark, d), 2, 40)


_REACH = f"""{_EDGES}, seed AS (SELECT p_partkey AS q FROM part WHERE p_partkey % 20 = 0),
r1 AS (SELECT DISTINCT q, t AS id FROM seed JOIN e ON s = q),
r2 AS (SELECT DISTINCT r1.q, t AS id FROM r1 JOIN e ON s = r1.id WHERE t <> q EXCEPT SELECT * FROM r1),
r3 AS (SELECT DISTINCT r2.q, t AS id FROM r2 JOIN e ON s = r2.id WHERE t <> q EXCEPT SELECT * FROM r1 EXCEPT SELECT * FROM r2),
reached AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hop, id::VARCHAR) AS rank FROM
  (SELECT q, id, 1 AS hop FROM r1 UNION ALL SELECT q, id, 2 FROM r2 UNION ALL SELECT q, id, 3 FROM r3)) WHERE rank <= 40)"""


@query(f"""WITH {_REACH}, every AS (SELECT q, depth, q % 40 = 0 AS even FROM seed CROSS JOIN (VALUES (1), (2), (3)) d(depth)),
per AS (SELECT q, depth, even, (SELECT count(*) FROM reached r WHERE r.q = e.q AND hop <= depth) AS n, (SELECT count(*) FROM reached r WHERE r.q = e.q AND hop <= depth AND id IN (q + 1, q + 2, q + 3)) AS found FROM every e)
SELECT CASE WHEN even THEN 'original' ELSE 'consolidated' END AS version, depth, count(*) AS questions, round(avg(found / 3), 6) AS recall, round(avg(n + 1), 6) AS nodes, round(avg(n + 1), 6) AS articles FROM per GROUP BY 1, 2""")
def depth_sensitivity(spark, d):
    """Questions, mean recall, nodes and articles by version for depths 1 to 3 under the cap, from one walk to depth 3.

    A seed's gold nodes are the three parts numbered after it; every part is its own article.
    """
    seeds = _seeds(spark, d)
    reached = walk.walk(seeds, _edges(spark, d), 3, 40).select("query_id", "id", "hop")
    gold = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: (F.col("query_id") + k).cast("string"))
    version = F.when(F.col("query_id") % 40 == 0, "original").otherwise("consolidated")
    recorded = seeds.select("query_id", version.alias("version"), F.array(F.col("id").cast("string")).alias("searched"), gold.alias("gold"))
    return report.depth_rows(recorded, reached)


@query("""SELECT query_id, id, src FROM (SELECT o_orderkey % 1000 AS query_id, 'c' || o_custkey AS id, 'o' || o_orderkey AS src,
  row_number() OVER (PARTITION BY o_orderkey % 1000, o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def lift_parent(spark, d):
    """Each group of orders is lifted to its customers, by the first order of each."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    seeds = o.select((F.col("o_orderkey") % 1000).alias("query_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    parents = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"))
    return walk.lift(seeds, parents).select("query_id", "id", "src")


# --- offsets ----------------------------------------------------------------------------


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events""")
def asof_state(spark, d):
    e = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    state = F.when(F.col("event_type") == "error", F.col("event_id"))
    return e.select("event_id", intervals.state_at(e, "user_id", ["ts", "event_id"], state).alias("last_error"))


_SPANS = """e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 60000000 AS tm FROM events),
m AS (SELECT user_id, max(tm) + 1 AS lim FROM e GROUP BY 1),
v AS (SELECT user_id, event_id, tm, coalesce(lead(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id), lim) AS e0 FROM e JOIN m USING (user_id) WHERE event_type = 'view'),
stop AS (SELECT v.event_id, min(e.tm) AS s FROM v JOIN e ON e.user_id = v.user_id AND e.event_type = 'purchase' AND e.tm > v.tm AND e.tm < v.e0 GROUP BY 1),
spans AS (SELECT v.user_id, v.event_id, v.tm AS span_start, coalesce(s, e0) AS span_end FROM v LEFT JOIN stop USING (event_id))"""


def _minutes(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("at"))


def _spans(spark, d):
    e = _minutes(spark, d).withColumn("lim", F.max("at").over(Window.partitionBy("user_id")) + 1)
    return intervals.spans(e, "user_id", "at", F.col("lim"), F.col("event_type") == "view", F.col("event_type") == "purchase", ["event_id"])


@query(f"WITH {_SPANS} SELECT event_id, span_start, span_end FROM spans")
def span_lead(spark, d):
    """From each view to the user's next one, in whole minutes, cut at the first purchase in between; of two views in a minute the first has no time."""
    return _spans(spark, d).select("event_id", F.col("at").alias("span_start"), "span_end")


@query(f"""WITH {_SPANS} SELECT s.event_id, s.span_end, arg_min(e.event_id, (e.tm, e.event_id::VARCHAR))::VARCHAR AS first_click
FROM spans s LEFT JOIN e ON e.user_id = s.user_id AND e.event_type = 'click' AND e.tm > s.span_start AND e.tm < s.span_end GROUP BY 1, 2""")
def subtitle_first(spark, d):
    """The first click strictly inside each span, as a heading's subtitle is looked up."""
    clicks = _minutes(spark, d).where("event_type = 'click'").withColumn("value", F.col("event_id").cast("string"))
    return intervals.first_inside(_spans(spark, d), clicks, "user_id", "at", "span_end", "at", "value", "first_click").select("event_id", "span_end", "first_click")


@query("""SELECT v.event_id, max(s.event_id) AS chapter FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v
LEFT JOIN (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'signup') s
ON s.user_id = v.user_id AND s.ts <= v.ts AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'signup' AND x.user_id = v.user_id AND x.ts <= v.ts AND (x.ts, x.event_id) > (s.ts, s.event_id)) GROUP BY 1""")
def chapter_asof(spark, d):
    """The last sign-up at or before each view, as a position's chapter is looked up."""
    e = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    state = F.when(F.col("event_type") == "signup", F.col("event_id"))
    # Openings at a view's own place count: they come first.
    order = ["ts", (F.col("event_type") != "signup"), "event_id"]
    return e.withColumn("chapter", intervals.state_at(e, "user_id", order, state)).where("event_type = 'view'").select("event_id", "chapter")


@query("""WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + 86400000000 AS b FROM events WHERE event_type = 'signup')
SELECT s.event_id, EXISTS (SELECT 1 FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'error' AND epoch_us(p.ts) >= a AND epoch_us(p.ts) < b) AS hit FROM s""")
def range_any_between(spark, d):
    """Whether an error follows a sign-up within a day."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ranges = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("at").alias("a"), (F.col("at") + 86_400_000_000).alias("b"))
    return intervals.any_between(ranges, e.where("event_type = 'error'"), "user_id", "a", "b", "at", 86_400_000_000).select("event_id", "hit")


# --- texts ------------------------------------------------------------------------------


@query(f"""SELECT doc_id, len(w) AS n, array_to_string(list_sort(w), ' ') AS words FROM (SELECT doc_id,
  list_filter(list_distinct(regexp_extract_all(lower(text), '{tx.CONTENT_WORD.replace("'", "''")}')), lambda x: x NOT IN ({STOP})) AS w FROM documents)""")
def content_words(spark, d):
    w = read(spark, d, "documents").select("doc_id", tx.content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.array_sort("w"), " ").alias("words"))


_CW = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '{tx.CONTENT_WORD.replace(chr(39), chr(39) * 2)}')), lambda x: x NOT IN ({STOP}))"


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
w AS (SELECT conv_id, turn, role, {_CW.replace('{}', 'text')} AS c, {_CW.replace('{}', "coalesce(before, '')")} AS s FROM t)
SELECT conv_id, turn, role, round(CASE WHEN len(c) = 0 THEN 0.0 ELSE len(list_intersect(c, s)) / len(c) END, 6) AS grounding FROM w WHERE role = 'assistant'""")
def grounding_share(spark, d):
    """Share of each assistant turn's content words that the turn before holds."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    t = c.withColumn("before", before).where("role = 'assistant'")
    share = tx.share_grounded(tx.content_words(F.col("text")), tx.content_words(F.coalesce("before", F.lit(""))))
    return t.select("conv_id", "turn", "role", F.round(share, 6).alias("grounding"))


@query("SELECT o_orderkey, lower(strftime(o_orderdate, '%B %Y')) AS dates, true AS asks FROM orders")
def date_extract(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("When does it apply? From "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" on.")).alias("t"))
    return o.select("o_orderkey", F.array_join(tx.dates_in(F.col("t")), ",").alias("dates"), F.col("t").rlike(tx.ASKS_WHEN).alias("asks"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'art_' || o_custkey WHEN 1 THEN 'art_' || o_custkey || '.3' WHEN 2 THEN 'rct_' || o_custkey END AS id FROM orders""")
def citation_to_id(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    text = F.when(k == 0, F.format_string(" article %d", c)).when(k == 1, F.format_string("Article %d (3)", c)).when(k == 2, F.format_string("RECITAL %d", c)).otherwise(F.format_string("Section %d", c))
    return read(spark, d, "orders").select("o_orderkey", tx.citation_to_id(text).alias("id"))


@query(r"""SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY doc_id) AS recording FROM documents""")
def replay_lookup(spark, d):
    """The first document with the same normalised text; texts meet as digests."""
    keyed = read(spark, d, "documents").select("doc_id", F.sha2(tx.lookup_key(F.col("text")), 256).alias("k"))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("recording"))
    return skew.join_unique(keyed, first, "k").select("doc_id", "recording")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_p, len(regexp_extract_all(html, '<li>')) AS n_li, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages""")
def page_blocks(spark, d):
    p = read(spark, d, "pages").select("page_id", "url", "html")
    page = F.coalesce(F.parse_url("url", F.lit("QUERY"), F.lit("page")), F.lit(""))
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("n_p"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("n_li"), F.parse_url("url", F.lit("HOST")).alias("host"), F.when(page.rlike("^[0-9]+$"), page).otherwise("").alias("page"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, text, string_split(text, '. ') AS s FROM documents WHERE text IS NOT NULL),
points AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) || CASE WHEN generate_subscripts(s, 1) < len(s) THEN '. ' ELSE '' END AS x FROM p WHERE length(text) > 1500),
filled AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, x FROM points WHERE regexp_replace(x, '\s', '', 'g') <> ''),
many AS (SELECT doc_id FROM filled GROUP BY 1 HAVING count(*) > 1),
fold AS (SELECT doc_id, 1::BIGINT AS i, 0 AS part, length(x) AS n FROM filled JOIN many USING (doc_id) WHERE i = 1
  UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN f.n + length(t.x) > 1500 THEN f.part + 1 ELSE f.part END, CASE WHEN f.n + length(t.x) > 1500 THEN length(t.x) ELSE f.n + length(t.x) END
  FROM fold f JOIN filled t ON t.doc_id = f.doc_id AND t.i = f.i + 1),
parts AS (SELECT doc_id, part, trim(string_agg(x, '' ORDER BY i), E' \n\t\r') AS chunk FROM fold JOIN filled USING (doc_id, i) GROUP BY 1, 2
  UNION ALL SELECT doc_id, 0, text FROM p WHERE doc_id NOT IN (SELECT doc_id FROM many))
SELECT doc_id, part, length(chunk) AS n_chars, sha256(chunk) AS digest FROM parts""")
def chunk_pack(spark, d):
    """Documents cut at sentence ends and packed into parts under the character budget."""
    docs = read(spark, d, "documents").select("doc_id", F.posexplode(tx.pack_points(F.col("text"), r"(?<=\. )", 1500)).alias("part", "chunk"))
    return docs.select("doc_id", "part", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text) AS r, turn % 4 AS k FROM conversations)
SELECT conv_id, turn, role, r, k IN (0, 3) AS refused, CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS n_claims, CASE k WHEN 1 THEN '1' WHEN 2 THEN '2,1' ELSE '' END AS cited, CASE k WHEN 0 THEN 'the date' WHEN 3 THEN 'a provision of the Act that addresses the description' ELSE '' END AS missing FROM t""")
def parse_draft(spark, d):
    """Drafts written from conversation turns: refusals, cited claims and claims without a valid marker."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id", "turn", "role").orderBy("text")).alias("r"))
    k = F.col("turn") % 4
    body = F.concat(F.lit("Turn "), F.col("turn").cast("string"))
    draft = F.when(k == 0, F.concat(F.lit("refuse\n- the date [1]\n"))).when(k == 1, F.concat(body, F.lit(" holds. [1] [9]"))).when(k == 2, F.concat(body, F.lit(" [2][1][2]."))).otherwise(F.concat(body, F.lit(" [7]")))
    out = c.withColumn("p", tx.parse_draft(draft, F.lit(3)))
    cited = F.array_join(F.flatten(F.transform("p.claims", lambda x: x["cited"])), ",")
    return out.select("conv_id", "turn", "role", "r", F.col("p.refused").alias("refused"), F.size("p.claims").alias("n_claims"), cited.alias("cited"), F.array_join("p.missing", ",").alias("missing"))


def alike(spark, d):
    """Pairs of different documents that begin with the same eight words: each with the first of its group."""
    docs = read(spark, d, "documents").select("doc_id", "text").where("text is not null")
    key = F.sha2(F.lower(F.array_join(F.slice(F.split(F.trim("text"), r"\s+", 9), 1, 8), " ")), 256)
    docs = docs.withColumn("k", key)
    first = docs.groupBy("k").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    return skew.join_unique(docs, first, "k").where("text <> first.text").select("doc_id", "text", F.col("first.doc_id").alias("other"), F.col("first.text").alias("other_text"))


@query()
def lcs_diff(spark, d):
    """Word diff of each document and the first one that begins as it does."""
    out = alike(spark, d).select("doc_id", "other", compare.word_diff("other_text", "text").alias("x"))
    changed = lambda c: F.filter(c, lambda s: s["changed"])
    digest = lambda c: F.sha2(F.array_join(F.transform(changed(c), lambda s: s["text"]), "|"), 256)
    size = lambda c: F.size(changed(c))
    return out.select("doc_id", "other", size("x.before").alias("n_gone"), size("x.after").alias("n_come"), digest("x.before").alias("gone"), digest("x.after").alias("come"))


_WORDS = "regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '[A-Za-z0-9]+')"


@query(f"""WITH RECURSIVE w AS (SELECT p_partkey AS p, {_WORDS} AS after, lag({_WORDS}) OVER (ORDER BY p_partkey) AS before FROM part QUALIFY before IS NOT NULL),
x AS (SELECT p, generate_subscripts(before, 1) AS i, unnest(before) AS word FROM w), y AS (SELECT p, generate_subscripts(after, 1) AS j, unnest(after) AS word FROM w),
hit AS (SELECT x.p, i, j FROM x JOIN y ON x.p = y.p AND x.word = y.word),
way AS (SELECT p, i, j, 1 AS n FROM hit UNION SELECT h.p, h.i, h.j, n + 1 FROM way JOIN hit h ON h.p = way.p AND h.i > way.i AND h.j > way.j),
common AS (SELECT p, max(n) AS n FROM way GROUP BY p)
SELECT w.p AS p_partkey, len(before) - coalesce(n, 0) AS n_gone, len(after) - coalesce(n, 0) AS n_come FROM w LEFT JOIN common USING (p)""")
def name_diff(spark, d):
    """Word diff of what each part and the one before it are called."""
    said = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    rows = order.numbered(read(spark, d, "part").select("p_partkey", said.alias("said")), ["p_partkey"], "at")
    before = rows.select((F.col("at") + 1).alias("at"), F.col("said").alias("before"))
    changed = lambda c: F.size(F.filter(c, lambda s: s["changed"]))
    return rows.join(before, "at").select("p_partkey", compare.word_diff("before", "said").alias("x")).select("p_partkey", changed("x.before").alias("n_gone"), changed("x.after").alias("n_come"))


# --- versions, reports, captures --------------------------------------------------------


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority || '  x' AS t FROM orders WHERE o_orderkey % 5 <> 0),
b AS (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN ' y' ELSE ' x' END AS t FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' WHEN replace(a.t, '  ', ' ') <> b.t THEN 'changed' ELSE 'same' END AS status
FROM a FULL JOIN b USING (o_orderkey)""")
def version_status(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    one = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.concat("o_orderpriority", F.lit("  x")).alias("t"))
    two = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, " y").otherwise(" x")).alias("t"))
    return evaluate.version_status(one, two, "o_orderkey", "t")


@query("""SELECT 'c' || c_custkey AS unit FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'o' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey""")
def anti_chunk_units(spark, d):
    """Customers without orders stand for themselves, others are represented by their orders."""
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    alone = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.concat(F.lit("c"), "c_custkey").alias("unit"))
    return alone.unionByName(o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.concat(F.lit("o"), "o_orderkey").alias("unit")))


_FACTS = """f AS (SELECT event_type AS arm, user_id % 2 AS version, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY event_id) - 1 AS call_index,
  event_id % 11 = 0 AS failed, event_id % 7 = 0 AS refused, user_id % 3 = 0 AS expects_refusal, event_id % 10 / 10.0 AS recall, event_id % 20 / 20.0 AS reached, event_id % 4 / 4.0 AS p_nodes, event_id % 8 / 8.0 AS p_articles, user_id % 40 AS nodes,
  CASE WHEN event_id % 5 > 0 THEN event_id % 5 / 5.0 END AS faith, event_id % 3 AS on_gold, event_id % 1000 AS pt, event_id % 100 AS ct, event_id % 997 AS ms, event_id % 13 = 0 AS cut FROM events)"""


@query(f"""WITH {_FACTS} SELECT arm, version, count(*) FILTER (NOT failed) AS answered, count(*) FILTER (failed) AS failed,
 round(coalesce(avg(recall) FILTER (NOT failed), 0), 6) AS recall, round(coalesce(avg(reached) FILTER (NOT failed), 0), 6) AS recall_reached,
 round(coalesce(avg(p_nodes) FILTER (NOT failed), 0), 6) AS precision_over_nodes, round(coalesce(avg(p_articles) FILTER (NOT failed), 0), 6) AS precision_over_articles, round(coalesce(avg(nodes) FILTER (NOT failed), 0), 6) AS nodes_supplied,
 round(avg(faith) FILTER (NOT failed), 6) AS faithfulness, round(avg(recall) FILTER (NOT failed AND NOT refused), 6) AS answer_recall,
 count(*) FILTER (NOT failed AND NOT refused AND on_gold = 0) AS no_gold_answers, count(*) FILTER (NOT failed AND expects_refusal) AS refusal_questions,
 count(*) FILTER (NOT failed AND expects_refusal AND refused) AS correct_refusals, count(*) FILTER (NOT failed AND NOT expects_refusal) AS answer_questions,
 count(*) FILTER (NOT failed AND NOT expects_refusal AND refused) AS false_refusals, count(*) FILTER (NOT failed AND cut) AS truncated, coalesce(sum(pt) FILTER (NOT failed), 0)::BIGINT AS prompt_tokens,
 coalesce(sum(ct) FILTER (NOT failed), 0)::BIGINT AS completion_tokens, coalesce(sum(ms) FILTER (NOT failed), 0)::BIGINT AS duration_ms, max(ms) FILTER (NOT failed AND call_index = 0) AS first_call_ms,
 round(avg(ms) FILTER (NOT failed AND call_index > 0), 6) AS later_calls_ms,
 round(coalesce(sum(pt) FILTER (NOT failed), 0)::DOUBLE / 1e6 * 3 + coalesce(sum(ct) FILTER (NOT failed), 0)::DOUBLE / 1e6 * 15, 6) AS projected_cost
FROM f GROUP BY arm, version""")
def arm_summary(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    i, u = F.col("event_id"), F.col("user_id")
    opening = e.groupBy("event_type", (u % 2).alias("v")).agg(F.min("event_id").alias("opening"))  # a row an arm and version
    opening = opening.select(F.col("event_type").alias("of"), F.col("v").alias("at"), "opening")
    e = e.join(F.broadcast(opening), F.col("event_type").eqNullSafe(F.col("of")) & (u % 2).eqNullSafe(F.col("at")))
    # Only the first call is told apart; of several with its number, one is.
    least = i.eqNullSafe(F.col("opening"))
    turn = F.row_number().over(Window.partitionBy("of", "at").orderBy("event_id", "user_id")) - 1
    e = e.where(~least).withColumn("call_index", F.lit(1)).unionByName(e.where(least).withColumn("call_index", turn))
    facts = e.select(
        F.col("event_type").alias("arm"), (u % 2).alias("version"), "call_index", F.when(i % 11 == 0, "Timeout").alias("error"), (i % 7 == 0).alias("refused"), (u % 3 == 0).alias("expects_refusal"),
        (i % 10 / 10.0).alias("recall"), (i % 20 / 20.0).alias("recall_reached"), (i % 4 / 4.0).alias("precision_over_nodes"), (i % 8 / 8.0).alias("precision_over_articles"), (i % 10 / 10.0).alias("answer_recall"), (u % 40).alias("nodes_supplied"), F.when(i % 5 > 0, i % 5 / 5.0).alias("faithfulness"), (i % 3).alias("claims_on_gold"),
        (i % 1000).alias("prompt_tokens"), (i % 100).alias("completion_tokens"), (i % 997).alias("duration_ms"), (i % 13 == 0).alias("truncated"),
    )
    return evaluate.arm_summary(facts)


@query("""SELECT kind, expected, coalesce(found, 0) AS found FROM (VALUES ('system', 0), ('user', -1), ('assistant', -1), ('tool', 3)) e(kind, expected)
LEFT JOIN (SELECT role, count(*) AS found FROM conversations GROUP BY 1) ON role = kind WHERE expected <> coalesce(found, 0)""")
def structure_checks(spark, d):
    expected = spark.createDataFrame([("system", 0), ("user", -1), ("assistant", -1), ("tool", 3)], "kind string, expected int")
    return evaluate.structure_mismatches(read(spark, d, "conversations").select("role"), "role", expected)


@query("""SELECT arm, version, conv_id, row_number() OVER (PARTITION BY arm, version ORDER BY conv_id) - 1 AS call_index
FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('full'), ('search'), ('walk')) a(arm), (VALUES ('consolidated'), ('original')) v(version)""")
def sweep_cross(spark, d):
    """Every question under every arm and version, with its place in the sweep."""
    arms = F.array(*map(F.lit, ("full", "search", "walk")))
    versions = F.array(*map(F.lit, ("original", "consolidated")))
    q = order.numbered(read(spark, d, "conversations").select("conv_id").distinct(), ["conv_id"], "call_index")
    return q.withColumn("arm", F.explode(arms)).withColumn("version", F.explode(versions))


@query("""SELECT doc_id, quality, 'new' AS run FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, quality, 'old' FROM labels WHERE doc_id % 3 <> 0""")
def capture_upsert(spark, d):
    rows = read(spark, d, "labels").select("doc_id", "quality")
    return evaluate.upsert(rows.withColumn("run", F.lit("old")), rows.where("doc_id % 3 = 0").withColumn("run", F.lit("new")), ["doc_id"])


@query("""SELECT user_id, count(*) AS frames, max_by(event_type, (ts, event_id)) AS last_node, max_by(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_value,
  min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS finished FROM events GROUP BY user_id""")
def progress_fold(spark, d):
    """Frames folded into one progress row: the last value reported of each field wins."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    order = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("frames"), F.max_by("event_type", order).alias("last_node"),
        F.max_by("value", F.when(F.col("event_type") == "purchase", order)).alias("last_value"),
        F.unix_micros(F.min("ts")).alias("started"), F.unix_micros(F.max("ts")).alias("finished"),
    )
