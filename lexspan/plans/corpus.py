"""Registered queries on parsed pages, provisions, chunks, stores and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import arms, layout, provisions, reader, report, scoring, versions, walk
from ..sources import html, scratch, stores
from . import catalogue
from .catalogue import _CW, _EDGES, query, read

# --- pages ------------------------------------------------------------------------------

_SEEN = r"regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script.*?</script>', '<script>', 'gs'), '<style.*?</style>', '<style>', 'gs')"


@query(f"""SELECT page_id, t.tag, len(regexp_extract_all({_SEEN}, '<' || t.tag || '[ >]')) AS n FROM pages, (VALUES ('p'), ('li'), ('h1'), ('article'), ('nav'), ('div')) t(tag)
WHERE len(regexp_extract_all({_SEEN}, '<' || t.tag || '[ >]')) > 0""")
def page_elements(spark, d):
    """Elements of each page by tag, out of the flattened pages."""
    tags = F.explode(F.transform(html.flatten_html("html")["elements"], lambda e: e["tag"])).alias("tag")
    found = read(spark, d, "pages").select("page_id", tags)
    return found.where(F.col("tag").isin("p", "li", "h1", "article", "nav", "div")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(replace({_SEEN}, '<p>', chr(1) || '1. '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS w FROM pages),
whole AS (SELECT page_id, 'article' AS kind, 'Article ' || page_id || replace(w, chr(1), '') AS x FROM t UNION ALL SELECT page_id, 'paragraph', unnest(string_split(w, chr(1))[2:]) FROM t)
SELECT page_id, kind, count(*) AS n, sum(length(trim(regexp_replace(x, '\\s+', ' ', 'g'))))::BIGINT AS chars FROM whole GROUP BY 1, 2""")
def page_provisions(spark, d):
    """Pages with their lines of text as articles' paragraphs: parsed as provisions, counted by kind."""
    line = F.regexp_replace(F.col("html"), "<p>", '<p class="body">1. ')
    head = F.concat(F.lit('<p class="head">Article '), F.col("page_id").cast("string"), F.lit("</p>"))
    pages = read(spark, d, "pages").select("page_id", F.concat(head, line).alias("html"))
    markup = provisions.Markup("head", "sub", "division*", "chapter", "chapter-title", body="body")
    return provisions.parse(pages, markup, key="page_id").groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH t AS (SELECT page_id % 2 AS v, replace({_SEEN}, '<p>', chr(1)) AS w FROM pages),
n AS (SELECT CASE v WHEN 0 THEN 'original' ELSE 'consolidated' END AS version, 'article' AS kind, count(*) AS found FROM t GROUP BY 1
  UNION ALL SELECT CASE v WHEN 0 THEN 'original' ELSE 'consolidated' END, 'paragraph', sum(len(string_split(w, chr(1))) - 1)::BIGINT FROM t GROUP BY 1),
e(version, kind, expected) AS (VALUES ('consolidated', 'article', 1), ('consolidated', 'recital', 0), ('original', 'article', 2), ('original', 'chapter', 3))
SELECT e.version || ': expected ' || expected || ' ' || e.kind || ', parsed ' || coalesce(found, 0) AS message FROM e LEFT JOIN n USING (version, kind) WHERE coalesce(found, 0) <> expected
UNION ALL SELECT version || ': ' || found || ' ' || kind FROM n""")
def versions_loaded(spark, d):
    """Pages as two versions, each in a markup of its own: loaded by the registry, counted, and held against what is expected."""
    def pages(rest: int, cls: str):
        line = F.regexp_replace("html", "<p>", f'<p class="{cls}">1. ')
        head = F.concat(F.lit(f'<p class="{cls}-head">Article '), F.col("page_id").cast("string"), F.lit("</p>"))
        return lambda s: read(s, d, "pages").where(F.col("page_id") % 2 == rest).select(F.col("page_id").cast("string").alias("doc"), F.concat(head, line).alias("html"))

    markup = lambda cls: provisions.Markup(f"{cls}-head", f"{cls}-sub", f"{cls}-division*", f"{cls}-chapter", f"{cls}-chapter-title", body=cls)
    sources = [versions.Source("original", pages(0, "one"), markup("one"), {"article": 2, "chapter": 3}), versions.Source("consolidated", pages(1, "two"), markup("two"), {"article": 1, "recital": 0})]
    rows = scratch.materialize(versions.load(spark, sources).select("version", "kind"), "versions")
    counts = rows.groupBy("version", "kind").agg(F.count(F.lit(1)).alias("n"))
    told = counts.select(F.format_string("%s: %d %s", "version", "n", "kind").alias("message"))
    return provisions.counts_as_expected(rows, versions.expected(spark, sources)).unionByName(told)


# --- provisions written from documents --------------------------------------------------

_PROV = """prov AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'original' ELSE 'consolidated' END AS version, doc_id // 2 AS k, doc_id, text,
  CASE doc_id // 2 % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'recital' WHEN 3 THEN 'roman' ELSE 'article' END AS kind FROM documents),
ids AS (SELECT *, CASE kind WHEN 'article' THEN 'art_' || k WHEN 'paragraph' THEN 'art_' || (k - 1) || '.1' WHEN 'recital' THEN 'rct_' || k ELSE 'sch_' || k END AS id,
  CASE kind WHEN 'article' THEN 'Article ' || k WHEN 'paragraph' THEN 'Article ' || (k - 1) || '(1)' WHEN 'recital' THEN 'Recital ' || k ELSE 'Schedule ' || k END AS citation FROM prov)"""


def _provisions(spark, d):
    """Documents as provisions of two versions: even ids are the original, odd ones the consolidated text."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    k = F.floor(F.col("doc_id") / 2)
    kind = F.element_at(F.array(*map(F.lit, ("article", "paragraph", "recital", "roman", "article"))), (k % 5 + 1).cast("int"))
    number = F.when(kind == "paragraph", "1").otherwise(k.cast("string"))
    parent = F.when(kind == "paragraph", F.concat(F.lit("art_"), (k - 1).cast("string")))
    prefix = F.when(kind == "article", "art_").when(kind == "recital", "rct_").otherwise("sch_")
    return docs.select(
        F.when(F.col("doc_id") % 2 == 0, "original").otherwise("consolidated").alias("version"), F.col("doc_id").alias("ord"),
        F.when(kind == "paragraph", F.concat(parent, F.lit(".1"))).otherwise(F.concat(prefix, number)).alias("id"), kind.alias("kind"), number.alias("number"),
        F.when(kind == "article", F.concat(F.lit("Title "), number)).otherwise("").alias("title"), "text", parent.alias("parent_id"),
    )


_CUT = r"regexp_replace({}, '(\s)(\(\d+\)\s)', '\1' || chr(1) || '\2', 'g')"


@query(f"""WITH RECURSIVE {_PROV}, heads AS (SELECT version, k, citation || CASE WHEN kind = 'paragraph' AND EXISTS (SELECT 1 FROM ids a WHERE a.version = ids.version AND a.k = ids.k - 1) THEN ' Title ' || (k - 1) ELSE '' END AS head FROM ids),
w AS (SELECT ids.version, id, citation, kind, CASE WHEN kind IN ('paragraph', 'recital') THEN head || chr(10) || text ELSE text END AS whole
  FROM ids JOIN heads USING (version, k) WHERE NOT (kind = 'article' AND EXISTS (SELECT 1 FROM ids p WHERE p.version = ids.version AND p.kind = 'paragraph' AND p.k = ids.k + 1))),
p AS (SELECT version, id, string_split({_CUT.format(_CUT.format('whole'))}, chr(1)) AS s FROM w WHERE length(whole) > 6000),
points AS (SELECT version, id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM p),
filled AS (SELECT version, id, row_number() OVER (PARTITION BY version, id ORDER BY i) AS i, x FROM points WHERE regexp_replace(x, '\\s', '', 'g') <> ''),
many AS (SELECT version, id FROM filled GROUP BY ALL HAVING count(*) > 1),
fold AS (SELECT version, id, 1::BIGINT AS i, 0 AS part, length(x) AS n FROM filled JOIN many USING (version, id) WHERE i = 1
  UNION ALL SELECT f.version, f.id, f.i + 1, CASE WHEN f.n + length(t.x) > 6000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.n + length(t.x) > 6000 THEN length(t.x) ELSE f.n + length(t.x) END
  FROM fold f JOIN filled t ON t.version = f.version AND t.id = f.id AND t.i = f.i + 1),
parts AS (SELECT version, id, part, trim(string_agg(x, '' ORDER BY i), E' \n\t\r') AS chunk FROM fold JOIN filled USING (version, id, i) GROUP BY ALL
  UNION ALL SELECT version, id, 0, whole FROM w WHERE (version, id) NOT IN (SELECT (version, id) FROM many)),
sized AS (SELECT *, count(*) OVER (PARTITION BY version, id) AS n FROM parts)
SELECT version, CASE WHEN n = 1 THEN id ELSE id || '#' || part END AS chunk_id, citation, kind, sha256(chunk) AS digest FROM sized JOIN w USING (version, id)""")
def chunk_table(spark, d):
    """Embeddable units: articles with a paragraph stand back for it, paragraphs and recitals are headed, long texts are cut at their numbered points."""
    rows = provisions.chunks(_provisions(spark, d).where("text is not null"))
    return rows.select("version", "chunk_id", "citation", "kind", F.sha2("text", 256).alias("digest"))


_LEAKING = "text || CASE doc_id % 13 WHEN 0 THEN ' Done at Brussels' WHEN 1 THEN ' ▼M1' WHEN 2 THEN ' CHAPTER IV' WHEN 3 THEN ' SECTION 12' ELSE '' END"


@query(f"""WITH {_PROV.replace("doc_id, text,", f"doc_id, {_LEAKING} AS text,", 1)}, n AS (SELECT version, kind, count(*) AS found FROM ids GROUP BY 1, 2),
expected(version, kind, expected) AS (VALUES ('original', 'article', 1), ('consolidated', 'recital', 2), ('original', 'chapter', 0))
SELECT e.version || ': expected ' || expected || ' ' || e.kind || ', parsed ' || coalesce(found, 0) AS message FROM expected e LEFT JOIN n USING (version, kind) WHERE coalesce(found, 0) <> expected
UNION ALL SELECT version || ': ' || id || ' carries a division heading' FROM ids WHERE kind IN ('article', 'paragraph') AND regexp_matches(text, '\\b(CHAPTER\\s+[IVXLC]+|SECTION\\s+\\d+)\\b')
UNION ALL SELECT version || ': ' || id || ' carries the signature block' FROM ids WHERE kind = 'article' AND contains(text, 'Done at Brussels')
UNION ALL SELECT version || ': ' || id || ' carries a consolidation marker' FROM ids WHERE contains(text, '▼')""")
def corpus_checks(spark, d):
    """Counts and leaks that disagree with what the two versions should hold; some of their texts carry leaks."""
    rows, n = _provisions(spark, d), F.col("ord") % 13
    leak = F.when(n == 0, " Done at Brussels").when(n == 1, " ▼M1").when(n == 2, " CHAPTER IV").when(n == 3, " SECTION 12").otherwise("")
    expected = spark.createDataFrame([("original", "article", 1), ("consolidated", "recital", 2), ("original", "chapter", 0)], "version string, kind string, expected int")
    return provisions.disagreements(rows.withColumn("text", F.concat("text", leak)), expected)


@query(f"""WITH {_PROV}, c AS (SELECT *, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s+([.,;:)])', '\\1', 'g') AS t FROM ids)
SELECT a.version, a.id, CASE WHEN b.id IS NULL THEN a.citation || ' appears in the ' || a.version || ' text and not in the ' || CASE a.version WHEN 'original' THEN 'consolidated' ELSE 'original' END || ' text.'
  WHEN a.t IS DISTINCT FROM b.t THEN 'The wording of ' || a.citation || ' differs between the original and the consolidated text.' END AS note
FROM c a LEFT JOIN c b ON a.id = b.id AND a.version <> b.version""")
def change_note(spark, d):
    """What the amendment did to each provision."""
    return provisions.change_notes(_provisions(spark, d)).select("version", "id", "note")


@query("""SELECT o_orderkey, CASE WHEN p.p_partkey IS NOT NULL THEN 'art_' || o_custkey END AS provision, p.p_name AS title FROM orders LEFT JOIN part p ON p.p_partkey = o_custkey""")
def citation_lookup(spark, d):
    """Written citations resolved to the provisions they name: parts stand for articles."""
    asked = read(spark, d, "orders").select("o_orderkey", tx.citation_to_id(F.concat(F.lit("\t article  "), "o_custkey", F.lit("\n"))).alias("id"))
    known = read(spark, d, "part").select(F.concat(F.lit("art_"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(True).alias("there"))
    return asked.join(known, "id", "left").select("o_orderkey", F.when(F.col("there"), F.col("id")).alias("provision"), "title")


# --- scores -----------------------------------------------------------------------------

_TRACE = """l AS (SELECT l_orderkey AS q, 'art_' || l_partkey % 40 || CASE WHEN l_suppkey % 2 = 0 THEN '.' || l_linenumber ELSE '' END AS id, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
t AS (SELECT q, coalesce(list(id ORDER BY r) FILTER (n <= 3), []) AS searched, coalesce(list(id ORDER BY r) FILTER (n > 3), []) AS traversed, coalesce(list(id ORDER BY r) FILTER (p % 5 = 0), []) AS dropped, ['art_' || q % 40, 'art_' || (q + 7) % 40] AS gold FROM l GROUP BY q),
s AS (SELECT *, list_filter(searched || traversed, lambda x: NOT list_contains(dropped, x)) AS given FROM t),
a AS (SELECT *, list_distinct(list_transform(given, lambda x: split_part(x, '.', 1))) AS arts, list_distinct(list_transform(searched || traversed, lambda x: split_part(x, '.', 1))) AS reach FROM s)"""


def _traces(spark, d):
    """Orders as questions: the first lines were searched for, later ones walked to, some parts dropped."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    id_ = F.concat(F.lit("art_"), (F.col("l_partkey") % 40).cast("string"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("."), F.col("l_linenumber").cast("string"))).otherwise(""))
    held = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", id_.alias("id"))))
    t = l.groupBy(F.col("l_orderkey").alias("q")).agg(held.alias("h"))
    ids = lambda keep: F.transform(F.filter("h", keep), lambda x: x["id"])
    gold = F.array(*(F.concat(F.lit("art_"), ((F.col("q") + k) % 40).cast("string")) for k in (0, 7)))
    return t.select("q", ids(lambda x: x["l_linenumber"] <= 3).alias("searched"), ids(lambda x: x["l_linenumber"] > 3).alias("traversed"), ids(lambda x: x["l_partkey"] % 5 == 0).alias("dropped"), gold.alias("gold"))


@query(f"""WITH {_TRACE} SELECT q, round(len(list_intersect(gold, arts)) / len(gold), 6) AS recall, round(len(list_intersect(gold, reach)) / len(gold), 6) AS recall_reached,
  round(CASE WHEN len(given) = 0 THEN 0 ELSE len(list_filter(given, lambda x: list_contains(gold, split_part(x, '.', 1)))) / len(given) END, 6) AS precision_over_nodes,
  round(CASE WHEN len(arts) = 0 THEN 0 ELSE len(list_intersect(gold, arts)) / len(arts) END, 6) AS precision_over_articles, len(given) AS nodes_supplied, len(arts) AS articles_supplied,
  array_to_string(list_sort(list_intersect(gold, arts)), ',') AS found, array_to_string(list_sort(list_filter(gold, lambda x: NOT list_contains(arts, x))), ',') AS missed FROM a""")
def retrieval_scores(spark, d):
    s = _traces(spark, d).select("q", scoring.retrieval_score(F.col("gold"), F.col("searched"), F.col("traversed"), F.col("dropped")).alias("s")).select("q", "s.*")
    rounded = ("recall", "recall_reached", "precision_over_nodes", "precision_over_articles")
    return s.select("q", *(F.round(c, 6).alias(c) for c in rounded), "nodes_supplied", "articles_supplied", F.array_join("found", ",").alias("found"), F.array_join("missed", ",").alias("missed"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
w AS (SELECT *, {_CW.replace('{}', "coalesce(before, '')")} AS s, {_CW.replace('{}', 'text')} AS c1, {_CW.replace('{}', 'left(text, 60)')} AS c2 FROM t WHERE role = 'assistant'),
n AS (SELECT *, turn % 4 = 0 AS refused, CASE WHEN len(c1) = 0 THEN 0 ELSE len(list_intersect(c1, s)) / len(c1) END AS g1, CASE WHEN len(c2) = 0 THEN 0 ELSE len(list_intersect(c2, s)) / len(c2) END AS g2 FROM w)
SELECT conv_id, r, refused, refused = (turn % 3 = 0) AS refusal_correct, CASE WHEN NOT refused THEN round((g1 + g2) / 2, 6) END AS faithfulness, CASE WHEN refused THEN 0 ELSE 2 END AS claims,
  CASE WHEN refused THEN 0 ELSE (g1 < 0.6)::INT + (g2 < 0.6)::INT END AS ungrounded_claims, CASE WHEN refused THEN '' ELSE 'art_' || turn || '.1' END AS citations_not_supplied,
  CASE WHEN refused THEN '' ELSE array_to_string(list_sort(list_distinct(['art_' || turn, 'art_9'])), ',') END AS cited_ids, CASE WHEN refused THEN 0.0 ELSE 0.5 END::DOUBLE AS answer_recall, CASE WHEN refused THEN 0 WHEN turn = 9 THEN 2 ELSE 1 END AS claims_on_gold FROM n""")
def answer_scores(spark, d):
    """Assistant turns as answers of two claims: one cites a paragraph that was not supplied, one a supplied article."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.row_number().over(w).alias("r"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("before")).where("role = 'assistant'")
    own = F.concat(F.lit("art_"), F.col("turn").cast("string"), F.lit(".1"))
    claims = F.array(F.struct(F.col("text").alias("statement"), F.array(own).alias("cited")), F.struct(F.left("text", F.lit(60)).alias("statement"), F.array(F.lit("art_9")).alias("cited")))
    gold, given = F.array(F.lit("art_9"), F.lit("art_gold")), F.array(F.lit("art_9"))
    s = t.select("conv_id", "r", scoring.answer_score(F.col("turn") % 4 == 0, F.col("turn") % 3 == 0, claims, gold, given, F.col("before")).alias("s")).select("conv_id", "r", "s.*")
    return s.withColumn("faithfulness", F.round("faithfulness", 6)).withColumn("citations_not_supplied", F.array_join("citations_not_supplied", ",")).withColumn("cited_ids", F.array_join("cited_ids", ","))


@query("""WITH l AS (SELECT l_orderkey AS q, 'art_' || l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
first AS (SELECT q, id, min(i) AS i, bool_or(i <= 2) AS named FROM l GROUP BY 1, 2)
SELECT l.q, sha256(string_agg('[' || l.i || '] Article ' || substr(l.id, 5) || chr(10) || 'Text of ' || l.id, chr(10) || chr(10) ORDER BY l.i)) AS prompt,
  (SELECT coalesce(string_agg(id, ',' ORDER BY i), '') FROM first f WHERE f.q = l.q AND NOT named) AS uncited FROM l GROUP BY l.q""")
def prompt_blocks(spark, d):
    """Each order's lines as a numbered prompt, and those that a draft naming the first two left out."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    held = l.groupBy(F.col("l_orderkey").alias("q")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("h"))
    ids = F.transform("h", lambda x: F.concat(F.lit("art_"), x["l_partkey"].cast("string")))
    items = F.transform(ids, lambda x: F.struct(F.concat(F.lit("Article "), F.substring(x, 5, 20)).alias("citation"), F.concat(F.lit("Text of "), x).alias("text")))
    return held.select("q", F.sha2(scoring.prompt_block(items), 256).alias("prompt"), F.array_join(scoring.uncited(F.lit("One [1] and\nREFUSE [2][99]"), ids), ",").alias("uncited"))


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text) AS r, turn % 6 AS k FROM conversations)
SELECT conv_id, turn, role, r, k NOT IN (2, 3) AS refused, CASE k WHEN 0 THEN 'The retrieved provisions do not settle the question.' WHEN 1 THEN 'The retrieved provisions do not settle the question.'
  WHEN 4 THEN 'The model produced no statement resting on a retrieved provision.' WHEN 5 THEN 'Generation stopped before any statement was finished, rather than the text leaving nothing to cite.' END AS reason,
  CASE k WHEN 0 THEN 'the date.|the place' WHEN 1 THEN 'what the text leaves open' WHEN 4 THEN 'a provision of the Act that addresses the description' WHEN 5 THEN 'the rest of the draft, cut off before it named a provision' ELSE '' END AS missing,
  CASE k WHEN 2 THEN 'It holds|So be it' WHEN 3 THEN 'Turn ' || turn ELSE '' END AS statements, CASE k WHEN 2 THEN '2,1' WHEN 3 THEN '3' ELSE '' END AS cited FROM t""")
def refusal_records(spark, d):
    """Drafts of every shape: declared refusals with and without what is missing, claims, nothing cited, and cut off."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id", "turn", "role").orderBy("text")).alias("r"))
    k = F.col("turn") % 6
    draft = (
        F.when(k == 0, "One [1].\r\n  refuse: no\r\n- the date. [2]\r\n\t-- the place\r\n\r\n").when(k == 1, "REFUSE").when(k == 2, "- It holds. [2][9][2]\n\n...[1]\nSo be it. [1]")
        .when(k == 3, F.concat(F.lit("no marker here\nTurn "), F.col("turn").cast("string"), F.lit(" [3] [0].")))
    ).otherwise("Nothing is cited [7].")
    p = c.withColumn("p", tx.parse_draft(draft, F.lit(3), k == 5))
    flat = lambda f: F.flatten(F.transform("p.claims", f))
    return p.select(
        "conv_id", "turn", "role", "r", "p.refused", "p.reason", F.array_join("p.missing", "|").alias("missing"),
        F.array_join(F.transform("p.claims", lambda x: x["statement"]), "|").alias("statements"), F.array_join(flat(lambda x: x["cited"]), ",").alias("cited"),
    )


# --- stores and frames ------------------------------------------------------------------


@query("""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'original' ELSE 'consolidated' END AS version, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS written,
  round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: i * x * CASE WHEN vec_id % 2 = 0 THEN -1 ELSE 1 END)), 6) AS reading FROM embeddings""")
def index_rewrite(spark, d):
    """The vector index written for both versions, then one rewritten with its vectors turned round: the other stays as it was."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, "original").otherwise("consolidated").alias("version"))
    path = scratch.scratch_path(spark, "index")
    stores.write_versions(v.withColumn("written", F.lit(1)), path)
    turned = v.where("version = 'original'").withColumn("embedding", F.transform("embedding", lambda x: -x))
    stores.write_versions(turned.withColumn("written", F.lit(2)), path)
    both = [stores.read_version(spark, path, name) for name in ("original", "consolidated")]
    weighed = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return both[0].unionByName(both[1]).select("vec_id", "version", "written", F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 6).alias("reading"))


@query("""SELECT event_id, r.run, event_type AS arm, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 7 END, 0) AS claims_on_gold FROM events, (VALUES ('current'), ('v1.0-first')) r(run) WHERE event_id % 2 = 0 OR r.run = 'current'""")
def run_results(spark, d):
    """Results appended arm by arm, the even ones to a labelled copy too; older rows lack a field and get its default."""
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("arm"))
    path = scratch.scratch_path(spark, "results")
    full = e.withColumn("claims_on_gold", (F.col("event_id") % 7).cast("int"))
    stores.append_results(full.where("event_id % 3 = 0 and event_id % 2 = 0"), path, "v1.0-first")
    stores.append_results(e.where("event_id % 3 <> 0 and event_id % 2 = 0"), path, "v1.0-first")
    stores.append_results(full.where("event_id % 3 = 0 and event_id % 2 = 1"), path)
    stores.append_results(e.where("event_id % 3 <> 0 and event_id % 2 = 1"), path)
    from pyspark.sql import types as T

    schema = T.StructType().add("event_id", "long").add("arm", "string").add("claims_on_gold", "integer")
    runs = [stores.read_results(spark, path, schema, {"claims_on_gold": 0}, run).withColumn("run", F.lit(run)) for run in ("current", "v1.0-first")]
    return runs[0].unionByName(runs[1]).select("event_id", "run", "arm", "claims_on_gold")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 'new' ELSE 'old' END AS run, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 1 - quality ELSE quality END AS quality FROM labels""")
def capture_merge(spark, d):
    """Captures merged by key into their table; failed ones change nothing."""
    rows = read(spark, d, "labels").select("doc_id", "quality").withColumn("error", F.lit(None).cast("string"))
    path = scratch.scratch_path(spark, "captures")
    stores.capture(rows.withColumn("run", F.lit("old")), path, ["doc_id"])
    new = rows.where("doc_id % 4 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 8 == 0, "Timeout").alias("error"), F.lit("new").alias("run"))
    return stores.capture(new, path, ["doc_id"]).select("doc_id", "run", "quality")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations),
f AS (SELECT conv_id, count(*) AS frames, count(*) FILTER (turn % 3 = 0 AND NOT (conv_id % 5 = 4 AND turn = 1)) AS with_ids, min(place) FILTER (conv_id % 5 = 4 AND turn = 1) AS broken FROM c GROUP BY conv_id)
SELECT conv_id AS stream, frames, with_ids, coalesce(broken, frames) AS delivered,
  CASE WHEN broken IS NOT NULL THEN 'failed' WHEN conv_id % 3 = 0 THEN 'answered' WHEN conv_id % 3 = 1 THEN 'error' ELSE 'failed' END AS state FROM f""")
def frames_read(spark, d):
    """Turns written as event streams and read back: absent fields stay absent, a stream that just ends has failed, and so has one at its first unreadable frame."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    ids = F.when(F.col("turn") % 3 == 0, F.array(F.concat(F.lit("art_"), F.col("turn").cast("string"))))
    node = stores.frame("node", F.struct(F.col("role").alias("node"), ids.alias("searched_ids")))
    # Some frames break off, some are of an event that nobody knows.
    broken = F.when(F.col("conv_id") % 2 == 0, "event: node\ndata: {\"node\": \n\n").otherwise("event: other\ndata: {}\n\n")
    node = F.when((F.col("conv_id") % 5 == 4) & (F.col("turn") == 1), broken).otherwise(node)
    text = c.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "role", "text", node.alias("f")))).getField("f"), "").alias("body"))
    last = F.when(F.col("conv_id") % 3 == 0, "event: answer\ndata: {}\n\n").when(F.col("conv_id") % 3 == 1, "event: error\ndata: {}\n\n").otherwise("")
    frames = stores.read_frames(text.withColumn("body", F.concat("body", last)), "conv_id", "body", "node string, searched_ids array<string>")
    frames = scratch.materialize(frames, "frames")
    counts = frames.where("event not in ('answer', 'error')").groupBy("conv_id").agg(F.count(F.lit(1)).alias("frames"), F.count("body.searched_ids").alias("with_ids"))
    return counts.join(stores.stream_state(frames, "conv_id"), "conv_id").select(F.col("conv_id").alias("stream"), "frames", "with_ids", F.col("nodes").alias("delivered"), "state")


# --- reading ----------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'q' || lpad((o_orderkey % 90 + 10)::VARCHAR, 2, '0') || '-x' END AS question, CASE WHEN o_orderkey % 2 = 0 THEN 'original' END AS version,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'art_' || o_custkey END AS provision,
  CASE WHEN o_orderkey % 3 <> 0 THEN '/ask?q=q' || lpad((o_orderkey % 90 + 10)::VARCHAR, 2, '0') || '-x' || CASE WHEN o_orderkey % 2 = 0 THEN '&v=original' ELSE '' END || CASE WHEN o_orderkey % 5 <> 0 THEN '&p=art_' || o_custkey ELSE '' END END AS forwarded FROM orders""")
def address_read(spark, d):
    """Addresses written from orders, some fields mangled; each field is read on its own."""
    o, k = read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey")
    q = F.when(k % 3 == 0, "Q1").otherwise(F.format_string("q%02d-x", k % 90 + 10))
    v, p = F.when(k % 2 == 0, "original").otherwise("other"), F.when(k % 5 == 0, "bad-1").otherwise(F.concat(F.lit("art_"), "o_custkey"))
    a = o.select("o_orderkey", reader.read_address(F.concat(F.lit("https://x.org/a?q="), q, F.lit("&v="), v, F.lit("&p="), p)).alias("a"))
    return a.select("o_orderkey", "a.*", reader.forwarded(F.col("a")).alias("forwarded"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Article ' || p_partkey || '(2)' WHEN 1 THEN 'Schedule ' || p_partkey WHEN 2 THEN 'Recital ' || p_partkey ELSE 'given ' || p_partkey END AS label,
  'https://x.org/doc' || CASE p_partkey % 4 WHEN 0 THEN '#art_' || p_partkey WHEN 1 THEN '#sch_' || p_partkey WHEN 2 THEN '#rct_' || p_partkey ELSE '' END AS address,
  CASE p_partkey % 4 WHEN 0 THEN p_partkey % 100 = 4 WHEN 2 THEN p_partkey = 4 ELSE false END AND p_partkey = 4 AS bare, p_partkey % 4 = 0 AS kind_prefix,
  'art_' || p_partkey || 'b' AS jump, 'q' || p_partkey || 'Original' AS name, regexp_replace(reverse(regexp_replace(reverse((p_partkey * 1000)::VARCHAR), '([0-9]{3})', '\\1 ', 'g')), '^ ', '') AS grouped FROM part""")
def reader_labels(spark, d):
    """Labels, source addresses, filters, jumps and names of parts that stand for provisions."""
    p, k = read(spark, d, "part").select("p_partkey"), F.col("p_partkey")
    s = k.cast("string")
    id_ = F.when(k % 4 == 0, F.concat(F.lit("art_"), s, F.lit(".2"))).when(k % 4 == 1, F.concat(F.lit("sch_"), s)).when(k % 4 == 2, F.concat(F.lit("rct_"), s)).otherwise(F.concat(F.lit("chp_"), s))
    label = reader.citation_label(F.when(k % 4 == 3, F.concat(F.lit("given "), s)), id_)
    return p.select(
        "p_partkey", label.alias("label"), reader.source_address(F.lit("https://x.org/doc"), id_).alias("address"), reader.matches_filter(label, F.lit(" 4 ")).alias("bare"),
        reader.matches_filter(label, F.concat(F.lit("ARTICLE  "), s, F.lit("("))).alias("kind_prefix"), reader.jump_target(F.concat(F.lit(" "), s, F.lit("B "))).alias("jump"),
        reader.identifier(F.concat(F.lit("q"), s), F.lit("original")).alias("name"), reader.grouped_number(k * 1000).alias("grouped"),
    )


@query("""WITH m AS (SELECT doc_id // 3 AS question, CASE WHEN doc_id % 2 = 0 THEN 'original' ELSE 'consolidated' END AS version, doc_id AS ord, toxic = 1 AS refused FROM labels),
q AS (SELECT question, min(ord) AS first, arg_min(refused, ord) FILTER (version = 'original') AS o, arg_min(refused, ord) FILTER (version = 'consolidated') AS c FROM m GROUP BY 1),
w AS (SELECT *, CASE WHEN o THEN 'refused' WHEN NOT o THEN 'answered' ELSE 'not recorded' END AS so, CASE WHEN c THEN 'refused' WHEN NOT c THEN 'answered' ELSE 'not recorded' END AS sc FROM q)
SELECT question, 'd' || first AS description, CASE WHEN o = c THEN CASE WHEN o THEN 'Refused on both texts' ELSE 'Answered on both texts' END ELSE upper(left(so, 1)) || substr(so, 2) || ' on the original, ' || sc || ' on the amended' END AS outcome FROM w""")
def recorded_outcomes(spark, d):
    """Labels as recordings of questions: the first of each question, and how it went on both texts in words."""
    m = read(spark, d, "labels").select(
        F.floor(F.col("doc_id") / 3).alias("question"), F.when(F.col("doc_id") % 2 == 0, "original").otherwise("consolidated").alias("version"), F.col("doc_id").alias("ord"),
        (F.col("toxic") == 1).alias("refused"), F.concat(F.lit("d"), "doc_id").alias("description"),
    )
    return reader.recorded_questions(m).select("question", "description", reader.outcome_line(F.col("original"), F.col("consolidated")).alias("outcome"))


@query("""WITH m AS (SELECT doc_id % 50 AS question, quality AS version, arg_min('2026-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0'), doc_id) AS stamp FROM labels WHERE doc_id % 50 < 40 GROUP BY 1, 2),
latest AS (SELECT max('2026-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0')) AS l FROM labels WHERE doc_id % 50 < 40)
SELECT doc_id, coalesce(stamp, l) AS captured_on FROM labels CROSS JOIN latest LEFT JOIN m ON question = doc_id % 50 AND version = quality""")
def capture_dates(spark, d):
    """When each pair was captured, else the latest capture of all."""
    rows = read(spark, d, "labels").select("doc_id", (F.col("doc_id") % 50).alias("question"), F.col("quality").alias("version"))
    manifest = rows.where("question < 40").select("question", "version", F.col("doc_id").alias("ord"), F.format_string("2026-01-%02d", F.col("doc_id") % 28 + 1).alias("captured_at"))
    return reader.captured_on(rows, manifest).select("doc_id", "captured_on")


@query("""WITH l AS (SELECT l_orderkey AS g, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem),
h AS (SELECT g, ord, ord - 1 AS place FROM l WHERE ord <= 2), n AS (SELECT g, count(*) FILTER (ord > 2) AS under FROM l GROUP BY 1)
SELECT h.g, place, CASE WHEN h.ord = 1 AND under > 0 THEN under ELSE 1 END AS blocks, h.ord = 1 AND under > 0 AS has_paragraphs, lag('h' || h.ord) OVER (PARTITION BY h.g ORDER BY place) AS previous,
  lead('h' || h.ord) OVER (PARTITION BY h.g ORDER BY place) AS next FROM h JOIN n USING (g)""")
def section_steps(spark, d):
    """Lines of an order as sections: the first two are headings, the others paragraphs of the first."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), "l_linenumber", "l_partkey", "l_suppkey")
    place = F.row_number().over(Window.partitionBy("g").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    p = l.select("g", place.alias("ord")).withColumn("id", F.concat(F.when(F.col("ord") <= 2, "h").otherwise("p"), F.col("ord").cast("string")))
    p = p.withColumn("kind", F.when(F.col("ord") <= 2, "article").otherwise("paragraph")).withColumn("parent_id", F.when(F.col("ord") > 2, "h1"))
    found = reader.sections(p, "g").withColumn("blocks", F.size("blocks"))
    return reader.stepped(found, "g", "place", "id").drop("id")


@query("""SELECT event_id, 5 + (event_id % 4 = 0)::INT AS frames, round(event_id % 997 / 5 / 3 + 40 * 2, 6) AS walked_at, round(event_id % 997 / 5, 6) AS ends_at,
  CASE event_id % 3 WHEN 0 THEN 'running,pending,pending,pending,pending' WHEN 1 THEN 'done,running,pending,pending,pending' ELSE 'done,done,done,done,done' END AS states,
  CASE event_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 900 ELSE 100 END AS elapsed FROM events""")
def playback_steps(spark, d):
    """Recordings' schedules, and the states of runs that are at their first step, at their second, or done."""
    e, i = read(spark, d, "events").select("event_id"), F.col("event_id")
    played = reader.playback(i % 997, i % 4 == 0)
    none = F.create_map().cast("map<string,bigint>")
    full = F.create_map(*(x for n, s in enumerate(reader.STEPS) for x in (F.lit(s), F.lit(100 * (n + 1)).cast("long"))))
    finished = F.when(i % 3 == 0, none).when(i % 3 == 1, F.map_filter(full, lambda k, v: k == "route")).otherwise(full)
    steps = reader.step_states(F.lit(0).cast("long"), finished, F.lit(1000).cast("long"))
    got = e.select("event_id", played.alias("p"), steps.alias("s"), F.when(i % 3 == 1, 1).otherwise(0).alias("k"))
    return got.select(
        "event_id", F.size("p").alias("frames"), F.round(F.col("p")[2]["at_ms"], 6).alias("walked_at"), F.round(F.element_at("p", -1)["at_ms"], 6).alias("ends_at"),
        F.array_join(F.transform("s", lambda x: x["state"]), ",").alias("states"), F.try_element_at("s", F.col("k") + 1)["elapsed_ms"].alias("elapsed"),
    )


@query("""WITH l AS (SELECT l_orderkey AS q, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
SELECT q, r AS reveal, 'n' || r AS id, CASE r WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE least(r - 2, 4) END AS hop,
  CASE WHEN r > 5 THEN 'n' || r || ',' ELSE '' END || array_to_string(list_reverse(list_transform(range(1, least(r, 5) + 1), lambda x: 'n' || x)), ',') AS path,
  'Search found 1 provision.' || CASE WHEN m = 1 THEN ' The walk reached nothing beyond them.' ELSE ' The walk lifted 1 of them to its whole article and followed references to ' || m - 2 || ' more.' END || ' All ' || m || ' reached fit the prompt.' AS said FROM l""")
def walk_layout(spark, d):
    """Lines of an order as a chain of references, the second one the holder of the first, all after the fifth named by that: laid out, revealed and told."""
    l = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.count(F.lit(1)).cast("int").alias("m"))
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    later = F.when(F.col("m") > 1, F.sequence(F.lit(2), F.col("m"))).otherwise(F.array().cast("array<int>"))
    edges = F.transform(later, lambda x: F.struct(node(F.least(x - 1, F.lit(5))).alias("source"), node(x).alias("target"), F.least(x - 2, F.lit(4)).alias("hop")))
    walks = l.select("query_id", "m", F.array(F.lit("n1")).alias("searched"), F.transform(later, node).alias("traversed"), edges.alias("edges"))
    rows = layout.reveal_order(layout.walk_rows(walks))
    told = walks.select("query_id", layout.summary(F.lit(1), F.size("traversed"), F.when(F.col("m") > 1, 1).otherwise(0), F.lit(0)).alias("said"))
    found = rows.join(told, "query_id")
    return found.select(F.col("query_id").alias("q"), "reveal", "id", "hop", F.array_join("path", ",").alias("path"), "said")


@query("""WITH l AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
SELECT q, r, CASE WHEN r % 2 = 1 THEN CASE WHEN r > 2 THEN 'n' || r - 2 END ELSE 'n' || m - 1 + m % 2 END AS previous,
  CASE WHEN r % 2 = 1 THEN CASE WHEN r + 2 <= m THEN 'n' || r + 2 END ELSE 'n1' END AS next FROM l""")
def cited_section_steps(spark, d):
    """Lines of an order as sections of which the odd ones are cited: where a step among the cited lands from each."""
    l = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.count(F.lit(1)).cast("int").alias("m"))
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    every = F.sequence(F.lit(1), "m")
    cited = F.transform(F.filter(every, lambda i: i % 2 == 1), node)
    rows = l.select("q", cited.alias("cited"), F.explode(every).alias("r"))
    return rows.select("q", "r", reader.cited_steps(node(F.col("r")), F.col("cited")).alias("s")).select("q", "r", "s.*")


# --- arms -------------------------------------------------------------------------------


@query("""WITH q AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id), a AS (SELECT conv_id, said, arm, conv_id % 7 = 0 AND arm <> 'full' AS failed FROM q, (VALUES ('full'), ('search'), ('walk')) a(arm))
SELECT arm, count(*) AS runs, count(*) FILTER (failed) AS failures, sum(CASE WHEN NOT failed THEN length(arm || ' ' || conv_id || ' ' || said) END)::BIGINT AS prompt_tokens, max(CASE WHEN failed THEN 'TimeoutError: slow' END) AS error FROM a GROUP BY arm""")
def arm_runs(spark, d):
    """Every question under three arms with a scripted generator; what it fails on is a row, not the end of the run."""
    def scripted(prompt: str) -> tuple[str, int, int]:
        arm, conv, _ = prompt.split(" ", 2)
        if int(conv) % 7 == 0 and arm != "full":
            raise TimeoutError("slow")
        return f"answer to {conv}", len(prompt), 3

    names = F.explode(F.array(*map(F.lit, ("full", "search", "walk"))))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    prompts = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), " ").alias("said")).withColumn("arm", names)
    call = F.concat_ws(" ", "arm", F.col("conv_id").cast("string"))
    prompts = prompts.select(call.alias("call"), F.concat_ws(" ", call, "said").alias("prompt"))
    got = arms.generate(prompts, "call", scripted).withColumn("arm", F.substring_index("call", " ", 1))
    return got.groupBy("arm").agg(F.count(F.lit(1)).alias("runs"), F.count("error").alias("failures"), F.sum("prompt_tokens").alias("prompt_tokens"), F.max("error").alias("error"))


@query(f"""WITH {_PROV}, b AS (SELECT version, doc_id, row_number() OVER w AS i, citation || chr(10) || text AS block, sum(length(text) + length(citation) + 8) OVER (w ROWS UNBOUNDED PRECEDING) AS run
  FROM ids WHERE kind <> 'paragraph' WINDOW w AS (PARTITION BY version ORDER BY doc_id, id)),
v AS (SELECT version, count(*) FILTER (run <= 300000 OR i = 1) AS supplied, count(*) FILTER (NOT (run <= 300000 OR i = 1)) AS dropped,
  string_agg('[' || i || '] ' || block, chr(10) || chr(10) ORDER BY i) FILTER (run <= 300000 OR i = 1) AS prompt FROM b GROUP BY version)
SELECT o_orderkey AS question, version, sha256(prompt) AS prompt_key, supplied, dropped, length(prompt) AS chars FROM orders, v""")
def full_context_arm(spark, d):
    """The arm that hands over a version as far as 300,000 characters go, for every order as a question: the prompt's digest and size."""
    p = _provisions(spark, d)
    p = p.withColumn("citation", tx.citation(F.col("kind"), F.col("number"), F.col("parent_id")))
    questions = read(spark, d, "orders").select(F.col("o_orderkey").alias("question")).withColumn("version", F.explode(F.array(F.lit("original"), F.lit("consolidated"))))
    asked, prompts = arms.full_context(questions, p, 300_000)
    return asked.join(prompts.select("prompt_key", F.length("prompt").alias("chars")), "prompt_key").select("question", "version", "prompt_key", "supplied", "dropped", "chars")


@query("""SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, 'a', '')) AS n_a, text LIKE '%e' AS failed_first FROM documents""")
def embedded_texts(spark, d):
    """Documents embedded in calls of 16 by a scripted model that answers in any order: calls that fail at first are made good by a second run."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    path = scratch.scratch_path(spark, "vectors")

    def scripted(texts):
        vectors = [(i, [float(len(t)), float(t.count("a"))]) for i, t in enumerate(texts)]
        return sorted(vectors, key=lambda v: v[1]), sum(map(len, texts)) // 4

    def moody(texts):
        if any(t.endswith("e") for t in texts):
            raise TimeoutError("slow")
        return scripted(texts)

    _, failures = arms.embed_missing(docs, "doc_id", moody, path, size=1)
    vectors, none = arms.embed_missing(docs, "doc_id", scripted, path)
    if not none.isEmpty():
        raise RuntimeError("the second run failed too")
    sure = lambda i: F.col("vector")[i].cast("long")
    marked = vectors.join(failures.select("doc_id", F.lit(True).alias("failed_first")), "doc_id", "left")
    return marked.select("doc_id", sure(0).alias("n_chars"), sure(1).alias("n_a"), F.coalesce("failed_first", F.lit(False)).alias("failed_first"))


@query(f"""SELECT version, count(*) AS chunks, count(DISTINCT split_part(chunk_id, '#', 1)) AS provisions FROM ({catalogue.SQL["chunk_table"]}) GROUP BY version""")
def chunk_coverage(spark, d):
    """Chunks of each version, and the provisions that they cover."""
    return report.covered(provisions.chunks(_provisions(spark, d).where("text is not null")))


@query("""SELECT quality AS version, count(*) FILTER (doc_id % 9 <> 0) AS captures, count(*) FILTER (doc_id % 9 <> 0 AND toxic = 1) AS refused, count(*) FILTER (doc_id % 9 = 0) AS failed FROM labels GROUP BY quality""")
def capture_run(spark, d):
    """Labels as a capture run: how many were captured, refused and failed by version."""
    rows = read(spark, d, "labels").select(F.col("quality").alias("version"), (F.col("toxic") == 1).alias("refused"), F.when(F.col("doc_id") % 9 == 0, "Timeout").alias("error"))
    return report.capture_counts(rows)


@query("""SELECT 'q' || item_id AS question, v.version, unnest(CASE v.version WHEN 'original' THEN ['art_' || item_id] ELSE ['art_' || item_id, 'art_' || (item_id + 1)] END) AS root, sha256(text) AS digest, item_id % 5 = 0 AS expects_refusal
FROM benchmark, (VALUES ('original'), ('consolidated')) v(version)""")
def question_set(spark, d):
    """Benchmark items as a question set, written and read back: the gold of each version, row by row."""
    b, path = read(spark, d, "benchmark"), scratch.scratch_path(spark, "questions")
    art = lambda k: F.concat(F.lit("art_"), (F.col("item_id") + k).cast("string"))
    gold = F.create_map(F.lit("original"), F.array(art(0)), F.lit("consolidated"), F.array(art(0), art(1)))
    rows = b.select(F.concat(F.lit("q"), "item_id").alias("id"), F.col("text").alias("description"), F.lit("ask").alias("flow"), gold.alias("gold"), (F.col("item_id") % 5 == 0).alias("expects_refusal"))
    stores.write_questions(rows, path)
    asked = stores.read_questions(spark, path).withColumnRenamed("id", "question")
    told = asked.select("question", F.sha2("description", 256).alias("digest"), "expects_refusal")
    return report.gold_rows(asked).select("question", "version", F.explode("gold").alias("root")).join(told, "question")


# --- reports ----------------------------------------------------------------------------

_SUMMARY = catalogue.SQL["arm_summary"]


@query(f"""WITH s AS (SELECT * FROM ({_SUMMARY}))
SELECT arm, version, '| ' || arm || ' | ' || version || ' | ' || prompt_tokens || ' | ' || completion_tokens || ' | ' || printf('%.1f s', duration_ms / 1000) || ' | ' || coalesce(printf('%.1f s', first_call_ms / 1000), 'failed') || ' | ' ||
  coalesce(printf('%.1f s', later_calls_ms / 1000), 'one call only') || ' | $0.00 | $' || printf('%.2f', projected_cost) || ' |' AS cost,
  '| ' || arm || ' | ' || version || ' | ' || answered || ' | ' || failed || ' | ' || printf('%.2f', recall) || ' | ' || printf('%.2f', recall_reached) || ' | ' || printf('%.3f', precision_over_nodes) || ' | ' || printf('%.3f', precision_over_articles) || ' | ' ||
  printf('%.1f', nodes_supplied) || ' | ' || coalesce(printf('%.2f', faithfulness), 'not scored') || ' | ' || coalesce(printf('%.2f', answer_recall), 'not scored') || ' | ' || no_gold_answers || ' | ' || correct_refusals || '/' || refusal_questions || ' | ' || false_refusals || '/' || answer_questions || ' | ' || truncated || ' |' AS accuracy, 'abc1234' AS "commit" FROM s""")
def report_tables(spark, d):
    """The lines of the cost and the accuracy table of the arm summary, stamped."""
    s = catalogue.QUERIES["arm_summary"](spark, d)
    rows = s.select("arm", "version", report.cost_line().alias("cost"), report.accuracy_line().alias("accuracy"))
    return report.stamped(rows, "abc1234", "2026-01-01").drop("captured_at")


@query("""WITH e AS (SELECT *, event_id % 9 = 0 AS failed FROM events)
SELECT event_id AS question, event_type AS arm, user_id % 2 AS version, '| ' || event_id || ' | ask | ' || event_type || ' | ' || user_id % 2 || ' | ' || CASE WHEN failed THEN 'failed | failed | failed | failed | ' || printf('%.1f s', floor((event_id % 997 + 50) / 100) / 10) || ' | Timeout'
  ELSE printf('%.2f', event_id % 5 / 4) || ' | ' || CASE WHEN event_id % 4 = 0 THEN 'not scored' ELSE printf('%.2f', event_id % 4 / 4) END || ' | ' || CASE WHEN event_id % 7 = 0 THEN 'yes' ELSE 'no' END || ' | ' || CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'no' END || ' | ' ||
  printf('%.1f s', floor((event_id % 997 + 50) / 100) / 10) || ' | ' || CASE event_id % 3 WHEN 0 THEN 'nothing' WHEN 1 THEN 'art_1' ELSE 'art_1, art_2' END END || ' |' AS line FROM e""")
def question_table(spark, d):
    """Events as results, as the lines of the question table."""
    e, i = read(spark, d, "events").select("event_id", "event_type", "user_id"), F.col("event_id")
    rows = e.select(
        i.alias("question"), F.lit("ask").alias("flow"), F.col("event_type").alias("arm"), (F.col("user_id") % 2).alias("version"), (i % 5 / 4).alias("recall"), F.when(i % 4 != 0, i % 4 / 4).alias("faithfulness"),
        (i % 7 == 0).alias("refused"), (i % 3 == 0).alias("refusal_correct"), (i % 997).alias("duration_ms"), F.slice(F.array(F.lit("art_1"), F.lit("art_2")), 1, (i % 3).cast("int")).alias("missed"), F.when(i % 9 == 0, "Timeout").alias("error"),
    )
    return report.question_lines(rows)


@query(f"""SELECT version, depth, '| ' || version || ' | ' || depth || ' | ' || questions || ' | ' || printf('%.2f', recall) || ' | ' || printf('%.1f', nodes) || ' | ' || printf('%.1f', articles) || ' |' AS line FROM ({catalogue.SQL["depth_sensitivity"]})""")
def depth_table(spark, d):
    """The lines of the sensitivity table."""
    return report.depth_lines(catalogue.QUERIES["depth_sensitivity"](spark, d))


@query(f"""SELECT 'abc1234' AS "commit", '2026-01-01' AS captured_at, 'small' AS generator, * FROM ({_SUMMARY})""")
def summary_file(spark, d):
    """The arm summary, stamped, written as a file and read back."""
    path = scratch.scratch_path(spark, "summary")
    rows = report.stamped(catalogue.QUERIES["arm_summary"](spark, d), "abc1234", "2026-01-01", generator="small")
    stores.write_summary(rows, path)
    return stores.read_summary(spark, path, rows.schema)


@query(f"""WITH {_TRACE}, f AS (SELECT *, q % 11 = 0 AS failed, q % 4 = 0 AS refused FROM a WHERE q % 3 <> 0)
SELECT q AS question, CASE WHEN failed THEN 'Timeout' END AS error, CASE WHEN NOT failed THEN round(len(list_intersect(gold, arts)) / len(gold), 6) END AS recall, CASE WHEN NOT failed THEN refused END AS refused,
  CASE WHEN NOT failed AND NOT refused THEN 0.0::DOUBLE END AS faithfulness, CASE WHEN NOT failed THEN CASE WHEN refused THEN 0 ELSE 1 END END AS claims_on_gold FROM f""")
def flat_results(spark, d):
    """Traces as answers of one claim on gold that nothing supports, joined with the questions that are known; failures without scores."""
    q = F.col("q")
    t = _traces(spark, d).withColumnRenamed("q", "question")
    questions = _traces(spark, d).where(q % 3 != 0).select(q.alias("question"), F.lit(False).alias("expects_refusal"))
    claims = F.array(F.struct(F.lit("nothing supports this").alias("statement"), F.slice("gold", 1, 1).alias("cited")))
    k = F.col("question")
    rows = report.known_questions(t, questions).withColumn("version", F.lit("v")).withColumn("arm", F.lit("a")).withColumn("refused", k % 4 == 0).withColumn("claims", claims)
    rows = rows.withColumn("given_text", F.lit("")).withColumn("error", F.when(k % 11 == 0, "Timeout"))
    return report.flat_results(rows).select("question", "error", F.round("recall", 6).alias("recall"), "refused", "faithfulness", "claims_on_gold")


@query(f"""WITH {_EDGES}, n AS (SELECT count(DISTINCT p_partkey) AS nodes FROM part) SELECT nodes, count(*) AS edges, count(DISTINCT s) AS sources FROM e, n GROUP BY nodes""")
def graph_counts(spark, d):
    return report.graph_counts(catalogue._edges(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("id")))


@query(f"""WITH {_PROV}, src AS (SELECT version, id, k FROM ids WHERE kind IN ('article', 'roman', 'recital'))
SELECT DISTINCT s.version || ':' || s.id AS source_id, t.id AS target_id, 'Articles ' || (s.k + 1) || ', ' || (s.k + 2) || ' and ' || (s.k + 4) AS phrase
FROM src s JOIN (SELECT DISTINCT id, k FROM ids WHERE kind = 'article') t ON t.k IN (s.k + 1, s.k + 2, s.k + 4)""")
def cited_edges(spark, d):
    """References of articles, recitals and schedules, with the phrase that names each; paragraphs are no sources."""
    k = F.regexp_extract(F.col("id"), r"(\d+)", 1).cast("long")
    p = _provisions(spark, d)
    text = F.concat(F.lit("As Articles "), (k + 1).cast("string"), F.lit(", "), (k + 2).cast("string"), F.lit(" and "), (k + 4).cast("string"), F.lit(" say, and Articles 1 to 3 of Regulation 5."))
    sources = p.select(F.concat_ws(":", "version", "id").alias("id"), F.concat_ws(" ", "text", text).alias("text"), "kind")
    targets = p.where("kind = 'article'").select("id", F.lit("").alias("text"), F.lit("target").alias("kind")).distinct()
    return walk.extract_references(sources.unionByName(targets), kinds=("article", "recital", "roman")).select("source_id", "target_id", "phrase").distinct()


@query("""WITH v AS (SELECT vec_id, vec_id % 2 AS version, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT q.vec_id AS query_id, q.version, v.vec_id, round(list_distance(q.e, v.e), 6) AS dist
  FROM v q JOIN v ON v.version = q.version AND v.vec_id <> q.vec_id WHERE q.vec_id % 20 < 2)
SELECT query_id, version, string_agg(vec_id, ',' ORDER BY dist, vec_id) AS searched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM n) WHERE r <= 12 GROUP BY 1, 2""")
def search_by_version(spark, d):
    """The search arm: nearest vectors of the question's own version, the number asked for left to its default."""
    from ..operators import search

    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    found = None
    for version in (0, 1):
        part = search.check_width(v.where(F.col("vec_id") % 2 == version), "embedding", v.select(F.size("embedding").alias("n")).first()["n"])
        hits = search.nearest(part, part.where("vec_id % 20 < 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 12)
        hits = hits.select(F.col("query_id").alias("question"), F.lit(version).alias("version"), F.col("vec_id").alias("id"), "rank")
        found = hits if found is None else found.unionByName(hits)
    return arms.search_only(found).select(F.col("question").alias("query_id"), "version", F.array_join("searched", ",").alias("searched"))
