"""Provisions out of flattened pages: spans between headings, as interval and as-of joins per document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.units import UNITS, Units
from ..sources import html
from ..sources.scratch import materialize
from . import intervals

# Shapes of written numbers and of leaks.
CHAPTER = r"^CHAPTER\s+([IVXLC]+)$"
LEADING_LABEL = r"^(\d+[a-z]?)\.\s"
LABEL = r"^(\d+[a-z]?)\.?$"
AMENDING = r"\bM\d+"
DIVISION_LEAK = r"\b(CHAPTER\s+[IVXLC]+|SECTION\s+\d+)\b"
SIGNATURE_LEAK = "Done at Brussels"
MARKER_LEAK = "▼"
TITLE_CHARS = 120
#: Characters of a stretch of a page, within which lines meet what holds them.
STRETCH = 4_096


@dataclass(frozen=True)
class Markup:
    """Classes by which a scheme marks headings; a class ending in `*` stands for all that begin so."""

    heading: str
    subtitle: str
    division: str
    chapter: str
    chapter_title: str
    body: str | None = None  # paragraphs numbered in their prose
    label: str | None = None  # or by an element of their own
    roman_title: str = ""
    marker: str | None = None  # amendment markers
    signature: str | None = None  # prefix of the id of what ends the articles


def of_class(cls: str | None) -> Column:
    if not cls:
        return F.lit(False)
    return F.coalesce(F.col("cls").startswith(cls[:-1]) if cls.endswith("*") else F.col("cls") == cls, F.lit(False))


def parse(pages: DataFrame, markup: Markup, units: Units = UNITS, key: str = "doc") -> DataFrame:
    """key, ord, id, kind, number, title, text, parent_id, chapter_id, amended of pages (key, html).

    Provisions stand in page order: chapters before the first article after them, paragraphs
    after their article, then units with roman numbers and recitals, which are anchored by id.
    """
    flat = materialize(html.flattened(pages, key), "flat")  # pages are parsed once
    whole = flat.select(key, F.col("f.text").alias("whole"))
    headed = (markup.heading, markup.subtitle, markup.division, markup.chapter, markup.chapter_title, markup.body, markup.label, markup.roman_title, markup.marker)
    used = F.col("id").isNotNull()
    for cls in headed:
        used = used | of_class(cls)
    found = materialize(html.elements(flat, key, used), "elements")
    clean = tx.strip_markers if markup.marker else tx.normalize
    ends = found.where(F.col("id").startswith(units.roman[1] + "_") | (F.col("id").startswith(markup.signature) if markup.signature else F.lit(False)))
    limit = whole.select(key, F.length("whole").cast("long").alias("n")).join(ends.groupBy(key).agg(F.min("start").alias("first")), key, "left")
    limit = limit.select(key, F.least("n", F.coalesce("first", "n")).alias("lim"))
    marks = found.join(limit, key).where((F.col("start") < F.col("lim")) | of_class(markup.heading))
    spans = lambda start, stop: intervals.spans(marks, key, "start", F.col("lim"), start, stop, ["n"]).withColumnRenamed("span_end", "stop_at")

    chapters = spans(of_class(markup.chapter), F.lit(False))
    titles = found.where(of_class(markup.chapter_title)).withColumn("value", tx.strip(F.col("text")))
    chapters = intervals.first_inside(chapters, titles, key, "start", "stop_at", "start", "value", "title")
    numeral = F.regexp_extract(tx.normalize(F.col("text")), CHAPTER, 1)
    chapters = chapters.withColumn("number", numeral).where("number <> ''").withColumn("title", _without_quotes(clean(F.coalesce("title", F.lit("")))))
    chapter_text = F.concat_ws(" ", F.lit("CHAPTER"), "number", F.when(F.col("title") != "", F.col("title")))
    chapters = chapters.select(key, F.col("start").alias("off"), F.concat(F.lit(units.chapter[1] + "_"), "number").alias("id"), "number", "title", chapter_text.alias("text"))

    articles = spans(of_class(markup.heading), of_class(markup.division))
    subtitles = found.where(of_class(markup.subtitle)).withColumn("value", F.col("text"))
    articles = intervals.first_inside(articles, subtitles, key, "start", "stop_at", "start", "value", "title")
    number = F.regexp_extract(tx.normalize(F.col("text")), rf"{units.article[0]}\s+(\d+[a-z]?)", 1)
    articles = articles.withColumn("number", number).where("number <> ''").withColumn("title", _without_quotes(clean(F.coalesce("title", F.lit("")))))
    articles = articles.select(key, "n", F.col("start").alias("off"), "stop_at", F.concat(F.lit(units.article[1] + "_"), "number").alias("id"), "number", "title")
    # The chapter at an article: the last one that begins at or before it.
    both = chapters.select(key, "off", F.lit(0).alias("probe"), F.col("id").alias("chapter_id"), F.lit(None).cast("string").alias("article"))
    both = both.unionByName(articles.select(key, "off", F.lit(1).alias("probe"), F.lit(None).cast("string").alias("chapter_id"), F.col("id").alias("article")))
    both = both.withColumn("chapter_id", intervals.state_at(both, key, ["off", "probe"], F.col("chapter_id"))).where("probe = 1")
    articles = articles.join(both.select(key, "off", "chapter_id"), [key, "off"])

    labelled = found.where(of_class(markup.body if markup.body else markup.label)).withColumn("plain", tx.normalize(F.col("text")))
    labelled = labelled.withColumn("label", F.regexp_extract("plain", LEADING_LABEL if markup.body else LABEL, 1))
    if markup.body:  # bodies without a number are text of the paragraph before them
        labelled = labelled.where("label <> ''")
    # Articles do not overlap: a label is of the last one that began, unless that has ended.
    inside = intervals.holder_of(labelled.select(key, "n", F.col("start").alias("at"), "label"), articles.select(key, F.col("n").alias("heading"), "off", "stop_at", "id", "chapter_id"), key, "at", "off", "stop_at", "heading")
    follow = F.lead("at").over(Window.partitionBy(key, "off").orderBy("at", "n"))
    paragraphs = inside.withColumn("to", F.coalesce(follow, "stop_at")).where("label <> ''")
    paragraphs = paragraphs.select(key, F.col("at").alias("off"), "to", F.concat("id", F.lit("."), "label").alias("id"), F.col("label").alias("number"), F.col("id").alias("parent_id"), "chapter_id")

    article_rows = html.cut(flat, articles, key, "off", "stop_at", "text").withColumn("text", clean(F.col("text"))).withColumn("kind", F.lit("article"))
    paragraph_rows = html.cut(flat, paragraphs, key, "off", "to", "text").withColumn("text", clean(F.col("text"))).withColumn("kind", F.lit("paragraph")).withColumn("title", F.lit(""))
    tail = html.anchored(found, units.roman[1] + "_", "roman", key).unionByName(html.anchored(found, units.recital[1] + "_", "recital", key))
    tail = tail.join(_roman_titles(found, markup, units, key), [key, "id"], "left").withColumn("title", F.coalesce("title", F.lit(""))).withColumn("text", clean(F.col("text")))
    cols = [key, "off", "id", "kind", "number", "title", "text", "parent_id", "chapter_id", "end", "tier"]
    null = F.lit(None).cast("string")
    rows = chapters.select(key, "off", "id", F.lit("chapter").alias("kind"), "number", "title", "text", null.alias("parent_id"), null.alias("chapter_id"), F.col("off").alias("end"), F.lit(0).alias("tier"))
    rows = rows.unionByName(article_rows.select(key, "off", "id", "kind", "number", "title", "text", null.alias("parent_id"), "chapter_id", F.col("stop_at").alias("end"), F.lit(0).alias("tier")))
    rows = rows.unionByName(paragraph_rows.select(key, "off", "id", "kind", "number", "title", "text", "parent_id", "chapter_id", F.col("off").alias("end"), F.lit(0).alias("tier")))
    tier = F.when(F.col("kind") == "roman", 1).otherwise(2)
    rows = rows.unionByName(tail.select(key, "off", "id", "kind", "number", "title", "text", null.alias("parent_id"), null.alias("chapter_id"), F.col("off").alias("end"), tier.alias("tier")))
    rank = F.when(F.col("kind") == "chapter", 0).when(F.col("kind") == "article", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(key).orderBy("tier", "off", rank, "id"))
    rows = rows.select(*cols).withColumn("ord", place)
    return _amended(rows, found, markup, key).select(key, "ord", "id", "kind", "number", "title", "text", "parent_id", "chapter_id", "amended")


def _without_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "[`'\"]+$", "")


def _roman_titles(found: DataFrame, markup: Markup, units: Units, key: str) -> DataFrame:
    """The heading lines after the first of each anchored element, joined and cut; without any, the first body text in it."""
    anchored = F.col("id").startswith(units.roman[1] + "_") | F.col("id").startswith(units.recital[1] + "_")
    holders = found.where(anchored).select(key, "id", F.col("start").alias("a"), F.col("end").alias("b"), F.col("n").alias("h"))
    lines = found.where(of_class(markup.roman_title)).select(key, "n", "start", "text")
    # They may stand inside each other; by stretches of the page, a line meets those that reach into its own.
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    held = lines.withColumn("_s", stretch("start")).join(holders.withColumn("_s", F.explode(F.sequence(stretch("a"), stretch("b")))), [key, "_s"])
    held = held.where("n > h and start >= a and start < b")
    joined = held.groupBy(key, "id").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("l"))
    title = F.array_join(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x["text"]), " ")
    return joined.select(key, "id", F.left(tx.normalize(title), F.lit(TITLE_CHARS)).alias("title"))


def _amended(rows: DataFrame, found: DataFrame, markup: Markup, key: str) -> DataFrame:
    """Whether the last marker at or before a provision amends it, or, for an article, any inside it."""
    if not markup.marker:
        return rows.withColumn("amended", F.lit(False))
    marks = found.where(of_class(markup.marker)).select(key, F.col("start").alias("off"), F.lit(0).alias("probe"), "text", F.col("text").rlike(AMENDING).alias("state"), F.lit(None).cast("int").alias("ord"))
    probes = rows.select(key, "off", F.lit(1).alias("probe"), F.lit("").alias("text"), F.lit(None).cast("boolean").alias("state"), "ord")
    both = marks.unionByName(probes)
    at = both.withColumn("at", F.coalesce(intervals.state_at(both, key, ["off", "probe", "text"], F.col("state")), F.lit(False))).where("probe = 1").select(key, "ord", "at")
    opened = marks.where("state").select(key, F.col("off").alias("o"))
    articles = rows.where("kind = 'article'").select(key, "ord", "off", "end")
    inside = intervals.holder_of(opened, articles, key, "o", "off", "end", "ord").select(key, "ord").distinct().withColumn("inside", F.lit(True))
    joined = rows.join(at, [key, "ord"]).join(inside, [key, "ord"], "left")
    return joined.withColumn("amended", F.col("at") | F.coalesce("inside", F.lit(False)))


def counts_as_expected(rows: DataFrame, expected: DataFrame, version: str = "version") -> DataFrame:
    """A line for each (version, kind) whose number of provisions is not that of expected (version, kind, expected)."""
    found = rows.groupBy(version, "kind").agg(F.count(F.lit(1)).alias("found"))
    both = expected.join(found, [version, "kind"], "left").withColumn("found", F.coalesce("found", F.lit(0))).where("found <> expected")
    return both.select(F.format_string("%s: expected %d %s, parsed %d", version, "expected", "kind", "found").alias("message"))


def leaks(rows: DataFrame, version: str = "version") -> DataFrame:
    """A line for each provision (version, id, kind, title, text) that carries a marker, a signature block or a division heading."""
    line = lambda what: F.concat_ws("", F.col(version), F.lit(": "), F.col("id"), F.lit(f" carries {what}")).alias("message")
    text = F.coalesce("text", F.lit(""))
    marked = rows.where(text.contains(MARKER_LEAK) | F.coalesce("title", F.lit("")).contains(MARKER_LEAK)).select(line("a consolidation marker"))
    signed = rows.where((F.col("kind") == "article") & text.contains(SIGNATURE_LEAK)).select(line("the signature block"))
    headed = rows.where(F.col("kind").isin("article", "paragraph") & text.rlike(DIVISION_LEAK)).select(line("a division heading"))
    return marked.unionByName(signed).unionByName(headed)


def disagreements(rows: DataFrame, expected: DataFrame, version: str = "version") -> DataFrame:
    return counts_as_expected(rows, expected, version).unionByName(leaks(rows, version))


def verify(rows: DataFrame, expected: DataFrame, version: str = "version") -> None:
    """Raises with the first lines if anything disagrees."""
    found = [r["message"] for r in disagreements(rows, expected, version).limit(20).collect()]
    if found:
        raise ValueError("; ".join(found))


def chunks(rows: DataFrame, budget: int = 6000, units: Units = UNITS) -> DataFrame:
    """chunk_id, provision_id, citation, kind, text of provisions (id, kind, number, title, text, parent_id, version).

    Provisions with paragraphs are left to these; a paragraph is headed by its citation and its
    parent's title, a recital by its citation.  What exceeds the budget is cut at its points.
    """
    parents = rows.select("version", F.col("id").alias("parent_id"), F.col("title").alias("_title"))
    holders = rows.where("kind = 'paragraph'").select("version", F.col("parent_id").alias("id")).distinct()
    alone = rows.where("kind <> 'paragraph'").join(holders, ["version", "id"], "left_anti").select(*rows.columns)
    used = alone.unionByName(rows.where("kind = 'paragraph'")).join(parents, ["version", "parent_id"], "left")
    cited = tx.citation(F.col("kind"), F.col("number"), F.col("parent_id"), units)
    heading = F.when(F.col("kind") == "paragraph", F.concat_ws(" ", cited, F.when(F.col("_title") != "", F.col("_title")))).when(F.col("kind") == "recital", cited)
    used = used.withColumn("citation", cited).withColumn("whole", F.concat_ws("\n", heading, "text"))
    parts = used.withColumn("parts", tx.pack_points(F.col("whole"), budget=budget))
    each = parts.select("version", F.col("id").alias("provision_id"), "citation", "kind", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "text"))
    chunk_id = F.when(F.col("n") == 1, F.col("provision_id")).otherwise(F.concat_ws("#", "provision_id", F.col("part").cast("string")))
    return each.select("version", chunk_id.alias("chunk_id"), "provision_id", "citation", "kind", "text")


def change_notes(rows: DataFrame, units: Units = UNITS) -> DataFrame:
    """version, id, citation, note of provisions of the versions original and consolidated; null where nothing changed.

    A provision that only one version has, or whose wording differs beyond white space, has a note.
    """
    cited = tx.citation(F.col("kind"), F.col("number"), F.col("parent_id"), units)
    mine = rows.select("version", "id", cited.alias("citation"), tx.comparable(F.col("text")).alias("t"))
    other = F.when(F.col("version") == "original", "consolidated").otherwise("original")
    theirs = rows.select(other.alias("version"), "id", tx.comparable(F.col("text")).alias("u"), F.lit(True).alias("there"))
    absent = F.concat("citation", F.lit(" appears in the "), "version", F.lit(" text and not in the "), other, F.lit(" text."))
    differs = F.concat(F.lit("The wording of "), "citation", F.lit(" differs between the original and the consolidated text."))
    note = F.when(F.col("there").isNull(), absent).when(~F.col("t").eqNullSafe(F.col("u")), differs)
    return mine.join(theirs, ["version", "id"], "left").select("version", "id", "citation", note.alias("note"))
