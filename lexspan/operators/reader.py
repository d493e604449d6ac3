"""What a reader of the stored texts and runs is shown, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.units import UNITS, Units

# Steps of a run, playback's speed and gap, and the texts' names.
STEPS = ("route", "retrieve", "traverse", "budget", "synthesize")
SPEED_UP, GAP_MS = 5, 40
TEXT_NAMES = {"original": "the original", "consolidated": "the amended"}


def citation_label(citation: Column, provision_id: Column, units: Units = UNITS) -> Column:
    """The citation that a version has for an id, else one spelled from the id: `art_7.2` as Article 7(2)."""
    kind, rest = F.substring_index(provision_id, "_", 1), F.regexp_replace(provision_id, "^[^_]*_", "")
    parts = F.split(rest, r"\.")
    names = {prefix: name for name, prefix in (units.article, units.roman, units.recital)}
    name = kind
    for prefix, written in names.items():
        name = F.when(kind == prefix, written).otherwise(name)
    tail = F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lit("("), p, F.lit(")"))), "")
    return F.coalesce(citation, F.concat(name, F.lit(" "), parts[0], tail))


def source_address(base: Column, provision_id: Column, units: Units = UNITS) -> Column:
    """The document's address with the anchor of an article, roman unit or recital; a paragraph has its article's."""
    anchored = F.lit(False)
    for _, prefix in (units.article, units.roman, units.recital):
        anchored = anchored | provision_id.startswith(prefix + "_")
    return F.when(anchored, F.concat(base, F.lit("#"), tx.article_root(provision_id))).otherwise(base)


def outcome_line(original: Column, consolidated: Column) -> Column:
    """How a question's recordings went on both texts; null flags are texts without a recording."""
    def on(flag: Column, version: str) -> Column:
        said = F.when(flag.isNull(), "not recorded").when(flag, "refused").otherwise("answered")
        return F.concat(said, F.lit(f" on {TEXT_NAMES[version]}"))

    both = F.when(original, "Refused on both texts").otherwise("Answered on both texts")
    line = F.concat_ws(", ", on(original, "original"), on(consolidated, "consolidated"))
    return F.when(original == consolidated, both).otherwise(F.concat(F.upper(F.left(line, F.lit(1))), F.expr("''"), F.substring(line, 2, 2**31 - 1)))


def file_name(question: Column, version: Column) -> Column:
    return F.concat(question, F.lit("."), version, F.lit(".json"))


def identifier(question: Column, version: Column) -> Column:
    """A binding's name out of both: pieces between dashes and dots, capitalised after the first."""
    parts = F.split(F.concat_ws("-", question, version), "[-.]")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 2**31 - 1)))), ""))


def grouped_number(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), ",", " ")


def read_address(url: Column, units: Units = UNITS) -> Column:
    """struct(question, version, provision) of an address; a field that does not read is null and harms no other."""
    kinds = "|".join((units.article[1], units.roman[1], units.recital[1]))
    get = lambda key, pattern: F.when(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)).rlike(pattern), F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))
    return F.struct(
        get("q", r"^q\d{2}-[a-z0-9-]+$").alias("question"), get("v", "^(original|consolidated)$").alias("version"),
        get("p", rf"^({kinds})_[0-9A-Za-z.]+$").alias("provision"),
    )


def address_search(address: Column) -> Column:
    """The query string of an address, empty if it carries nothing."""
    field = lambda name, value: F.concat(F.lit(f"{name}="), value)
    joined = F.concat_ws("&", field("q", address["question"]), field("v", address["version"]), field("p", address["provision"]))
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def forwarded(address: Column) -> Column:
    """Where a link of old leads: only if it names a question."""
    return F.when(address["question"].isNotNull(), F.concat(F.lit("/ask"), address_search(address)))


def matches_filter(label: Column, query: Column, units: Units = UNITS) -> Column:
    """Whether a citation answers a filter: a bare number or numeral, with or without its kind, matches whole, all else as a beginning."""
    kinds = "|".join((units.article[0], units.roman[0], units.recital[0])).lower()
    q = F.lower(tx.collapse(query))
    wanted, cited = rf"^(?:({kinds})\s+)?(\d+|[ivxlc]+)$", rf"(?U)^({kinds})\s+(\d+|[ivxlc]+)(?![\p{{L}}\p{{N}}])"
    kind, number = F.regexp_extract(q, wanted, 1), F.regexp_extract(q, wanted, 2)
    same = (F.regexp_extract(F.lower(label), cited, 2) == number) & ((kind == "") | (F.regexp_extract(F.lower(label), cited, 1) == kind))
    return F.when(q == "", True).when(number != "", same).otherwise(F.startswith(F.lower(label), q))


def jump_target(typed: Column, units: Units = UNITS) -> Column:
    """The id that a typed number or numeral names; whether it exists is for a join to say."""
    t = tx.strip(typed)
    return F.when(t.rlike(r"(?i)^\d+[a-z]?$"), F.concat(F.lit(units.article[1] + "_"), F.lower(t))).when(t.rlike("(?i)^[ivxlc]+$"), F.concat(F.lit(units.roman[1] + "_"), F.upper(t)))


def sections(provisions: DataFrame, group: str) -> DataFrame:
    """group, place, id, blocks, has_paragraphs: each heading with its paragraphs in order, or itself where it has none.

    provisions: (group, ord, id, kind, parent_id); places count headings from 0.
    """
    headings = provisions.where("kind <> 'paragraph'").select(group, "ord", "id")
    place = F.row_number().over(Window.partitionBy(group).orderBy("ord")) - 1
    under = provisions.where("kind = 'paragraph' and parent_id is not null").groupBy(group, F.col("parent_id").alias("id"))
    under = under.agg(F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("b"))
    joined = headings.withColumn("place", place).join(under, [group, "id"], "left")
    return joined.select(group, "place", "id", F.coalesce(F.transform("b", lambda x: x["id"]), F.array("id")).alias("blocks"), F.col("b").isNotNull().alias("has_paragraphs"))


def section_places(ids: DataFrame, provisions: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """ids (group, id) with `place`, the section of each provision's heading; 0 for what is unknown."""
    heads = provisions.select(group, "id", F.coalesce("parent_id", "id").alias("head"))
    known = found.select(group, F.col("id").alias("head"), "place")
    joined = ids.join(heads, [group, "id"], "left").withColumn("head", F.coalesce("head", "id")).join(known, [group, "head"], "left")
    return joined.select(*ids.columns, F.coalesce("place", F.lit(0)).alias("place"))


def landing(blocks: Column, open_id: Column, point: Column) -> Column:
    """The key of the block that a landing marks, blocks: array<struct<id, paths array<string>>>: a point in any block, else the open provision."""
    hits = F.filter(F.transform(blocks, lambda b: F.struct(b["id"].alias("id"), F.array_position(b["paths"], point).alias("at"))), lambda b: b["at"] > 0)
    first = F.try_element_at(hits, F.lit(1))
    return F.when(open_id.isNull(), F.lit(None).cast("string")).when(first.isNotNull(), F.concat_ws("#", first["id"], (first["at"] - 1).cast("string"))).otherwise(open_id)


def stepped(rows: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """rows with the value before and after each, in order."""
    w = Window.partitionBy(group).orderBy(place)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def cited_steps(current: Column, cited: Column) -> Column:
    """struct(previous, next): where a step among the cited provisions lands from the current one.

    current: its id, null where none is; the first and the last of `cited` (array, in order) are then the next and the
    previous one.  Null past either end; an id that is not cited stands as none.
    """
    at = F.coalesce(F.array_position(cited, current), F.lit(0)).cast("int")
    none = at == 0
    step = lambda i: F.try_element_at(cited, F.when(i > 0, i))
    return F.struct(step(F.when(none, F.size(cited)).otherwise(at - 1)).alias("previous"), step(F.when(none, F.lit(1)).otherwise(at + 1)).alias("next"))


def captured_on(asked: DataFrame, manifest: DataFrame) -> DataFrame:
    """asked (question, version) with `captured_on`: the pair's stamp, else the latest of all; '' in an empty manifest."""
    latest = manifest.agg(F.coalesce(F.max("captured_at"), F.lit("")).alias("latest"))
    pairs = manifest.groupBy("question", "version").agg(F.min_by("captured_at", "ord").alias("at"))
    return asked.join(pairs, ["question", "version"], "left").join(F.broadcast(latest), how="cross").select(*asked.columns, F.coalesce("at", "latest").alias("captured_on"))


def recorded_questions(manifest: DataFrame) -> DataFrame:
    """question, description, original, consolidated: the first entry of each question and its refusals by version, null where not recorded."""
    flag = lambda v: F.min_by("refused", F.when(F.col("version") == v, F.col("ord"))).alias(v)
    return manifest.groupBy("question").agg(F.min_by("description", "ord").alias("description"), flag("original"), flag("consolidated"))


def playback(duration_ms: Column, refused: Column) -> Column:
    """array<struct<at_ms, node>>: when each frame of a recording is played."""
    total = duration_ms / SPEED_UP
    routed = total / 3
    moment = lambda at, node: F.struct(at.cast("double").alias("at_ms"), F.lit(node).alias("node"))
    frames = [moment(routed + GAP_MS * i, node) for i, node in enumerate(STEPS[:-1])] + [moment(total, STEPS[-1])]
    return F.concat(F.array(*frames), F.when(refused, F.array(moment(total, "refuse"))).otherwise(F.slice(F.array(moment(total, "refuse")), 1, 0)))


def step_states(started: Column, finished: Column, now: Column) -> Column:
    """array<struct<step, state, elapsed_ms>> of a run; finished: map of step to time.  A step starts where the one before ended."""
    out = []
    for before, step in zip((None, *STEPS[:-1]), STEPS):
        begun = started if before is None else F.try_element_at(finished, F.lit(before))
        done = F.try_element_at(finished, F.lit(step))
        state = F.when(begun.isNull(), "pending").when(done.isNotNull(), "done").otherwise("running")
        elapsed = F.when(begun.isNotNull(), F.coalesce(done, now) - begun)
        out.append(F.struct(F.lit(step).alias("step"), state.alias("state"), elapsed.cast("long").alias("elapsed_ms")))
    return F.array(*out)
