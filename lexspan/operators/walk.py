"""Cross-reference graph: extraction, adjacency, bounded multi-source walk with provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import UNITS, Units
from ..sources.scratch import materialize, scratch_path
from . import order

# What follows a reference to another act.
OTHER_ACT = r"(\s*(?:,\s*)?(?:and\s+)?of\s+(?:Directive|Regulation|Decision|Council|the\s+(?:Directive|Regulation)))?"


def reference_pattern(units: Units = UNITS) -> str:
    """The shape of a written reference (group 1) and the act it belongs to if it is another (group 2)."""
    more = lambda n: rf"(?:(?:\s*,\s*|\s+and\s+|\s+to\s+){n})*"
    article = rf"\b{units.article[0]}s?\s+\d+[a-z]?(?:\s*\(\s*\d+[a-z]?\s*\))?{more(r'[0-9]+[a-z]?')}"
    return rf"({article}|\b{units.roman_pattern()}\s+[IVXLC]+{more('[IVXLC]+')}\b){OTHER_ACT}"


def targets_of(phrase: Column, units: Units = UNITS) -> Column:
    """Ids that one reference phrase names, in order; `a to b` stands for all between."""
    roman = F.transform(F.regexp_extract_all(F.regexp_replace(phrase, r"^\S+\s+", ""), F.lit(r"\b[IVXLC]+\b"), F.lit(0)), lambda n: F.concat(F.lit(f"{units.roman[1]}_"), n))
    words = F.regexp_extract_all(F.regexp_replace(phrase, r"\([^)]*\)", ""), F.lit(r"\d+[a-z]?|\bto\b"), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("named"), F.lit(False).alias("to"))

    def read(state: Column, word: Column) -> Column:
        last = F.try_element_at(state["named"], F.lit(-1))
        named = F.concat(state["named"], F.when(state["to"], _between(last, word)).otherwise(none), F.array(word))
        to = (word == "to") & (F.size(state["named"]) > 0)
        return F.struct(F.when(word == "to", state["named"]).otherwise(named).alias("named"), to.alias("to"))

    prefix = F.lit(f"{units.article[1]}_")
    numbers = F.aggregate(words, start, read, lambda s: s["named"])
    part = F.regexp_extract(phrase, r"\(\s*(\d+[a-z]?)\s*\)", 1)
    whole = F.transform(numbers, lambda n: F.concat(prefix, n))
    one = (part != "") & (F.size(numbers) == 1)
    article = F.when(one, F.concat(F.transform(whole, lambda w: F.concat(w, F.lit("."), part)), whole)).otherwise(whole)
    return F.when(phrase.startswith(units.article[0]), article).otherwise(roman)


def _between(a: Column, b: Column) -> Column:
    """Numbers strictly between two; lettered ones of one stem go by letter."""
    none = F.array().cast("array<string>")
    digits, lettered = r"^\d{1,9}$", r"^\d+[a-z]$"
    stem = lambda c: F.left(c, F.length(c) - 1)
    code = lambda c: F.ascii(F.right(c, F.lit(1)))
    run = lambda low, high: F.when(high - low > 1, F.sequence(low + 1, high - 1))
    number = lambda c: F.when(c.rlike(digits), c.cast("int"))
    plain = F.transform(run(number(a), number(b)), lambda n: n.cast("string"))
    letters = F.transform(run(code(a), code(b)), lambda n: F.concat(stem(a), F.char(n)))
    return F.coalesce(F.when(a.rlike(digits) & b.rlike(digits), plain).when(a.rlike(lettered) & b.rlike(lettered) & (stem(a) == stem(b)), letters), none)


def references(rows: DataFrame, units: Units = UNITS) -> DataFrame:
    """source_id, target_id, phrase, ord of the references in rows (id, text), in their order; those to other acts are left out."""
    pattern = F.lit(f"(?U){reference_pattern(units)}")
    # The act that a phrase belongs to stands beside it in a group of its own, empty for this act.
    pairs = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("phrase"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("act"))
    each = rows.select(F.col("id").alias("source_id"), F.posexplode(pairs).alias("n", "x")).where("x.act = ''").select("source_id", "n", F.col("x.phrase").alias("phrase"))
    named = each.select("source_id", "n", "phrase", F.posexplode(targets_of(F.col("phrase"), units)).alias("m", "target_id"))
    return named.select("source_id", "target_id", "phrase", (F.col("n").cast("long") * (1 << 31) + F.col("m")).alias("ord"))


def extract_references(provisions: DataFrame, units: Units = UNITS, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """source_id, target_id, phrase, ord of provisions (id, text, kind if kinds is given).

    One row a pair with its first phrase; known targets only, none to the source itself or its
    parts.  Sources may be restricted to kinds.  Ids are unique, so each pair is found in one row.
    """
    sources = provisions if kinds is None else provisions.where(F.col("kind").isin(*kinds))
    # Only texts that name a unit at all are read for references.
    sources = sources.where(F.col("text").rlike(rf"\b(?:{units.article[0]}|{units.roman_pattern()})"))
    found = references(sources, units).where("target_id <> source_id and not startswith(target_id, concat(source_id, '.'))")
    # The first phrase of each target of a source; texts are read once, though targets are looked at twice.
    found = found.groupBy("source_id", "target_id").agg(F.min(F.struct("ord", "phrase")).alias("r")).select("source_id", "target_id", "r.phrase", "r.ord")
    found = materialize(found, "references")
    named = found.select("target_id").distinct().join(provisions.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return found.join(named, "target_id").select("source_id", "target_id", "phrase", "ord")


def adjacency(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Neighbours of each node in edge order."""
    listed = F.sort_array(F.collect_list(F.struct("ord", F.col(other).alias("id"))))
    return edges.groupBy(key).agg(F.transform(listed, lambda x: x["id"]).alias("neighbours"))


def lift(seeds: DataFrame, parents: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """query_id, id, src, pos: the holder (id, parent_id) of each seed, if it is a node and no seed itself, from its best seed."""
    up = seeds.join(parents, "id").select("query_id", F.col("parent_id").alias("up"), F.col("id").alias("src"), "pos")
    if nodes is not None:
        up = up.join(nodes.select(F.col("id").alias("up")).distinct(), "up", "left_semi")
    up = up.join(seeds.select("query_id", F.col("id").alias("up")), ["query_id", "up"], "left_anti")
    best = Window.partitionBy("query_id", "up").orderBy("pos", "src")
    return up.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("query_id", F.col("up").alias("id"), "src", "pos")


def walk(seeds: DataFrame, edges: DataFrame, depth: int = 2, cap: int | None = 40, lifted: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """query_id, id, hop, src, rank of what `depth` hops reach from seeds (query_id, id, pos).

    Of seeds that repeat an id the first counts.  A node belongs to its first discoverer in
    queue order: seeds by place, then lifted holders (hop 0, which are reached too); seeds
    are never reached.  The ranking by (hop, id as text) is cut at cap.  Nothing is reached
    if the walk is not enabled.  A query that has reached as many as the cap goes no further, as
    later hops rank behind.  Edges are written once by buckets of their source, so a hop moves
    the frontier only; each hop is deduplicated, numbered by ranges of its queue and written to the
    shared folder, so plans and lost executors cost one hop; it stays within nodes times queries.
    """
    links = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("id"), "ord")
    links, table = by_bucket(links, "src") if enabled and depth > 1 else (links, None)
    start = seeds.groupBy("query_id", "id").agg(F.min("pos").cast("long").alias("pos"))
    none = start.where("false").select("query_id", "id", F.lit(0).alias("hop"), F.col("id").alias("src"))
    seen = start.select("query_id", "id")
    front = start.select("query_id", F.col("id").alias("src"), F.struct(F.lit(0).alias("tier"), "pos").alias("spos"))
    out = none
    if lifted is not None and enabled:
        seen = seen.unionByName(lifted.select("query_id", "id"))
        front = front.unionByName(lifted.select("query_id", F.col("id").alias("src"), F.struct(F.lit(1).alias("tier"), F.col("pos").cast("long").alias("pos")).alias("spos")))
        out = lifted.select("query_id", "id", F.lit(0).alias("hop"), "src")
    for hop in range(1, depth + 1 if enabled else 1):
        first = Window.partitionBy("query_id", "id").orderBy("spos", "ord")
        new = front.join(links, "src").join(seen, ["query_id", "id"], "left_anti")
        new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "id", "src", "spos", "ord")
        # running() writes what it numbers.
        new = order.running(new, "query_id", ["spos", "ord", "id"], F.lit(1)).select("query_id", "id", "src", F.col("running").alias("npos"))
        out = out.unionByName(new.select("query_id", "id", F.lit(hop).alias("hop"), "src"))
        seen = seen.unionByName(new.select("query_id", "id"))
        front = new.select("query_id", F.col("id").alias("src"), F.struct(F.lit(0).alias("tier"), F.col("npos").alias("pos")).alias("spos"))
        if cap is not None and hop < depth:
            full = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap).select("query_id")
            front = front.join(full, "query_id", "left_anti")
    if table is not None:  # every hop is written
        seeds.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    by = ["hop", F.col("id").cast("string")]
    if cap is None:
        return order.running(out, "query_id", by, F.lit(1)).select(*out.columns, F.col("running").alias("rank"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= cap)


def by_bucket(rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """rows as a table in the shared folder, bucketed by key, and its name: joins by that key don't move it again."""
    spark = rows.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name), name
