"""Numbered passages of long texts and the passage that shares most words with a claim."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import UNITS, Units

# Written numbering, what may stand before it, and how numbering counts.
NUMBERING = re.compile(r"(?P<dot>\d+)\.\s|\((?P<number>\d+)\)\s|\((?P<letter>[a-z]{1,4})\)\s")
AFTER_SENTENCE = re.compile(r"(?:^|[.:;]\s+|[;,]\s+(?:and|or)\s+)$")
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv".split()
LEAST_SHARED = 8
_NAMES = T.ArrayType(T.StringType())
PASSAGES = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("kinds", _NAMES).add("path", _NAMES).add("text", T.StringType()))


def ordinals(match: re.Match) -> dict[str, int]:
    """Kinds of numbering that a marker can be of, each with its place in the count; letters come before romans."""
    kind = match.lastgroup
    if kind != "letter":
        return {kind: int(match[kind])}
    text, out = match["letter"], {}
    if len(text) == 1:
        out["letter"] = ord(text) - ord("a") + 1
    if text in ROMAN:
        out["roman"] = ROMAN.index(text) + 1
    return out


def passages(text: str | None) -> list[tuple[int, list[str], list[str], str]]:
    """(start, kinds, path, text) of each numbered passage, in order.

    A marker goes on with the deepest open level whose next number it is, else opens a level
    of a new kind at that kind's first number; anything else is a mention.  A text may begin
    at any number.  Null or unnumbered texts have no passages.
    """
    text = text or ""
    levels: list[tuple[str, int, str]] = []
    found: list[tuple[int, list[tuple[str, int, str]]]] = []
    for m in NUMBERING.finditer(text):
        at, can, shown = m.start(), ordinals(m), m[m.lastgroup]
        heading = not levels and m["dot"] == "1"
        if at and not heading and not AFTER_SENTENCE.search(text[max(0, at - 12) : at]):
            continue
        goes_on = [d for d, (kind, n, _) in enumerate(levels) if can.get(kind) == n + 1]
        if goes_on:
            deep = goes_on[-1]
            levels = [*levels[:deep], (levels[deep][0], levels[deep][1] + 1, shown)]
        else:
            used = {kind for kind, _, _ in levels}
            new = [k for k, n in can.items() if (n == 1 and k not in used) or (at == 0 and not levels)]
            if not new:
                continue
            levels = [*levels, (new[0], can[new[0]], shown)]
        found.append((at, levels))
    ends = [*(at for at, _ in found[1:]), len(text)][: len(found)]
    return [(at, [v[0] for v in p], [v[2] for v in p], text[at:end].strip()) for (at, p), end in zip(found, ends, strict=True)]


def segments(text: str | None) -> list[tuple[int, list[str], list[str], str]]:
    """passages(), after what stands before the first of them (kinds and path empty) if that is not blank."""
    found = passages(text)
    lead = (text or "")[: found[0][0] if found else None].strip()
    return [(0, [], [], lead), *found] if lead else found


@F.pandas_udf(PASSAGES)
def segments_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("start", "kinds", "path", "text"), p, strict=True)) for p in segments(t)])


@F.pandas_udf(PASSAGES)
def passages_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("start", "kinds", "path", "text"), p, strict=True)) for p in passages(t)])


def long_words(text: Column) -> Column:
    """Distinct words of four letters or digits at least, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)))


def point_name(citation: Column, passage: Column, units: Units = UNITS) -> Column:
    """The citation carried on to a passage: `Article 7(2), point (c)`, `Schedule II, point 3(b)`."""
    kinds, path = passage["kinds"], passage["path"]
    head = F.concat(F.lit("("), F.try_element_at(path, F.lit(1)), F.lit(")"))
    dotted = F.coalesce(F.try_element_at(kinds, F.lit(1)) == "dot", F.lit(False))
    named = dotted & citation.endswith(head)
    braced = lambda c: F.array_join(F.transform(c, lambda v: F.concat(F.lit("("), v, F.lit(")"))), "")
    tail = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
    rest = F.when(dotted, tail).otherwise(path)
    point = F.when(F.size(rest) > 0, F.concat(F.lit(", point "), braced(rest))).otherwise("")
    numbered = F.concat(citation, F.lit(", point "), F.when(dotted & ~named, F.concat(path[0], braced(tail))).otherwise(braced(rest)))
    roman = citation.rlike(rf"^{units.roman[0]}\b")
    return (
        F.when(roman & named & (F.size(rest) == 0), citation).when(roman, numbered)
        .when(dotted & ~named, F.concat(citation, head, point)).otherwise(F.concat(citation, point))
    )


def closest_point(citation: Column, text: Column, claim: Column, units: Units = UNITS) -> Column:
    """struct(kind, name, start, shared) of the passage of text that shares most long words with claim.

    kind is `whole` for fewer than two passages, `top` where none shares enough words, else
    `point`; of equals the earlier passage wins.
    """
    words = long_words(claim)
    scored = F.transform(passages_of(text), lambda p: F.struct(F.size(F.array_intersect(words, long_words(p["text"]))).alias("shared"), (-p["start"]).alias("order"), p.alias("p")))
    best = F.array_max(F.transform(scored, lambda s: F.struct(s["shared"], s["order"], s["p"])))
    kind = F.when(F.size(scored) < 2, "whole").when(best["shared"] < LEAST_SHARED, "top").otherwise("point")
    at_point = lambda c: F.when(kind == "point", c)
    return F.struct(
        kind.alias("kind"), at_point(point_name(citation, best["p"], units)).alias("name"), at_point(best["p"]["start"]).alias("start"), at_point(best["shared"]).alias("shared"),
    )
