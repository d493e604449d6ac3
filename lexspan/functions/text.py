"""Column functions over texts: citations, ids, content words, grounding, dates, passages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .units import UNITS, Units

# Words that carry no content, the pattern of content words, months, timing questions.
STOPWORDS = "about above after also been being both each from have into more must only other over shall should such than that their them then there these they this those under when where which will with would your".split()
CONTENT_WORD = r"[a-z][a-z'-]{3,}"
MONTHS = "January February March April May June July August September October November December".split()
DATE = rf"(?i)\b(?:\d{{1,2}}\s+)?({'|'.join(MONTHS)})\s+(\d{{4}})\b"
ASKS_WHEN = r"(?i)\b(?:from\s+when|when\s+(?:do|does|did|will|must|should|are|is)|deadlines?)\b"
GROUNDED = 0.6


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    return collapse(nfkc(text))


def strip_markers(text: Column) -> Column:
    """Without consolidation markers."""
    return normalize(F.regexp_replace(text, "▼(?:M[0-9]+|B)\\s*—*", ""))


def comparable(text: Column) -> Column:
    """White space collapsed, none before closing punctuation."""
    return F.regexp_replace(collapse(text), r"\s+([.,;:)])", "$1")


def lookup_key(text: Column) -> Column:
    return F.lower(collapse(text))


def citation(kind: Column, number: Column, parent_id: Column, units: Units = UNITS) -> Column:
    """How a provision is cited; a paragraph by its article, any unknown kind as a chapter."""
    article = units.article
    named = lambda name: F.concat(F.lit(name + " "), number)
    paragraph = F.concat(F.lit(article[0] + " "), F.regexp_replace(parent_id, f"^{article[1]}_", ""), F.lit("("), number, F.lit(")"))
    return (
        F.when(kind == "paragraph", paragraph).when(kind == "article", named(article[0])).when(kind == "roman", named(units.roman[0]))
        .when(kind == "recital", named(units.recital[0])).otherwise(named(units.chapter[0]))
    )


def citation_to_id(text: Column, units: Units = UNITS) -> Column:
    """The id that a written citation names, or null."""
    t = strip(text)
    part = lambda pattern, g: F.regexp_extract(t, f"(?i)^{pattern}$", g)
    of_article = rf"{units.article[0]}\s+(\d+[a-z]?)(?:\s*\(\s*(\d+[a-z]?)\s*\))?"
    article, paragraph = part(of_article, 1), part(of_article, 2)
    roman, recital = part(rf"{units.roman[0]}\s+([ivxlc]+)", 1), part(rf"{units.recital[0]}\s+(\d+)", 1)
    named = lambda prefix, *rest: F.concat(F.lit(prefix + "_"), *rest)
    return (
        F.when(paragraph != "", named(units.article[1], article, F.lit("."), paragraph)).when(article != "", named(units.article[1], article))
        .when(roman != "", named(units.roman[1], F.upper(roman))).when(recital != "", named(units.recital[1], recital))
    )


def article_root(provision_id: Column) -> Column:
    return F.substring_index(provision_id, ".", 1)


def content_words(text: Column) -> Column:
    """Distinct content words of a text in lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(CONTENT_WORD), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def share_grounded(claim_words: Column, support_words: Column) -> Column:
    """Share of the claim's words that the support holds; 0 for a claim without any."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(claim_words, support_words)), F.size(claim_words)), F.lit(0.0))


def dates_in(text: Column) -> Column:
    """Distinct `month year` of a text, months in lower case."""
    months, years = (F.regexp_extract_all(text, F.lit(DATE), F.lit(g)) for g in (1, 2))
    return F.array_distinct(F.zip_with(months, years, lambda m, y: F.concat(F.lower(m), F.lit(" "), y)))


def split_thinking(text: Column) -> Column:
    """The reply without its reasoning, also where that is never closed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*", ""))


def pack_points(text: Column, separator: str = r"(?<=\s)(?=\(\d+\)\s)", budget: int = 6000) -> Column:
    """Parts of a text, cut before its points and filled greedily up to the budget; a longer point stays whole.

    Blank points are dropped and parts stripped; a text that fits the budget or has fewer than
    two points is one part as it stands; null gives no part.
    """
    points = F.filter(F.split(text, separator), lambda p: strip(p) != "")
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"))

    def add(state: Column, point: Column) -> Column:
        fits = (F.length(state["now"]) + F.length(point) <= budget) | (state["now"] == "")
        return F.struct(
            F.when(fits, state["parts"]).otherwise(F.concat(state["parts"], F.array(state["now"]))).alias("parts"),
            F.when(fits, F.concat(state["now"], point)).otherwise(point).alias("now"),
        )

    parts = F.aggregate(points, empty, add, lambda s: F.concat(s["parts"], F.array(s["now"])))
    whole = (F.length(text) <= budget) | (F.size(points) < 2)
    return F.when(text.isNull(), F.array().cast("array<string>")).when(whole, F.array(text)).otherwise(F.transform(parts, strip))


def projected_cost(prompt_tokens: Column, completion_tokens: Column, prompt_rate: float = 3.0, completion_rate: float = 15.0) -> Column:
    return prompt_tokens / 1e6 * prompt_rate + completion_tokens / 1e6 * completion_rate


# Why an answer is refused, and what is then said to be missing.
DECLARED = "The retrieved provisions do not settle the question."
DECLARED_MISSING = "what the text leaves open"
FALLBACK = "The model produced no statement resting on a retrieved provision."
FALLBACK_MISSING = "a provision of the Act that addresses the description"
CUT = "Generation stopped before any statement was finished, rather than the text leaving nothing to cite."
CUT_MISSING = "the rest of the draft, cut off before it named a provision"


def markers_in(text: Column) -> Column:
    """Numbers in square brackets, in order; longer numbers than can count anything are left out."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))


def parse_draft(draft: Column, n_citations: Column, cut: Column | None = None) -> Column:
    """struct(refused, reason, missing, claims: array<struct<statement, cited array<int>>>) of a drafted answer.

    Lines are stripped and blank ones dropped.  A line that starts with REFUSE, in any case,
    wins over claims and what follows is missing; a claim is a line with a valid [n] marker
    and words beside its markers.  A draft without either is refused too, as cut off where
    `cut` is true.  A null draft has no lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(draft, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), strip), lambda s: s != "")
    bare = lambda s: F.regexp_replace(s, r"\[\d+\]", "")
    refuse = lambda s: F.upper(s).startswith("REFUSE")
    declared = F.exists(lines, refuse)
    at = F.array_position(F.transform(lines, refuse), True)
    later = F.transform(F.slice(lines, F.greatest(at, F.lit(1)).cast("int") + 1, F.size(lines)), lambda s: strip(bare(F.regexp_replace(s, r"^[- ]+", ""))))
    valid = lambda s: F.array_distinct(F.filter(markers_in(s), lambda n: (n >= 1) & (n <= n_citations)))
    statement = lambda s: F.regexp_replace(bare(s), r"^[ .-]+|[ .-]+$", "")
    claims = F.filter(F.transform(lines, lambda s: F.struct(statement(s).alias("statement"), valid(s).alias("cited"))), lambda c: (F.size(c["cited"]) > 0) & (c["statement"] != ""))
    cut = F.coalesce(cut, F.lit(False)) if cut is not None else F.lit(False)
    reason = F.when(declared, DECLARED).when(F.size(claims) > 0, F.lit(None).cast("string")).when(cut, CUT).otherwise(FALLBACK)
    missing = (
        F.when(declared & (F.size(later) > 0), later).when(declared, F.array(F.lit(DECLARED_MISSING))).when(F.size(claims) > 0, F.array().cast("array<string>"))
        .when(cut, F.array(F.lit(CUT_MISSING))).otherwise(F.array(F.lit(FALLBACK_MISSING)))
    )
    return F.struct(reason.isNotNull().alias("refused"), reason.alias("reason"), missing.alias("missing"), F.when(declared, F.slice(claims, 1, 0)).otherwise(claims).alias("claims"))
