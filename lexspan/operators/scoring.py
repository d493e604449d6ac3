"""Scores of one answer as column expressions: what was retrieved, and what the answer rests on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx


def supplied(searched: Column, traversed: Column, dropped: Column) -> Column:
    """What reached the model, in order: searched, then traversed, less dropped."""
    return F.filter(F.concat(searched, traversed), lambda x: ~F.array_contains(dropped, x))


def roots(ids: Column) -> Column:
    return F.array_distinct(F.transform(ids, tx.article_root))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(part), F.size(whole)), F.lit(0.0))


def retrieval_score(gold: Column, searched: Column, traversed: Column, dropped: Column) -> Column:
    """struct of recall, recall_reached, both precisions, both counts, found and missed; gold holds article ids.

    Everything is over what was supplied but recall_reached, which is over what was reached.
    Empty sets score 0.
    """
    gold = F.array_distinct(gold)
    given = supplied(searched, traversed, dropped)
    articles = roots(given)
    found, reached = F.array_intersect(gold, articles), F.array_intersect(gold, roots(F.concat(searched, traversed)))
    relevant = F.filter(given, lambda x: F.array_contains(gold, tx.article_root(x)))
    return F.struct(
        _share(found, gold).alias("recall"), _share(reached, gold).alias("recall_reached"), _share(relevant, given).alias("precision_over_nodes"),
        _share(found, articles).alias("precision_over_articles"), F.size(given).alias("nodes_supplied"), F.size(articles).alias("articles_supplied"),
        F.array_sort(found).alias("found"), F.array_sort(F.array_except(gold, articles)).alias("missed"),
    )


def answer_score(refused: Column, expects_refusal: Column, claims: Column, gold: Column, given: Column, given_text: Column, threshold: float = tx.GROUNDED) -> Column:
    """struct of an answer's score; claims: array<struct<statement, cited array<string>>>, given: ids supplied, given_text: their texts.

    A refusal has no faithfulness and nothing cited; an answer without claims has 0.
    """
    gold = F.array_distinct(gold)
    claims = F.when(refused, F.slice(claims, 1, 0)).otherwise(claims)
    support = tx.content_words(given_text)
    shares = F.transform(claims, lambda c: tx.share_grounded(tx.content_words(c["statement"]), support))
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    cited = F.array_distinct(F.flatten(F.transform(claims, lambda c: c["cited"])))
    cited_roots = roots(cited)
    on_gold = F.filter(claims, lambda c: F.arrays_overlap(roots(c["cited"]), gold))
    return F.struct(
        refused.alias("refused"), (refused == expects_refusal).alias("refusal_correct"),
        F.when(~refused, F.coalesce(F.try_divide(total, F.size(claims)), F.lit(0.0))).alias("faithfulness"), F.size(claims).alias("claims"),
        F.size(F.filter(shares, lambda x: x < threshold)).alias("ungrounded_claims"), F.array_sort(F.array_except(cited, given)).alias("citations_not_supplied"),
        F.array_sort(cited_roots).alias("cited_ids"), _share(F.array_intersect(gold, cited_roots), gold).alias("answer_recall"), F.size(on_gold).alias("claims_on_gold"),
    )


def uncited(draft: Column, citations: Column) -> Column:
    """Distinct ids of citations that no bracketed number of the draft names, in order."""
    named = F.filter(tx.markers_in(draft), lambda n: (n >= 1) & (n <= F.size(citations)))
    return F.array_except(citations, F.transform(named, lambda n: F.try_element_at(citations, n)))


def prompt_block(items: Column) -> Column:
    """Numbered blocks `[i] citation`, text, of array<struct<citation, text>>, i from 1, a blank line between."""
    block = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["citation"], F.lit("\n"), x["text"])
    return F.array_join(F.transform(items, block), "\n\n")


def prompt_was_cut(prompt_chars: Column, prompt_tokens: Column, loosest: float = 6.5) -> Column:
    """Whether a server read fewer tokens than so many characters can come to."""
    return prompt_tokens < F.floor(prompt_chars / loosest)


def hit_window(finish: Column, prompt_tokens: Column, completion_tokens: Column, window: int, margin: int = 64) -> Column:
    """Whether a completion was cut by the window, not by its budget."""
    return (finish == "length") & (prompt_tokens + completion_tokens >= window - margin)
