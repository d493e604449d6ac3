"""Reports of runs: flat results, depth sensitivity, summaries with their stamp, and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import scoring


def known_questions(results: DataFrame, questions: DataFrame) -> DataFrame:
    """results joined with their questions by `question`; those of unknown ones are left out."""
    return results.join(questions, "question")


def must_know(asked: DataFrame, questions: DataFrame) -> DataFrame:
    """asked joined with questions by `question`; reading a question that is not known fails and names it."""
    joined = asked.join(questions.withColumn("_known", F.lit(True)), "question", "left")
    named = F.when(F.col("_known"), F.col("question")).otherwise(F.raise_error(F.concat(F.lit("no question "), F.col("question").cast("string"))))
    return joined.withColumn("question", named).drop("_known")


def gold_rows(questions: DataFrame) -> DataFrame:
    """question, version, gold of questions whose `gold` is a map from version to ids."""
    return questions.select("question", F.explode("gold").alias("version", "gold"))


def flat_results(answers: DataFrame) -> DataFrame:
    """One flat row an answer (question, version, arm, gold, searched, traversed, dropped, refused, expects_refusal, claims, given_text, error).

    A failed answer keeps its error and has no scores.
    """
    given = scoring.supplied(F.col("searched"), F.col("traversed"), F.col("dropped"))
    s = scoring.retrieval_score(F.col("gold"), F.col("searched"), F.col("traversed"), F.col("dropped"))
    a = scoring.answer_score(F.col("refused"), F.col("expects_refusal"), F.col("claims"), F.col("gold"), given, F.col("given_text"))
    ok = F.col("error").isNull()
    rows = answers.select("question", "version", "arm", "error", F.when(ok, s).alias("s"), F.when(ok, a).alias("a"))
    return rows.select("question", "version", "arm", "error", "s.*", "a.*")


def depth_rows(recorded: DataFrame, reached: DataFrame, depths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """version, depth, questions, recall, nodes, articles of recorded runs (query_id, version, searched, gold).

    reached: (query_id, id, hop) of one capped walk to the largest depth; its ranking is by hop
    first, so it holds the capped walks of all depths.  What was searched for is reached at any.
    """
    every = recorded.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    walked = reached.select("query_id", "hop", F.col("id").cast("string").alias("id"))
    at_depth = F.collect_set(F.when(F.col("hop") <= F.col("depth"), F.col("id")))
    per = every.join(walked, "query_id", "left").groupBy("query_id", "version", "depth").agg(F.first("searched").alias("searched"), F.first("gold").alias("gold"), at_depth.alias("w"))
    nodes = F.array_union("searched", "w")
    recall = F.coalesce(F.try_divide(F.size(F.array_intersect("gold", scoring.roots(nodes))), F.size("gold")), F.lit(0.0))
    sized = per.select("version", "depth", recall.alias("recall"), F.size(nodes).alias("n"), F.size(scoring.roots(nodes)).alias("a"))
    return sized.groupBy("version", "depth").agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("n"), 6).alias("nodes"), F.round(F.avg("a"), 6).alias("articles")
    )


def stamped(summary: DataFrame, commit: str, captured_at: str, **models: str) -> DataFrame:
    """Summary rows with the commit, the date and the models that they were made with."""
    return summary.select(F.lit(commit).alias("commit"), F.lit(captured_at).alias("captured_at"), *(F.lit(v).alias(k) for k, v in models.items()), *summary.columns)


def fixed(number: Column, digits: int) -> Column:
    """A number with so many digits after its point, rounded by its exact binary value, halves to even, as printf does.

    format_string() rounds the shortest decimal that stands for it, halves up: 60.555, a little less than that, to 60.56.
    """
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * digits))


def seconds(ms: Column, absent: str) -> Column:
    return F.when(ms.isNull(), absent).otherwise(F.format_string("%.1f s", ms / 1000))


def table_line(cells: list[Column]) -> Column:
    """Cells as a line of a table; null if one of them is."""
    marks = [F.lit(" | ")] * len(cells)
    return F.concat(F.lit("| "), *[x for pair in zip(cells, marks) for x in pair][:-1], F.lit(" |"))


def accuracy_line() -> Column:
    """The accuracy table's line of an arm_summary row."""
    two = lambda c: fixed(F.col(c), 2)
    score = lambda c: F.when(F.col(c).isNull(), "not scored").otherwise(two(c))
    of = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"))
    cells = [
        F.col("arm"), F.col("version").cast("string"), F.col("answered").cast("string"), F.col("failed").cast("string"), two("recall"), two("recall_reached"),
        fixed(F.col("precision_over_nodes"), 3), fixed(F.col("precision_over_articles"), 3), fixed(F.col("nodes_supplied"), 1),
        score("faithfulness"), score("answer_recall"), F.col("no_gold_answers").cast("string"), of("correct_refusals", "refusal_questions"), of("false_refusals", "answer_questions"), F.col("truncated").cast("string"),
    ]
    return table_line(cells)


def accuracy_lines(summary: DataFrame) -> DataFrame:
    """arm, version, line: the accuracy table's lines of arm_summary rows."""
    return summary.select("arm", "version", accuracy_line().alias("line"))


def cost_line() -> Column:
    """The cost table's line of an arm_summary row."""
    took = lambda c, absent: F.when(F.col(c).isNull(), absent).otherwise(F.concat(fixed(F.col(c) / 1000, 1), F.lit(" s")))
    cells = [
        F.col("arm"), F.col("version").cast("string"), F.col("prompt_tokens").cast("string"), F.col("completion_tokens").cast("string"),
        took("duration_ms", ""), took("first_call_ms", "failed"), took("later_calls_ms", "one call only"), F.lit("$0.00"), F.concat(F.lit("$"), fixed(F.col("projected_cost"), 2)),
    ]
    return table_line(cells)


def cost_lines(summary: DataFrame) -> DataFrame:
    """arm, version, line: the cost table's lines."""
    return summary.select("arm", "version", cost_line().alias("line"))


def question_lines(results: DataFrame) -> DataFrame:
    """question, arm, version, line: the question table's lines of results (question, flow, arm, version, recall, faithfulness, refused, refusal_correct, duration_ms, missed, error)."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    failed = [F.lit("failed")] * 4
    faith = F.when(F.col("faithfulness").isNull(), "not scored").otherwise(F.format_string("%.2f", F.col("faithfulness")))
    missed = F.when(F.size("missed") > 0, F.array_join("missed", ", ")).otherwise("nothing")
    head, took = [F.col("question").cast("string"), "flow", "arm", F.col("version").cast("string")], seconds(F.col("duration_ms"), "")
    good = F.concat_ws(" | ", *head, F.format_string("%.2f", F.col("recall")), faith, yes("refused"), yes("refusal_correct"), took, missed)
    line = F.when(F.col("error").isNotNull(), F.concat_ws(" | ", *head, *failed, took, "error")).otherwise(good)
    return results.select("question", "arm", "version", F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))


def depth_lines(rows: DataFrame) -> DataFrame:
    """version, depth, line: the sensitivity table's lines of depth_rows()."""
    cells = [F.col("version").cast("string"), F.col("depth").cast("string"), F.col("questions").cast("string"), fixed(F.col("recall"), 2), fixed(F.col("nodes"), 1), fixed(F.col("articles"), 1)]
    return rows.select("version", "depth", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def covered(chunks: DataFrame, by: str = "version") -> DataFrame:
    """by, chunks, provisions: how many chunks there are, of how many different provisions."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("provision_id").alias("provisions"))


def capture_counts(captures: DataFrame, by: str = "version") -> DataFrame:
    """by, captures, refused, failed of a capture run (version, refused, error)."""
    good = F.col("error").isNull()
    return captures.groupBy(by).agg(F.count_if(good).alias("captures"), F.count_if(good & F.col("refused")).alias("refused"), F.count_if(~good).alias("failed"))


def graph_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, edges, sources of a graph of edges (source_id, target_id) and nodes (id)."""
    n = nodes.agg(F.countDistinct("id").alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_id").alias("sources"))
    return n.join(F.broadcast(e), how="cross")


def correlation_id() -> Column:
    """A random id of four and four hexadecimal digits; it differs with every run."""
    u = F.uuid()
    return F.concat_ws("-", F.substring(u, 1, 4), F.substring(u, 5, 4))


def preview(ids: Column, most: int = 8) -> Column:
    return F.slice(ids, 1, most)


def merged_tokens(*calls: Column) -> Column:
    """Tokens over the calls of a run; calls that were not made count nothing."""
    total = F.lit(0)
    for c in calls:
        total = total + F.coalesce(c, F.lit(0))
    return total


def cited_root(citation: Column) -> Column:
    """The article id that a written citation belongs to."""
    return tx.article_root(tx.citation_to_id(citation))
