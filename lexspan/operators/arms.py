"""Ways of answering over one interface: rows of questions in, rows of results out, failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ..sources.snapshots import Snapshots
from . import order

# Task prefixes that embedding models were trained with.
PREFIXES = {"nomic-embed-text": ("search_document: ", "search_query: "), "snowflake-arctic-embed2": ("", "query: ")}
RESULT = "text string, prompt_tokens long, completion_tokens long, error string"
#: Errors that a generator may meet and that become a row; any other ends the job.
EXPECTED = (TimeoutError, ConnectionError, ValueError)

#: (system, prompt) -> (text, prompt tokens, completion tokens).
Generator = Callable[[str], tuple[str, int, int]]


def embedding_text(text: Column, model: str, purpose: str) -> Column:
    """The text with the prefix of the model, its tag dropped, for a document or a query; unknown models have none."""
    document, query = PREFIXES.get(model.partition(":")[0], ("", ""))
    return F.concat(F.lit(query if purpose == "query" else document), text)


def refuse_truncated(chunks: DataFrame, count: Callable[[str], int], limit: int) -> DataFrame:
    """chunks (chunk_id, text); its read fails with the chunk's name where a text has `limit` tokens or more.

    Only texts of more than 3 * limit characters are counted: no shorter one can have so many.
    """
    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(count)

    long = F.length("text") > 3 * limit
    tokens = F.when(long, counted(F.when(long, F.col("text")).otherwise("")))
    message = F.concat("chunk_id", F.lit(" is "), tokens.cast("string"), F.lit(f" tokens against a limit of {limit}"))
    return chunks.withColumn("text", F.when(long & (tokens >= limit), F.raise_error(message)).otherwise(F.col("text")))


def generate(prompts: DataFrame, key: str, generator: Generator) -> DataFrame:
    """key with RESULT of prompts (key, prompt): one call a row; what is EXPECTED to fail is a row with its error."""
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for prompt in batch.column("prompt").to_pylist():
                try:
                    rows.append((*generator(prompt), None))
                except EXPECTED as error:
                    rows.append((None, None, None, f"{type(error).__name__}: {error}"))
            text, asked, made, error = zip(*rows) if rows else ((),) * 4
            # The key never leaves Arrow: null or large ones come back as they are.
            yield pa.RecordBatch.from_pydict({
                key: batch.column(key), "text": pa.array(text, pa.string()), "prompt_tokens": pa.array(asked, pa.int64()),
                "completion_tokens": pa.array(made, pa.int64()), "error": pa.array(error, pa.string()),
            })

    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {kind}, {RESULT}")


#: Texts of one call -> (index, vector) of each in any order, and the tokens that the call read.
Embedder = Callable[[list[str]], tuple[list[tuple[int, list[float]]], int]]
#: Texts of a call, and tries of it before its rows fail.
CALL_TEXTS, TRIES = 16, 3
EMBEDDED = "vector array<float>, call_tokens long, error string"


def embed(chunks: DataFrame, key: str, embedder: Embedder, size: int = CALL_TEXTS, tries: int = TRIES) -> DataFrame:
    """key with EMBEDDED of chunks (key, text): calls of `size` texts, filled over the batches of a task.

    Vectors are put in order by their index.  A call that fails as EXPECTED, or does not give one
    vector a text, is made again; after the last try its rows hold the error and no vector.
    """
    kind = dict(chunks.dtypes)[key]

    def call(texts: list[str]):
        for left in range(tries - 1, -1, -1):
            try:
                got, tokens = embedder(texts)
                if sorted(i for i, _ in got) != list(range(len(texts))):
                    raise ValueError(f"asked for {len(texts)} vectors and got {len(got)}")
                return [v for _, v in sorted(got, key=lambda x: x[0])], tokens, None
            except EXPECTED as error:
                if not left:
                    return [None] * len(texts), None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator):
        import pyarrow as pa

        held = None

        def made(rows):
            vectors, tokens, error = call(rows.column("text").to_pylist())
            n = rows.num_rows
            return pa.RecordBatch.from_pydict({
                key: rows.column(key).combine_chunks() if isinstance(rows, pa.Table) else rows.column(key), "vector": pa.array(vectors, pa.list_(pa.float32())),
                "call_tokens": pa.array([tokens] * n, pa.int64()), "error": pa.array([error] * n, pa.string()),
            })

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            whole = rows.num_rows // size * size
            for at in range(0, whole, size):
                yield made(rows.slice(at, size))
            held = rows.slice(whole)
        if held is not None and held.num_rows:
            yield made(held)

    return chunks.where("text is not null").select(key, "text").mapInArrow(run, f"{key} {kind}, {EMBEDDED}")


def embed_missing(chunks: DataFrame, key: str, embedder: Embedder, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """The vectors stored at a path (key, vector) and the failures of this run (key, error).

    Chunks whose keys the store holds are not sent again; what succeeds is added in one commit, so
    a run after a failed one does only the rest.
    """
    store = Snapshots(chunks.sparkSession, path)
    known = store.rows("vectors")
    todo = chunks if known is None else chunks.join(known.select(key), key, "left_anti")
    # Written before it is looked at twice: each text is sent once.
    got = materialize(embed(todo, key, embedder, **options), "embedded")
    store.append(got.where("error is null").select(key, "vector"), "vectors")
    return store.rows("vectors"), got.where("error is not null").select(key, "error")


#: Characters of a piece of a prompt, about.
PIECE_CHARS = 100_000


def stuffed(provisions: DataFrame, group: str, budget: int) -> DataFrame:
    """provisions but paragraphs with `place` (from 0, document order), and whether each is `kept`: the prefix that the budget holds.

    A block costs its text, its citation and 8 characters; the first one is always kept.
    """
    rows = provisions.where("kind <> 'paragraph'")
    cost = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("citation"), F.lit(0)) + 8
    return order.running(rows, group, ["ord", "id"], cost).withColumn("kept", (F.col("running") <= budget) | (F.col("place") == 0))


def prompt_pieces(placed: DataFrame, group: str) -> DataFrame:
    """group, piece, n, text of what stuffed() keeps: its numbered blocks, joined in order, in pieces of about PIECE_CHARS."""
    block = F.concat(F.lit("["), (F.col("place") + 1).cast("string"), F.lit("] "), F.coalesce("citation", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = placed.where("kept").select(group, F.floor(F.col("running") / PIECE_CHARS).alias("piece"), "place", block.alias("block"))
    held = F.sort_array(F.collect_list(F.struct("place", "block")))
    return rows.groupBy(group, "piece").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(held, lambda x: x["block"]), "\n\n").alias("text"))


def prompts(pieces: DataFrame, group: str) -> DataFrame:
    """group, supplied, prompt of prompt_pieces(): as long as the budget at most, however large the version is."""
    held = F.sort_array(F.collect_list(F.struct("piece", "text")))
    return pieces.groupBy(group).agg(F.sum("n").alias("supplied"), F.array_join(F.transform(held, lambda x: x["text"]), "\n\n").alias("prompt"))


def full_context(questions: DataFrame, provisions: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The arm that hands over a whole version, as far as the budget goes; nothing is searched or walked.

    question, version, prompt_key, supplied, dropped of questions (question, version); and the
    prompts, one row a version: prompt_key, prompt.  Questions name their prompt by its key.
    """
    placed = stuffed(provisions, "version", budget)
    made = materialize(prompts(prompt_pieces(placed, "version"), "version").withColumn("prompt_key", F.sha2("prompt", 256)), "prompts")
    counts = placed.groupBy("version").agg(F.count_if(~F.col("kept")).alias("dropped"))
    # One row a version, without its text.
    keys = made.select("version", "prompt_key", "supplied").join(counts, "version")
    return questions.join(keys, "version").select("question", "version", "prompt_key", "supplied", "dropped"), made.select("prompt_key", "prompt")


def search_only(hits: DataFrame) -> DataFrame:
    """The arm that hands over search results (question, version, id, rank), each provision once, by its best rank."""
    best = hits.groupBy("question", "version", "id").agg(F.min("rank").alias("rank"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "id")))
    none = F.array().cast("array<string>")
    return best.groupBy("question", "version").agg(F.transform(listed, lambda x: x["id"]).alias("searched")).withColumn("traversed", none)


def search_traversal(searched: DataFrame, walked: DataFrame) -> DataFrame:
    """search_only with what a walk (question, version, id, rank) reached from there."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "id")))
    reached = walked.groupBy("question", "version").agg(F.transform(listed, lambda x: x["id"]).alias("traversed"))
    none = F.array().cast("array<string>")
    return searched.drop("traversed").join(reached, ["question", "version"], "left").withColumn("traversed", F.coalesce("traversed", none))


def search_k(k: Column, default: int = 12) -> Column:
    """How many to search for: none or 0 stands for the default."""
    return F.coalesce(F.nullif(k, F.lit(0)), F.lit(default))


def retried(first: Column, second: Column, hit_window: Column) -> Column:
    """The completion that counts: the second where the first was cut by its budget, not by the window; tokens add up."""
    again = (first["finish"] == "length") & ~hit_window
    return F.struct(
        F.when(again, second["text"]).otherwise(first["text"]).alias("text"), F.when(again, second["finish"]).otherwise(first["finish"]).alias("finish"),
        (first["prompt_tokens"] + F.when(again, second["prompt_tokens"]).otherwise(0)).alias("prompt_tokens"),
        (first["completion_tokens"] + F.when(again, second["completion_tokens"]).otherwise(0)).alias("completion_tokens"),
    )


def narrowed(sweep: DataFrame, arms: list[str] | None = None, versions: list[str] | None = None, first: int | None = None) -> DataFrame:
    """A sweep (arm, version, call_index) of some arms, versions and the first questions; None, and 0 questions, stand for all."""
    out = sweep if not arms else sweep.where(F.col("arm").isin(*arms))
    out = out if not versions else out.where(F.col("version").isin(*versions))
    return out if not first else out.where(F.col("call_index") < first)


def request_is_sound(description: Column, body_bytes: Column) -> Column:
    """Whether a request may be answered: 1 to 4,000 characters after trimming, in a body of 16,384 bytes at most."""
    n = F.length(F.regexp_replace(description, r"(?U)^\s+|\s+$", ""))
    return n.between(1, 4_000) & (body_bytes <= 16_384)


def header(results: DataFrame) -> DataFrame:
    """questions, runs, failures of a report."""
    return results.agg(F.countDistinct("question").alias("questions"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("error").isNotNull()).alias("failures"))


def in_arm_order(rows: DataFrame, arms: list[str]) -> DataFrame:
    """rows with `place` by the order of arms, then version."""
    at = F.array_position(F.array(*map(F.lit, arms)), F.col("arm"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(at, "version")))
