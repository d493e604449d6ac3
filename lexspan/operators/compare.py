"""Word diff of two texts and closest passages, as Arrow batches of pure functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_TOKEN = re.compile(r"[^\W_]+|[\W_]+")
SPANS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())]))


def common_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; of equal choices the left side moves on.

    Lengths of the rest from each word of `a` are bits of one number: bit j, from the end of `b`, is
    clear where the word there adds one.  A row takes a few operations on whole numbers, and a length is a
    count of bits.  Rows are kept at every root-th word of `a` only and made again for the
    stretch that the way passes through, so memory grows with len(b) times the root of len(a), in bits.
    """
    head = 0  # words that both begin with are taken as they stand
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    out = [(i, i) for i in range(head)]
    held = set(b[head:])
    left = [i for i in range(head, len(a)) if a[i] in held]  # the way passes by the others
    a, b = [a[i] for i in left], b[head:]
    n, m = len(a), len(b)
    if not n:
        return out
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << (m - 1 - j)
    full, step = (1 << m) - 1, max(1, int(n**0.5))

    def above(row, i):  # the row of word i of a, out of that of the word after it
        hit = row & places[a[i]]
        return (row + hit | row - hit) & full

    kept = {n: full}
    row = full
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    j = 0
    for low in range(0, n, step):
        high = min(n, low + step)
        rows = {high: kept[high]}
        for i in range(high - 1, low - 1, -1):
            rows[i] = above(rows[i + 1], i)
        for i in range(low, high):
            here, after = rows[i], rows[i + 1]
            # The left side moves on if the rest is as long without its word.
            while j < m and a[i] != b[j]:
                rest = (1 << (m - j)) - 1
                if (here & rest).bit_count() == (after & rest).bit_count():
                    break
                j += 1
            if j < m and a[i] == b[j]:
                out.append((left[i], head + j))
                j += 1
    return out


def marked(before: str | None, after: str | None) -> list[tuple[list[str], list[bool]]]:
    """The runs of both texts, each as their texts and whether they are changed; words outside the common ones are, gaps never."""
    parts = _TOKEN.findall(before or ""), _TOKEN.findall(after or "")
    first = [0 if p and p[0][0].isalnum() else 1 for p in parts]  # words and gaps take turns
    same = common_words(parts[0][first[0] :: 2], parts[1][first[1] :: 2])
    out = []
    for side in (0, 1):
        p, start = parts[side], first[side]
        kept = {pair[side] for pair in same}
        texts, marks, at = [], [], 0
        for k, i in enumerate(range(start, len(p), 2)):
            if k in kept:
                continue
            if at < i:
                texts.append("".join(p[at:i]))
                marks.append(False)
            texts.append(p[i])
            marks.append(True)
            at = i + 1
        if at < len(p):
            texts.append("".join(p[at:]))
            marks.append(False)
        out.append((texts, marks))
    return out


def diff(before: str | None, after: str | None) -> tuple[list[dict], list[dict]]:
    """Runs of both texts; words outside the common ones are changed, gaps never are."""
    old, new = ([{"text": t, "changed": c} for t, c in zip(*side)] for side in marked(before, after))
    return old, new


#: Characters of the texts whose runs are handed on together; the runs of a whole batch take many times the room of its texts.
SLICE_CHARS = 500_000
_DIFF = T.StructType([T.StructField("before", SPANS), T.StructField("after", SPANS)])


def diff_slices(before: pa.Array, after: pa.Array) -> Iterator[pa.StructArray]:
    """The diffs of a batch of pairs in their order, a few at a time."""
    kind = to_arrow_type(_DIFF)
    at, n = 0, len(before)
    while at < n:
        sides = [([0], [], []) for _ in kind]  # ends of the pairs, texts, marks
        chars = 0
        while at < n and chars < SLICE_CHARS:
            pair = before[at].as_py(), after[at].as_py()
            for (ends, texts, marks), (t, c) in zip(sides, marked(*pair)):
                texts += t
                marks += c
                ends.append(len(texts))
            chars += sum(len(x or "") for x in pair)
            at += 1
        lists = []
        for field, (ends, texts, marks) in zip(kind, sides):
            runs = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(marks, pa.bool_())], fields=list(field.type.value_type))
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs, type=field.type))
        yield pa.StructArray.from_arrays(lists, fields=list(kind))


@F.arrow_udf(_DIFF)
def word_diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for before, after in batches:
        yield from diff_slices(before, after)


def slice_spans(spans: list[dict], bounds: list[tuple[int, int]]) -> list[list[dict]]:
    """cut_spans() for each of several stretches, given in order; runs are gone through once."""
    out, k, at = [], 0, 0
    for start, end in bounds:
        while k < len(spans) and at + len(spans[k]["text"]) <= start:
            at += len(spans[k]["text"])
            k += 1
        held, i, place = [], k, at
        while i < len(spans) and place < end:
            text = spans[i]["text"][max(0, start - place) : end - place]
            held += [{"text": text, "changed": spans[i]["changed"]}] if text else []
            place += len(spans[i]["text"])
            i += 1
        out.append(held)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)])))
def passage_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """The diff of two whole texts, as the runs of each segment of the later one: changed runs joined over white space, ends trimmed."""
    from .passages import segments

    def one(old, new):
        new = new or ""
        found = segments(new)
        bounds = [(s[0], e[0]) for s, e in zip(found, [*found[1:], (len(new),)])]
        runs = slice_spans(diff(old, new)[1], bounds)
        return [{"path": s[2], "spans": trim_spans(join_spans(r))} for s, r in zip(found, runs)]

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])


def cut_spans(spans: list[dict], start: int, end: int | None = None) -> list[dict]:
    """The runs of text between two places of the text they make up."""
    out, at = [], 0
    for run in spans:
        text = run["text"][max(0, start - at) : None if end is None else max(0, end - at)]
        at += len(run["text"])
        if text:
            out.append({"text": text, "changed": run["changed"]})
    return out


def join_spans(spans: list[dict]) -> list[dict]:
    """Changed runs with nothing but white space between them made one."""
    out: list[dict] = []
    for run in spans:
        if run["changed"] and len(out) > 1 and out[-2]["changed"] and not out[-1]["changed"] and not out[-1]["text"].strip():
            gap = out.pop()["text"]
            out[-1] = {"text": out[-1]["text"] + gap + run["text"], "changed": True}
        else:
            out.append(dict(run))
    return out


def trim_spans(spans: list[dict]) -> list[dict]:
    """Without white space at either end, runs of nothing else included."""
    filled = [k for k, run in enumerate(spans) if run["text"].strip()]
    out = [dict(run) for run in spans[filled[0] : filled[-1] + 1]] if filled else []
    if out:
        out[0]["text"] = out[0]["text"].lstrip()
        out[-1]["text"] = out[-1]["text"].rstrip()
    return out
