"""Toxicity by a linear-chain conditional random field over tokens.

A token's features are its word, the beginnings of the word and its end, so that words
never seen in training are tagged by their parts.  Tokens are labelled from document
labels: a feature marks if its document frequency in toxic rows is far above that in clean
ones, and the tokens of toxic rows that have a marking feature are toxic, all others not.
Features of fewer than three training rows are left out.
The two-tag chain (feature and transition weights) is trained on all tokens of the sampled
rows by gradient ascent of its likelihood.  Forward-backward runs over every token of every
text; a document's score is a logistic function of its marginals (expected number and
highest probability of toxic tokens, number of tokens), calibrated on sampled rows that
training left aside, and runs of tokens that are rather toxic than not give the offsets.

Many texts are computed as one long chain that starts anew at each text: the chain is cut
into blocks, whose matrix products carry the messages from block to block, and the blocks
are gone through side by side.  That is exact, whatever the length of a text.

Defined cases: null and empty texts have no tokens and score as such (below 0.5, if both
kinds of labels were seen); without labels of both kinds every score is 0; very long texts
are read whole; equal texts score alike; rows that repeat an id, null ids and other columns
do no harm; labels that contradict each other for one id count as toxic; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language import sample_rows
from .tokenize import _distinct, _slices

_TOKEN = re.compile(r"\w+")
#: Bound of labelled rows a class that the model is fitted on.
ROWS_A_CLASS = 2_000
#: Lengths of the beginnings and of the end of a word that are features.
BEGINNINGS, END = (3, 4, 5, 6, 7), 3
BLOCK = 256
#: Training rows that a feature is of, at least: those of fewer say nothing on other texts.
LEAST_ROWS = 3
#: Tokens, about, that are computed side by side, and characters of texts read at once.
PART, CHARS = 400_000, 2_000_000


def tokens(text: str | None) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text or "")]


def word_features(word: str) -> list[str]:
    """`=word`, `^beginning` for each shorter one, `$end`."""
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if k < len(word)), *(["$" + word[-END:]] if len(word) > END else [])]


def chain_marginals(odds, starts, trans, moves: bool = False):
    """Probability of tag 1 of each token of a chain that starts anew where `starts` is true; expected transitions on request.

    odds: emission log-odds of tag 1; trans[a][b]: log weight from tag a to tag b.
    """
    import numpy as np

    n = len(odds)
    if not n:
        return np.empty(0), np.zeros((2, 2))
    width = -(-n // BLOCK)
    pad = BLOCK * width - n

    def blocks(x, fill):  # block k is column k
        return np.ascontiguousarray(np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(width, BLOCK).T)

    t = np.exp(trans)
    first = blocks(starts, True)
    e = np.exp(np.clip(blocks(odds, 0.0), -60, 60))
    a = [[np.where(first, 1.0, t[r][0]), np.where(first, e, t[r][1] * e)] for r in (0, 1)]
    p00, p01, p10, p11 = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for j in range(BLOCK):
        a00, a01, a10, a11 = a[0][0][j], a[0][1][j], a[1][0][j], a[1][1][j]
        p00, p01, p10, p11 = p00 * a00 + p01 * a10, p00 * a01 + p01 * a11, p10 * a00 + p11 * a10, p10 * a01 + p11 * a11
        z = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / z, p01 / z, p10 / z, p11 / z
    products = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist()))
    f, b = np.empty((2, width)), np.empty((2, width))
    x0 = x1 = 0.5
    for k, (q00, q01, q10, q11) in enumerate(products):  # messages into each block from the left
        f[0, k], f[1, k] = x0, x1
        x0, x1 = x0 * q00 + x1 * q10, x0 * q01 + x1 * q11
        z = x0 + x1
        x0, x1 = x0 / z, x1 / z
    x0 = x1 = 0.5
    for k in range(width - 1, -1, -1):  # and from the right
        b[0, k], b[1, k] = x0, x1
        q00, q01, q10, q11 = products[k]
        x0, x1 = q00 * x0 + q01 * x1, q10 * x0 + q11 * x1
        z = x0 + x1
        x0, x1 = x0 / z, x1 / z
    left = np.empty((BLOCK + 1, 2, width))
    left[0] = f
    for j in range(BLOCK):
        g0, g1 = left[j]
        h0, h1 = g0 * a[0][0][j] + g1 * a[1][0][j], g0 * a[0][1][j] + g1 * a[1][1][j]
        z = h0 + h1
        left[j + 1, 0], left[j + 1, 1] = h0 / z, h1 / z
    p = np.empty((BLOCK, width))
    sums = np.zeros((2, 2))
    inner = ~first
    b0, b1 = b
    for j in range(BLOCK - 1, -1, -1):
        y1 = left[j + 1, 1] * b1
        p[j] = y1 / (left[j + 1, 0] * b0 + y1)
        c = [[a[0][0][j] * b0, a[0][1][j] * b1], [a[1][0][j] * b0, a[1][1][j] * b1]]
        if moves:
            m = [[left[j, r] * c[r][s] for s in (0, 1)] for r in (0, 1)]
            z = m[0][0] + m[0][1] + m[1][0] + m[1][1]
            for r in (0, 1):
                for s in (0, 1):
                    sums[r, s] += (m[r][s] / z)[inner[j]].sum()
        b0, b1 = c[0][0] + c[0][1], c[1][0] + c[1][1]
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    return p.T.ravel()[:n], sums


def chain_parts(starts) -> list[tuple[int, int]]:
    """Bounds of runs of whole texts of about PART tokens or a single longer text, so that memory stays small."""
    import numpy as np

    firsts, n = np.flatnonzero(starts), len(starts)
    cuts = [0]
    while n - cuts[-1] > PART:
        at = int(np.searchsorted(firsts, cuts[-1] + PART))
        if at == len(firsts):
            break
        cuts.append(int(firsts[at]))
    return list(zip(cuts, [*cuts[1:], n]))


def text_marginals(odds, starts, trans, moves: bool = False):
    """chain_marginals of the tokens of all texts, a run of whole texts at a time."""
    import numpy as np

    out, sums = [np.empty(0)], np.zeros((2, 2))
    for lo, hi in chain_parts(starts):
        p, m = chain_marginals(odds[lo:hi], starts[lo:hi], trans, moves)
        out.append(p)
        sums += m
    return np.concatenate(out), sums


class Chain:
    """weights: feature -> log-odds of the toxic tag; bias: of any token; trans[a][b]: from tag a to tag b; scale: of the score."""

    def __init__(self, weights: dict[str, float], bias: float, trans, scale=(0.0, 1.0, 0.0, 0.0)):
        self.weights, self.bias, self.trans, self.scale = weights, bias, trans, scale

    def odds(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum([get(f, 0.0) for f in word_features(word.lower())])

    def marginals(self, lists: list[list[str]]):
        """Probabilities of the toxic tag of all tokens of the texts, one after the other, and where each text ends."""
        import numpy as np

        ends = np.cumsum([len(w) for w in lists])
        words, at = _distinct(lists)
        odds = np.array([self.odds(w) for w in words.to_numpy(zero_copy_only=False)], np.float64)[at]
        starts = np.zeros(len(odds) + 1, bool)
        starts[ends - [len(w) for w in lists]] = True
        return text_marginals(odds, starts[:-1], self.trans)[0], ends

    def scores(self, p, ends):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(document_features(p, ends) @ np.asarray(self.scale), -500, 500)))

    def score(self, words: list[str]) -> float:
        return float(self.scores(*self.marginals([words]))[0])

    def read(self, texts: list[str | None], least: float = 0.5):
        """(score, spans) of each text; a span is (start, end, probability) in characters of a run of toxic tokens."""
        import numpy as np

        for part in _slices([t or "" for t in texts], CHARS):
            p, ends = self.marginals([_TOKEN.findall(t) for t in part])
            scores = self.scores(p, ends)
            start = 0
            for text, score, end in zip(part, scores.tolist(), ends.tolist(), strict=True):
                hits = np.flatnonzero(p[start:end] >= least)
                yield score, runs(text, hits.tolist(), p[start:end]) if len(hits) else []
                start = end

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        return next(self.read([text], least))[1]


def runs(text: str, hits: list[int], p) -> list[tuple[int, int, float]]:
    places = [m.span() for m in _TOKEN.finditer(text)]
    out: list[list] = []
    for i in hits:
        if out and out[-1][3] == i - 1:
            out[-1][1:] = places[i][1], max(out[-1][2], float(p[i])), i
        else:
            out.append([*places[i], float(p[i]), i])
    return [tuple(s[:3]) for s in out]


def document_features(p, ends):
    """One, the log of the expected number of toxic tokens, the log-odds of the likeliest, the log of the number of tokens; a row a text."""
    import numpy as np

    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    n = ends - starts
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected = np.maximum(total[ends] - total[starts], 0.0)
    top = np.zeros(len(ends))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, starts[some])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.column_stack([np.ones(len(ends)), np.log(expected + 1e-3), np.log(top / (1 - top)), np.log1p(n)])


def row_frequencies(doc, at, toxic, flat, size, n: int):
    """Rows that hold each of n features, of toxic rows and of all; flat: features of each word, one after the other."""
    import numpy as np

    start = np.cumsum(size) - size
    bad, every = np.zeros(n, np.int64), np.zeros(n, np.int64)
    edges = np.searchsorted(doc, np.arange(0, len(toxic) + 100, 100))
    for lo, hi in zip(edges, edges[1:]):  # a hundred rows at a time
        if lo == hi:
            continue
        pair = np.unique(doc[lo:hi].astype(np.int64) * len(size) + at[lo:hi])
        row, word = pair // len(size), pair % len(size)
        wide = size[word]
        place = np.arange(wide.sum()) + np.repeat(start[word] - (np.cumsum(wide) - wide), wide)
        pair = np.unique(np.repeat(row, wide) * n + flat[place])
        row, feature = pair // n, pair % n
        every += np.bincount(feature, minlength=n)
        bad += np.bincount(feature[toxic[row]], minlength=n)
    return bad, every


def marking(bad, every, n_bad: int, n_clean: int, least: int = 3, odds: float = 2.5):
    """Whether toxic rows hold a feature far more often than clean ones, and far above chance: by three deviations."""
    import numpy as np

    n_bad, n_clean = max(1, n_bad), max(1, n_clean)
    other = every - bad
    value = np.log((bad + 0.5) / (n_bad + 1)) - np.log((other + 0.5) / (n_clean + 1))
    rate = (other + 1) / (n_clean + 2)
    return (bad >= least) & (value >= odds) & (bad >= n_bad * rate + 3 * np.sqrt(n_bad * rate) + 2)


def fit(texts: list[str], toxic: list[bool], aside: list[bool] | None = None, steps: int = 40, rate: float = 0.5, decay: float = 1e-3) -> Chain | None:
    """A chain trained on token labels derived from document labels, calibrated on the rows set aside (or all)."""
    from array import array

    import numpy as np
    import xxhash

    toxic = np.array(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    aside = np.zeros(len(texts), bool) if aside is None else np.array(aside, bool)
    if not (toxic[~aside].any() and toxic[aside].any() and (~toxic[aside]).any()):
        aside = np.zeros(len(texts), bool)
    vocabulary: dict[str, int] = {}
    at, lengths = array("i"), []
    for t in texts:
        found = tokens(t)
        at.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
        lengths.append(len(found))
    at, lengths, words = np.frombuffer(at, np.int32) if at else np.empty(0, np.int32), np.array(lengths), list(vocabulary)
    del vocabulary
    if not len(at):
        return Chain({}, 0.0, np.zeros((2, 2)), (float(np.log(toxic.mean() / (1 - toxic.mean()))), 0.0, 0.0, 0.0))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    starts = np.zeros(len(at), bool)
    starts[(ends - lengths)[lengths > 0]] = True
    # Features of each distinct word, as numbers one after the other.
    size = np.fromiter((len(word_features(w)) for w in words), np.int64, len(words))
    flat = np.fromiter((xxhash.xxh3_64_intdigest(f) >> 1 for w in words for f in word_features(w)), np.int64, int(size.sum()))
    feature_ids, flat = np.unique(flat, return_inverse=True)
    flat, n = flat.astype(np.int32), len(feature_ids)
    common.release()
    learnt = ~aside[doc]
    bad, every = row_frequencies(doc[learnt], at[learnt], toxic, flat, size, n)
    marks = marking(bad, every, int((toxic & ~aside).sum()), int((~toxic & ~aside).sum()))
    used = every >= LEAST_ROWS
    holder = np.repeat(np.arange(len(words), dtype=np.int32), size)[used[flat]]
    number = (np.cumsum(used) - 1).astype(np.int32)
    flat = number[flat[used[flat]]]
    marks, feature_ids, n = marks[used], feature_ids[used], int(used.sum())
    del bad, every, number, used
    common.release()
    by_word = lambda x: np.bincount(holder, x[flat], len(words))  # noqa: E731  (sums over the features of each word)
    y = ((by_word(marks.astype(float)) > 0)[at] & toxic[doc])[learnt].astype(np.float32)
    token, first = at[learnt], starts[learnt]
    del doc, learnt, size
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][~first[1:]].astype(int), y[1:][~first[1:]].astype(int)), 1)
    weights, bias, trans = np.zeros(n), -2.0, np.zeros((2, 2))
    g2, total = np.full(n, 1e-6), max(1, len(y))
    parts = chain_parts(first)
    for _ in range(steps):
        odds, push, pushed, moves = by_word(weights) + bias, np.zeros(len(words)), 0.0, np.zeros((2, 2))
        for lo, hi in parts:
            p, m = chain_marginals(odds[token[lo:hi]], first[lo:hi], trans, moves=True)
            d = y[lo:hi] - p
            np.add.at(push, token[lo:hi], d)
            pushed += d.sum()
            moves += m
        g = np.bincount(flat, push[holder], n) - decay * weights
        g2 += g * g  # adaptive steps: rare features move as far as frequent ones
        weights += rate * g / np.sqrt(g2)
        bias += 8 * rate * pushed / total
        trans = trans + 8 * rate * (seen - moves) / total
    # Calibration reads every text; the weights get their names when the tokens are gone.
    odds, x = by_word(weights) + bias, []
    for lo, hi in chain_parts(starts):
        here = (ends > lo) & (ends <= hi) & (lengths > 0)
        x.append(document_features(chain_marginals(odds[at[lo:hi]], starts[lo:hi], trans)[0], ends[here] - lo))
    features = document_features(np.empty(0), np.zeros(len(ends), np.int64))  # of texts without tokens
    features[lengths > 0] = np.concatenate(x)
    del at, starts, token, first, y
    common.release()
    kept: dict[str, float] = {}
    large = np.abs(weights) > 1e-3
    value = dict(zip(feature_ids[large].tolist(), weights[large].tolist()))
    for k in np.unique(holder[large[flat]]).tolist():
        for f in word_features(words[k]):
            w = value.get(xxhash.xxh3_64_intdigest(f) >> 1)
            if w is not None:
                kept[f] = round(w, 6)
    chain = Chain(kept, float(bias), trans)
    # Newton steps of a ridge-penalised logistic fit.
    use = aside if aside.any() else ~aside
    x, t = features[use], toxic[use].astype(float)
    scale = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(len(scale)) * 1e-1
        step = np.linalg.solve(h, x.T @ (t - q) - 1e-1 * scale)
        scale += step / max(1.0, float(np.abs(step).max()))
    chain.scale = tuple(scale.tolist())
    return chain


def train(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> Chain | None:
    """Fit on a bounded sample of the labelled rows, in one task; docs (doc_id, text), labels (doc_id, toxic)."""
    import pickle
    import zlib

    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = sample_rows(known, "toxic", rows_a_class, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * rows_a_class ids
    rows = sample_rows(rows, "toxic", rows_a_class, "doc_id", "text")  # rows that repeat an id are bounded too

    def learn(pdf):
        common.serve("toxicity")
        pdf = pdf.sort_values(["doc_id", "text"])
        aside = [zlib.crc32(f"aside {i}".encode()) % 4 == 0 for i in pdf["doc_id"].tolist()]
        chain = fit(pdf["text"].fillna("").tolist(), [bool(t) for t in pdf["toxic"]], aside)
        common.release()
        return pd.DataFrame({"model": [pickle.dumps(chain and (chain.weights, chain.bias, chain.trans, chain.scale))]})

    got = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "model binary").collect()
    kept = pickle.loads(got[0]["model"]) if got else None
    return Chain(*kept) if kept else None


def score_toxicity(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, score, spans (character offsets with probabilities) of docs (doc_id, text)."""

    def run(batches):
        common.serve("toxicity")
        for pdf in batches:
            texts = pdf["text"].tolist()
            got = list(chain.read(texts)) if chain else [(0.0, [])] * len(texts)
            spans = [[{"start": a, "end": b, "p": p} for a, b, p in found] for _, found in got]
            yield pdf[["doc_id", "no_id"]].assign(score=[s for s, _ in got], spans=spans)

    made = "score double, spans array<struct<start: long, end: long, p: double>>"
    return common.null_ids(common.whole_ids(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id long, no_id boolean, {made}"))


def held_out():
    return common.remainder(F.col("doc_id"), 5) == 0


def op10_toxicity(spark, sf_dir):
    """Toxicity scores of all documents, learned from labels not held out."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    chain = train(docs, labels.where(~held_out()))
    got = score_toxicity(docs, chain)
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scorer(chain: Chain | None):
    """A column function of a text: its score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        common.serve("toxicity")
        return pd.Series([s for s, _ in chain.read(texts.tolist())] if chain else 0.0, index=texts.index, dtype="float64")

    return score
