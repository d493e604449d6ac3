"""Tokens of two tokenizers over one text, aligned by merging where they end.

Both tokenizers' ends, in bytes, are two rising lists.  Binary searches on the diagonals of their
merge path cut the merging into pieces of equal work that know nothing of each other; a piece
emits the overlaps (links) that close in it, and what meets at the border of two pieces is
stitched: an end that both lists share closes a group of tokens.

Both tokenizers end a token before a space that follows another character, so texts are cut
there, and only the distinct chunks of a run of texts are encoded and merged; a text's figures
are sums over its chunks.

A link's weight is the number of documents that hold its pair of ids linked.  Each document's
distinct pairs are written with its figures; their counts are made from all of these, and a
second reading sums them.  A table of counts up to BROADCAST_PAIRS is sent to the tasks; of a
larger one the most frequent pairs are, and the rest is joined by key.

Defined cases: null or empty texts, and those whose tokens do not spell the text, have no
tokens: zeros and an empty digest; very long texts are encoded whole; repeated rows are
documents each; null ids are kept; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenize import _distinct, _slices

#: Pairs of ids whose counts are sent to all tasks at most (17 bytes each).
BROADCAST_PAIRS = 2_000_000
#: Characters of the texts whose chunks are held at once; ends merged in one piece.
RUN_CHARS, PIECE_ENDS = 6_000_000, 65_536
_SPACE = re.compile(r"(?<=\S) ")
_ODD = re.compile("[\x1c-\x1f]")
#: Whole chunks without white space of either library's.
_NO_SPACE = r"^[^\x00-\x20\x7F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+$"
#: A space between white space other than spaces: not always a place to cut.
_BETWEEN = re.compile(r"[^\S ] [^\S ]")


def chunks_of(text: str) -> list[str]:
    """Pieces of a text without the space before each; both tokenizers end a token before that space."""
    if _ODD.search(text):
        return [text]
    if "  " in text or text[0] == " " or text[-1] == " " or _BETWEEN.search(text):
        return _SPACE.split(text)
    return text.split(" ")


class Pair:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import os

        import numpy as np
        import pyarrow as pa
        import sentencepiece as spm
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = spm.SentencePieceProcessor(model_file=b_path)
        self.space = self.b.piece_to_id("▁")
        self.fast = _by_ranks(self.a)
        words = self.a.get_vocab()
        a_bytes = [b""] * (max(words.values()) + 1)
        for token, i in words.items():
            a_bytes[i] = _bytes_of(token)
        self.opens = np.array([t.startswith(b" ") for t in a_bytes])  # tokens that begin with a space
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_b = len(pieces)
        self.bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.sizes = tuple(np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes))
        # Each id as text with what may follow it.
        self.written = pa.array([b"%d%c" % (i, s) for i in range(len(a_bytes)) for s in b",|"] + [b"%d%c" % (i, s) for i in range(self.n_b) for s in b",;"], pa.large_binary())
        self.written_b = 2 * len(a_bytes)

    def encode(self, chunks):
        """Ids of both, each after the other, and how many each chunk (an Arrow array) has."""
        import numpy as np

        words = chunks.to_pylist()
        b = [x or [self.space] for at in range(0, len(words), 20_000) for x in self.b.encode(words[at : at + 20_000], num_threads=1)]
        return self._of_a(chunks, words), _flat(b, np.int64)

    def _of_a(self, chunks, words: list[str]):
        """Ids of the first tokenizer; chunks without white space are encoded as one text, where each begins with the only space."""
        import numpy as np
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(chunks, _NO_SPACE).to_numpy(zero_copy_only=False) if self.fast is not None else np.zeros(len(words), bool)
        some = words if plain.all() else [words[i] for i in np.flatnonzero(plain)]
        ids = self.fast.encode_to_numpy(" " + " ".join(some)).astype(np.int64) if some else np.empty(0, np.int64)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(some):  # not a tokenizer that begins a token at each space
            plain[:], ids, at = False, ids[:0], at[:0]
        rest, n_rest = _flat([e.ids for e in self.a.encode_batch_fast([" " + words[i] for i in np.flatnonzero(~plain)], add_special_tokens=False)], np.int64)
        sizes = np.empty(len(words), np.int64)
        sizes[plain], sizes[~plain] = np.diff(np.append(at, len(ids))), n_rest
        of, out = np.repeat(plain, sizes), np.empty(int(sizes.sum()), np.int64)
        out[of], out[~of] = ids, rest
        return out, sizes


def _flat(lists, kind):
    """Lists, one after the other, and their sizes."""
    from itertools import chain

    import numpy as np

    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), kind, int(n.sum())), n


def _by_ranks(tokenizer):
    """The same encoding by ranks, for a byte-level BPE whose ids stand in the order of its merges; else None."""
    import json

    import public_tokenizers
    import tiktoken

    said = json.loads(tokenizer.to_str())
    words, merges = said["model"]["vocab"], said["model"]["merges"]
    if said["model"]["type"] != "BPE" or said["normalizer"] or (said["pre_tokenizer"] or {}).get("type") != "ByteLevel" or not said["pre_tokenizer"].get("use_regex", True):
        return None
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    if any(words[t] != 256 + n for n, t in enumerate(joined)):
        return None
    special = {t["content"] for t in said["added_tokens"]}
    ranks = {_bytes_of(t): i for t, i in words.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bytes_of(token: str) -> bytes | None:
    """The bytes of a token of a byte-level vocabulary."""
    table = _byte_table()
    return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


@lru_cache(maxsize=1)
def _byte_table() -> dict[str, int]:
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


common.keeps("alignment", pair)


def merge_path(a, b, steps: int):
    """How many ends of a and of b lie before every steps-th place of their merging (of equal ends a's first)."""
    import numpy as np

    d = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        # The end of a at mid belongs before the diagonal if the end of b that would stand there is not smaller.
        before = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - 1 - mid, 0, max(len(b) - 1, 0))]) if len(a) and len(b) else open_
        low = np.where(before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    return low, d - low


def piece_links(a, b, i0: int, i1: int, j0: int, j1: int):
    """What closes in one piece: the ends, the token of a and of b that each closes a link of, and whether both end there."""
    import numpy as np

    own_a, own_b = a[i0:i1], b[j0:j1]
    ends = np.concatenate([own_a, own_b])
    ends.sort(kind="stable")  # two rising runs are merged
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    i, j = np.searchsorted(own_a, ends), np.searchsorted(own_b, ends)
    both = (np.append(own_a, -1)[i] == ends) & (np.append(own_b, -1)[j] == ends)
    return ends, i0 + i, j0 + j, both


def merged(a, b, steps: int = PIECE_ENDS):
    """Ends, tokens of a, tokens of b and whether both end there, of all links: the pieces, stitched."""
    import numpy as np

    if not len(a) or not len(b):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    i, j = merge_path(a, b, steps)
    pieces = [piece_links(a, b, *cut) for cut in zip(i, i[1:], j, j[1:])]
    for before, after in zip(pieces, pieces[1:]):
        # a's end closed the piece before, b's equal one opens this: one link, and the end of a group.
        if len(before[0]) and len(after[0]) and before[0][-1] == after[0][0]:
            before[3][-1] = True
    out = [np.concatenate(x) for x in zip(*pieces)]
    first = np.append(True, out[0][1:] != out[0][:-1])
    return tuple(x[first] for x in out)


class Chunks:
    """Distinct chunks of a run of texts, encoded and aligned; figures by chunk."""

    def __init__(self, tokenizers: Pair, texts: list[str]):
        import numpy as np
        import pyarrow as pa

        lists = [chunks_of(t) if t else [] for t in texts]
        self.n_docs = len(lists)
        words, self.at = _distinct(lists)
        self.size = np.fromiter(map(len, lists), np.int64, len(lists))
        self.owner = np.repeat(np.arange(len(lists)), self.size)
        (a, n_a), (b, n_b) = tokenizers.encode(words)
        words = words.to_pylist()
        spelled = [(" " + w).encode() for w in words]
        length = np.fromiter(map(len, spelled), np.int64, len(words))
        self.good = self._spells(tokenizers.bytes[0], a, n_a, spelled) & self._spells(tokenizers.bytes[1], b, n_b, spelled)
        a, b = a[np.repeat(self.good, n_a)], b[np.repeat(self.good, n_b)]
        self.n_a, self.n_b, length = n_a * self.good, n_b * self.good, length * self.good
        end_a, end_b = np.cumsum(tokenizers.sizes[0][a]), np.cumsum(tokenizers.sizes[1][b])
        ends, i, j, both = merged(end_a, end_b)
        word = np.searchsorted(np.cumsum(length), ends)  # the first chunk that ends there or after
        self.n_links = np.bincount(word, minlength=len(words))
        self.n_groups = np.bincount(word[both], minlength=len(words))
        self.link_word, self.link_code = word, a[i] * tokenizers.n_b + b[j]
        # A text with a chunk that its tokens do not spell has no tokens.
        bad = np.zeros(self.n_docs, bool)
        bad[self.owner[~self.good[self.at]]] = True
        keep = ~bad[self.owner]
        self.at, self.owner = self.at[keep], self.owner[keep]
        closed = ends[both]
        group_a, group_b = np.searchsorted(closed, end_a), np.searchsorted(closed, end_b)
        codes = np.empty(len(a) + len(b), np.int64)
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool)
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        codes[place_a] = 2 * a + last(group_a)
        codes[place_b] = tokenizers.written_b + 2 * b + last(group_b)
        text = tokenizers.written.take(pa.array(codes))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(codes) + 1]
        cuts = offsets[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        self.groups = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.ascontiguousarray(cuts)), text.buffers()[2]])

    @staticmethod
    def _spells(table, ids, n, spelled):
        """Whether each chunk's tokens, one after the other, are its bytes."""
        import numpy as np
        import pyarrow as pa

        joined = table.take(pa.array(ids))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(ids) + 1]
        cuts = offsets[np.concatenate([[0], np.cumsum(n)])]
        data = memoryview(joined.buffers()[2] or b"").cast("B")
        want = b"".join(spelled)
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        if (np.diff(cuts) == size).all() and data[int(cuts[0]) : int(cuts[-1])] == want:
            return np.ones(len(spelled), bool)
        return np.array([data[s:e] == w for s, e, w in zip(cuts.tolist(), cuts[1:].tolist(), spelled)], bool)

    def sums(self, by_chunk):
        """A figure of the chunks, summed for each text."""
        import numpy as np

        total = np.concatenate([[0], np.cumsum(by_chunk[self.at])])
        edges = np.searchsorted(self.owner, np.arange(self.n_docs + 1))
        return np.diff(total[edges])

    def links(self):
        """Of each text the codes of its linked pairs, rising, and how many links each has; and where each text begins."""
        import numpy as np

        codes, local = np.unique(self.link_code, return_inverse=True)
        size = self.n_links[self.at]
        start, end = np.cumsum(self.n_links) - self.n_links, np.cumsum(size)
        place = np.arange(end[-1] if len(end) else 0) + np.repeat(start[self.at] - (end - size), size)
        held = np.repeat(self.owner, size) * max(1, len(codes)) + local[place]
        held.sort(kind="stable")
        first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(held)))
        doc, pair_ = np.divmod(held[first], max(1, len(codes)))
        return codes[pair_], times, np.searchsorted(doc, np.arange(self.n_docs + 1))

    def digests(self) -> list[str]:
        import numpy as np
        import pyarrow as pa

        all_ = self.groups.take(pa.array(self.at))
        offsets = np.frombuffer(all_.buffers()[1], np.int64)[all_.offset : all_.offset + len(self.at) + 1]
        edges = offsets[np.searchsorted(self.owner, np.arange(self.n_docs + 1))].tolist()
        data = memoryview(all_.buffers()[2] or b"").cast("B")
        return [hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(edges, edges[1:])]


class Counts:
    """Counts of pairs by code, with whether each is the highest of its first id; sorted."""

    def __init__(self, codes, counts, best):
        import numpy as np

        order = np.argsort(codes)
        self.codes, self.counts, self.best = codes[order], counts[order], best[order]

    def of(self, codes):
        """count, best (0 or 1) and whether the pair is known, for each code."""
        import numpy as np

        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        return self.counts[at] * known, self.best[at] * known, known


def _runs(batches, column: str = "text"):
    """Parts of Arrow batches whose texts have RUN_CHARS characters or are one longer text, with the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4_096):
            part = batch.slice(at, 4_096)
            texts, done = [t or "" for t in part.column(column).to_pylist()], 0
            for some in _slices(texts, RUN_CHARS):
                yield part.slice(done, len(some)), some
                done += len(some)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"
FIGURES = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
REST = "rest array<struct<code: bigint, times: bigint>>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """ALIGNED of docs (doc_id, text): a row's own figures, and the codes of its linked pairs with their numbers of links."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        common.serve("alignment")
        tokenizers = pair(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for part, texts in _runs(batches):
            c = Chunks(tokenizers, texts)
            codes, times, edges = c.links()
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x) for x in (pa.array(codes, pa.int64()), pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.arange(row, row + len(texts)), pa.int64()), "doc_id": part.column("doc_id"),
                "n_a": pa.array(c.sums(c.n_a)), "n_b": pa.array(c.sums(c.n_b)), "n_groups": pa.array(c.sums(c.n_groups)), "n_links": pa.array(c.sums(c.n_links)),
                "groups_sha256": pa.array(c.digests(), pa.string()), "codes": lists[0], "times": lists[1],
            })
            row += len(texts)
        common.release()

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most `most` pairs reach."""
    held, least = 0, None
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("n")).toLocalIterator():
        held += r["pairs"]
        if held > most:
            return least if least is not None else r["n"] + 1
        least = r["n"]
    return 0


def weigh(table: DataFrame, known, far: bool) -> DataFrame:
    """FIGURES of a written table of ALIGNED, by the counts that are known; with far also the pairs that are not (REST)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes, times = batch.column("codes"), batch.column("times")
            edges = codes.offsets.to_numpy().astype(np.int64) - codes.offsets[0].as_py()
            code, n = codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            count, best, there = known.value.of(code)
            summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
            out = {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")}
            out |= {"n_best": pa.array(summed(best * n)), "count_sum": pa.array(summed(count * n)), "groups_sha256": batch.column("groups_sha256")}
            if far:
                pairs = pa.StructArray.from_arrays([pa.array(code[~there]), pa.array(n[~there])], ["code", "times"])
                out["rest"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~there)])[edges], pa.int32()), pairs)
            yield pa.RecordBatch.from_pydict(out)

    return table.mapInArrow(run, f"{FIGURES}, {REST}" if far else FIGURES)


def align(docs: DataFrame, a_path: str, b_path: str, most: int | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text)."""
    import numpy as np

    spark, most = docs.sparkSession, BROADCAST_PAIRS if most is None else most
    n_b = pair(a_path, b_path).n_b
    table = common.materialize(aligned(docs, a_path, b_path), "aligned")
    counts = table.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    counts = common.materialize(counts, "pair-counts").withColumn("a", F.expr(f"code div {n_b}"))
    # One row an id of the first tokenizer, whose vocabulary bounds it.
    top = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("top")))
    counts = counts.join(top, "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    far = counts.count() > most
    least = _least_count(counts, most) if far else 0
    sent = counts.where(F.col("n") >= least).toPandas()
    known = spark.sparkContext.broadcast(Counts(sent["code"].to_numpy(np.int64), sent["n"].to_numpy(np.int64), sent["best"].to_numpy(bool)))
    got = weigh(table, known, far)
    if not far:
        return got.drop("row")
    # Rare pairs: fewer documents hold each than hold any that was sent.
    got = common.materialize(got, "weighed")
    rare = got.select("row", F.explode("rest").alias("r")).select("row", "r.code", "r.times").join(counts.where(F.col("n") < least), "code")
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    both = got.drop("rest").join(more, "row", "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")


def op13_token_alignment(spark, sf_dir):
    """All documents' tokens of two tokenizers, aligned, with corpus-wide counts of the linked pairs."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
