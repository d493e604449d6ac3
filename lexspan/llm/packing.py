"""Best-fit packing of token sequences by swap-based local search.

Documents are encoded once, cut into pieces of at most `capacity` tokens and dealt at
random into groups of bounded size.  A group starts from best fit by falling length; where search does
not bring that down to the fewest bins there could be, it starts from the order dealt too, and
the better end is taken.  Local search empties bins, emptiest first: it moves a document to the fullest bin that holds
it, or swaps one or two for one of any other underfull bin, each step raising the sum of
squared fills, until no bin has a step left or the total needs every bin.  Bins that stay
underfull release their pieces to a second round of groups, so what is lost does not add
up over groups.

Defined cases: null or empty text: the end id alone; null ids stay null; repeated rows are
packed as often as they come; a very long text is cut into full pieces and a last one that
is packed like any other; of equal choices the bin or piece that came first is taken; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenize import word_ids

GROUP_PIECES = 16_384
PIECE_SCHEMA = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, salt long"
PACKED_SCHEMA = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, salt long, bin long, offset long, fill long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document (doc_id, text); `salt` is unique; with_ids adds the token ids.

    A null id stands as 0 with `no_id`, so that ids pass through pandas whole.
    """
    schema = PIECE_SCHEMA + (", ids array<long>" if with_ids else "")

    def cut(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        common.serve("tokenize")
        words, end = word_ids(tokenizer_path), int(end_id).to_bytes(4, "little")
        salt = TaskContext.get().partitionId() << 40
        step = 4 * capacity
        for pdf in batches:
            rows = []
            for doc, none, ids in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), words.batch([t or "" for t in pdf["text"].tolist()]), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    salt += 1
                    row = (doc, none, at // step, at // 4, len(part) // 4, zlib.crc32(part), salt)
                    rows.append(row + (np.frombuffer(part, "<u4").astype("int64").tolist(),) if with_ids else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        common.release()

    return common.whole_ids(docs.select("doc_id", "text")).mapInPandas(cut, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: each item, in the order given, goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set where a bin with room r exists
    for i, n in enumerate(lengths):
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        open_rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins, emptiest first, by moves, one-for-one and two-for-one swaps that raise squared fill.

    Every underfull bin is looked at for each step; it ends when no step is left for any bin,
    or when the total can't be held by one bin less.
    """
    state = _Underfull(bins, lengths, capacity)
    moved = True
    while moved and state.spare >= capacity:
        moved = False
        for s in sorted(state.alive(), key=lambda k: (state.fill[k], k)):
            if state.spare >= capacity and 0 < state.fill[s] < capacity:
                moved |= state.drain(s)
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: local search from best fit by falling length, and from the order given if bins may still be saved."""
    least, best = -(-sum(lengths) // capacity), None
    for order in (sorted(range(len(lengths)), key=lambda i: -lengths[i]), list(range(len(lengths)))):
        start = [[order[i] for i in b] for b in best_fit([lengths[i] for i in order], capacity)]
        bins = local_search(start, lengths, capacity)
        best = bins if best is None or len(bins) < len(best) else best
        if len(best) <= least:
            break
    return best


class _Underfull:
    """Bins by room, for moves; pieces by length and room of their bin, for swaps."""

    def __init__(self, bins, lengths, capacity):
        import numpy as np

        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.spare = sum(capacity - f for f in self.fill if f)
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.open_rooms = 0  # bit r is set where a bin with room r exists
        for k in self.alive():
            self._open(k)
        self.length = np.array(lengths, np.int64)
        self.owner = np.empty(len(lengths), np.int64)
        for k, b in enumerate(bins):
            self.owner[b] = k
        self.room = np.array([capacity - f for f in self.fill], np.int64)

    def alive(self):
        return [k for k, f in enumerate(self.fill) if 0 < f < self.capacity]

    def _open(self, k):
        room = self.capacity - self.fill[k]
        if 0 < room < self.capacity:
            self.by_room[room].add(k)
            self.open_rooms |= 1 << room

    def _close(self, k):
        room = self.capacity - self.fill[k]
        if 0 < room < self.capacity:
            self.by_room[room].discard(k)
            if not self.by_room[room]:
                self.open_rooms &= ~(1 << room)

    def drain(self, s: int) -> bool:
        """Steps from bin s until it is empty or full or has none left; whether there was any."""
        any_step = False
        while 0 < self.fill[s] < self.capacity and self.spare >= self.capacity and (self.move(s) or self.swap(s)):
            any_step = True
        return any_step

    def move(self, s: int) -> bool:
        """Moves the longest piece of s that fits elsewhere to the fullest bin that holds it."""
        self._close(s)
        to = None
        for i in sorted(self.bins[s], key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            fits = self.open_rooms >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                if self.capacity - room + n > self.fill[s]:  # squared fill rises
                    to = min(self.by_room[room])
                    break
        self._open(s)
        if to is None:
            return False
        self.shift(s, to, [i], [])
        return True

    def swap(self, s: int) -> bool:
        """The swap of one or two pieces of s for one of another bin that shifts most, if any raises squared fill."""
        import numpy as np

        own = self.capacity - self.fill[s]
        room = self.room[self.owner]
        usable = np.flatnonzero((self.owner != s) & (room > 0) & (room < self.capacity))
        if not len(usable):
            return False
        length, room = self.length[usable], room[usable]
        # x leaves s for a piece of length y of a bin with room r, if d = x - y has 0 < d <= r and r - own < d.
        lo, hi = length + np.maximum(1, room - own + 1), length + room
        mine = sorted(self.bins[s], key=lambda i: self.lengths[i])
        seen, ways = set(), []
        for a, i in enumerate(mine):
            for out in ([i], *([i, j] for j in mine[a + 1 :])):
                x = sum(self.lengths[k] for k in out)
                if x <= self.capacity and x not in seen:
                    seen.add(x)
                    ways.append((x, out))
        # Of each x the shortest piece that it can be swapped for, from the fullest such bin.
        best = (0,)
        for x, out in ways:
            can = np.flatnonzero((lo <= x) & (x <= hi))
            if len(can):
                n = can[np.lexsort((usable[can], room[can], length[can]))[0]]
                best = max(best, (x - int(length[n]), -len(out), out, int(usable[n])))
        if not best[0]:
            return False
        _, _, out, back = best
        self.shift(s, int(self.owner[back]), out, [back])
        return True

    def shift(self, s, t, out, back):
        self._close(s)
        self._close(t)
        for i in out:
            self.bins[s].remove(i)
            self.bins[t].append(i)
            self.owner[i] = t
        for i in back:
            self.bins[t].remove(i)
            self.bins[s].append(i)
            self.owner[i] = s
        d = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back)
        self.fill[s] -= d
        self.fill[t] += d
        self.room[s] += d
        self.room[t] -= d
        if not self.fill[s]:
            self.spare -= self.capacity
        self._open(s)
        self._open(t)


def _pack_round(pieces: DataFrame, capacity: int, groups: int, tag: int) -> DataFrame:
    def pack(pdf):
        pdf = pdf.sort_values("salt")
        lengths = pdf["length"].tolist()
        bins = pack_lengths(lengths, capacity)
        at, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        base = (tag << 60) + (int(pdf["g"].iloc[0]) << 20)
        for k, b in enumerate(bins):
            n, whole = 0, sum(lengths[i] for i in b)
            for i in b:
                at[i], offset[i], fill[i] = base + k, n, whole
                n += lengths[i]
        return pdf.drop(columns="g").assign(bin=at, offset=offset, fill=fill)

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("salt", F.lit(tag)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(pack, PACKED_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int, full_enough: float = 0.995) -> DataFrame:
    """Pieces (a written table) with their bin and offset; underfull bins are dealt and packed once more."""
    cols = [c for c in PIECE_SCHEMA.replace(",", "").split() if c in pieces.columns]
    n = pieces.count()
    one = common.materialize(_pack_round(pieces.select(*cols), capacity, max(1, -(-n // GROUP_PIECES)), 0), "packed")
    under = F.col("fill") < int(capacity * full_enough)
    again = one.where(under).select(*cols)
    m = again.count()
    if n <= GROUP_PIECES or not m:  # a single group has met all pieces already
        return one
    two = _pack_round(again, capacity, max(1, -(-m // GROUP_PIECES)), 1)
    return one.where(~under).unionByName(two)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of docs (doc_id, text)."""
    pieces = common.materialize(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    packed = pack_pieces(pieces, capacity)
    return common.null_ids(packed).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def op1_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4,096 tokens; a row a piece."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
