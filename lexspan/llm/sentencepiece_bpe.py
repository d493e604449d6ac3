"""Exact BPE encoding and decoding by backtracking over longest matches.

The pieces of the model form an Aho-Corasick automaton; at each place the longest piece is
tried first.  A piece may follow another only if merging the characters of the two again
gives the same two pieces (checked once a pair, by re-merging, then remembered).  Where no
piece fits, the last one is taken back and its next shorter prefix tried; a bitfield marks
the positions from which no encoding goes on, so none is tried twice.

No piece holds the space mark after another character, nor (looked up when the model is
loaded) letters beside other characters, so no merge spans such a place: a text is cut
there and every distinct chunk is encoded once per worker.

Defined cases: null or empty text: the end id alone, decoded to an empty text; very long
texts are encoded whole; equal texts give equal ids; of equally good merges the leftmost is
made; repeated rows, null ids and other columns do no harm; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from . import common

MARK = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHUNK = re.compile(f"{MARK}*[{_LETTERS}]+|{MARK}*[^{MARK}{_LETTERS}]+|{MARK}+")
#: For a model with pieces that hold letters beside other characters.
_COARSE_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_MIXED = re.compile(f"[{_LETTERS}][^{_LETTERS}]|[^{MARK}{_LETTERS}][{_LETTERS}]")
CACHE_CHUNKS = 250_000
#: Chunks of more characters are not kept, so that the bound holds in bytes too.
LONG_CHUNK = 64


class PieceBpe:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=path)
        self.end_id, n = sp.eos_id(), sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i] and i not in self.byte_of}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.prefixes: dict[str, list[str]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.chunk = _COARSE_CHUNK if any(map(_MIXED.search, self.id)) else _CHUNK
        self.older: dict = {}  # chunks of the generation before; those in use come back from there
        self.chunks: dict[str, tuple[int, bytes, str, tuple[int, ...]]] = {}

    def merge(self, chars: str) -> list[str]:
        """The pieces of a short string, merged best score first, then leftmost."""
        parts = list(chars)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def shorter(self, p: str) -> str | None:
        """The longest piece that is a proper prefix of p."""
        for n in range(len(p) - 1, 0, -1):
            if p[:n] in self.id:
                return p[:n]
        return None

    def encode_chunk(self, chunk: str) -> list[int]:
        n = len(chunk)
        longest = [1] * n  # of the pieces that start here; an unknown character stands for itself
        for end, size in self.automaton.iter(chunk):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        at, token = 0, chunk[: longest[0]] if n else None
        while at < n:
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.may_follow(out[-1], token)):
                    break
                token = self.shorter(token)
            if token is not None:
                out.append(token)
                at = end
                token = chunk[at : at + longest[at]] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                token = self.shorter(token)
        ids: list[int] = []
        for p in out:
            i = self.id.get(p)
            ids.extend([i] if i is not None else [self.byte[b] for b in p.encode()])
        return ids

    def _decode_pieces(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i != self.end_id:
                out.append(self.piece[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts first is taken away."""
        text = self._decode_pieces(ids)
        return text[1:] if text.startswith(" ") else text

    def known_chunks(self, text: str) -> list[tuple[int, bytes, str, tuple[int, ...]]]:
        """(number of ids, ids as decimal text with spaces after, decoded text, ids) of each chunk."""
        if not text:
            return []
        if len(self.chunks) > CACHE_CHUNKS:
            self.older, self.chunks = self.chunks, {}
        known = self.chunks
        chunks = self.chunk.findall(MARK + text.replace(" ", MARK))
        got = list(map(known.get, chunks))
        if None in got:
            for c in set(chunks):
                if c in known:
                    continue
                known[c] = self.older.get(c)
                if known[c] is None:
                    ids = tuple(self.encode_chunk(c))
                    known[c] = len(ids), b"".join(b"%d " % i for i in ids), self._decode_pieces(ids), ids
            got = list(map(known.get, chunks))
            for c in {c for c in chunks if len(c) > LONG_CHUNK}:
                del known[c]
        return got

    def encode(self, text: str) -> list[int]:
        return [i for c in self.known_chunks(text) for i in c[3]] + [self.end_id]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text."""
        n, ids, back, _ = zip(*(self.known_chunks(text) or [(0, b"", "", ())]), strict=True)
        back = "".join(back)
        back = back[1:] if back.startswith(" ") else back
        ids = b"".join(ids) + b"%d" % self.end_id
        return sum(n) + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@lru_cache(maxsize=2)
def model(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of docs (doc_id, text)."""

    def run(batches):
        bpe = model(model_path)
        for pdf in batches:
            ids = [bpe.encode(t or "") for t in pdf["text"].tolist()]
            yield pdf[["doc_id", "no_id"]].assign(ids=ids, decoded=[bpe.decode(i) for i in ids])

    return common.null_ids(common.whole_ids(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, no_id boolean, ids array<int>, decoded string"))


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As encode(), with counts and digests in place of ids and texts."""

    def run(batches):
        import pandas as pd

        bpe = model(model_path)
        for pdf in batches:
            rows = [bpe.digest(t or "") for t in pdf["text"].tolist()]
            got = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield pd.concat([pdf[["doc_id", "no_id"]].reset_index(drop=True), got], axis=1)

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.null_ids(common.whole_ids(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id long, no_id boolean, {made}"))


def op6_sentencepiece(spark, sf_dir):
    """Numbers and digests of the ids of all documents, and digests of their decoded texts."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
