"""Aligned tokens of two tokenizers against whole-text encoding by the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lexspan.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "   ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n \tb", "x\t y", "naïve café", "▁x", "x ▁ y", "<s> hi </s>", "<|endoftext|> it's", "don't  'll", "\x00a b", "\x1c q \x1d\x1e r", "日本語 テスト", "🦆 quack🦆", "a b   c", "​ z 　 y", "é x", "12 345 6.7", "x" * 300, "the the the the", "the the the the"]


def brute(texts):
    import sentencepiece as spm
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = spm.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    byte_of = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(rest)}
    rows, links = [], []
    for t in texts:
        want = (" " + (t or "")).encode()
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        sa, sb = spans(bytes_a), spans(bytes_b)
        own = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(sa) for j, (u, v) in enumerate(sb) if max(s, u) < min(e, v)]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, (s, e) in zip(ids_a, sa) if low < e <= c) + "|" + ",".join(str(i) for i, (s, e) in zip(ids_b, sb) if low < e <= c))
            low = c
        rows.append((len(ids_a), len(ids_b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = Counter(p for own in links for p in set(own))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return [(*r[:4], sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), r[4]) for r, own in zip(rows, links)]


def mixed_texts(n=150):
    rng = random.Random(5)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "é", "ñ", "'s", ".", ",", "12", "日", "🦆", "Ab", "▁", " ", "-", "\r\n", "x" * 9]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("most", [None, 40, 0])
def test_equals_whole_encoding(spark, monkeypatch, most):
    texts = ODD + mixed_texts()
    rows = [(i + 2**60 if i % 7 else None, t, 1, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code long, row string").repartition(3)
    got = Counter(tuple(r) for r in alignment.align(docs, A, B, most).collect())
    assert got == Counter((i, *w) for (i, *_), w in zip(rows, brute(texts)))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 1_000])
def test_pieces_stitch_to_the_whole(steps):
    rng = np.random.default_rng(steps)
    for _ in range(40):
        size = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(size, int(rng.integers(0, size)), replace=False) + 1), size + 1) for _ in range(2))
        ends, i, j, both = alignment.merged(a, b, steps)
        want = sorted(set(a) | set(b))
        assert ends.tolist() == want and both.tolist() == [x in set(a) & set(b) for x in want]
        assert i.tolist() == [int((a < x).sum()) for x in want] and j.tolist() == [int((b < x).sum()) for x in want]
        cut_a, cut_b = alignment.merge_path(a, b, steps)
        assert (np.diff(cut_a) + np.diff(cut_b) <= steps).all() and cut_a[-1] == len(a) and cut_b[-1] == len(b)


def test_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(alignment, "RUN_CHARS", 500)
    monkeypatch.setattr(alignment, "PIECE_ENDS", 64)
    texts = [" ".join(f"word{i % 97} and{i % 31}," for i in range(400)), "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align(docs, A, B).orderBy("doc_id").collect()] == brute(texts)
