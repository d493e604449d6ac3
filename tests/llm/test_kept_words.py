"""Words that come up again are not encoded again, and what is kept for that is bounded."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from lexspan.llm import tokenize


class Counting:
    """A tokenizer that notes what it is given."""

    def __init__(self, tok, seen):
        self.tok, self.seen = tok, seen

    def encode_batch_fast(self, texts, **how):
        self.seen += [w for t in texts for w in ([t] if isinstance(t, str) else t)]
        return self.tok.encode_batch_fast(texts, **how)


def test_words_met_before_are_not_encoded_again():
    words, seen = tokenize.WordIds(public_tokenizers.path("word_bpe_49k.json")), []
    library, words.tok, words.bare = words.tok, Counting(words.tok, seen), Counting(words.bare, seen)
    texts = [f"Some words, (of) text {i}; don't " * 1_500 for i in range(100)]  # more than one stretch
    first = words.batch(texts)
    assert 100 < len(seen) == len(set(seen)) < 120
    assert words.batch(texts[::-1]) == first[::-1] and len(seen) < 120
    assert first[7] == np.array(library.encode(texts[7], add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_the_librarys_whatever_is_kept(monkeypatch):
    monkeypatch.setattr(tokenize, "STRETCH_CHARS", 600)
    words = tokenize.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words.stems.most, words.others.most = 40, 10
    rng = random.Random(5)
    stock = ["".join(rng.choice("aehinstéßĲ") for _ in range(rng.randint(1, 6))) + rng.choice(["", ".", "!?", "***", "'s", "1"]) for _ in range(300)]
    stock += ["x" * 200, "y" * 65 + ".", "<|endoftext|>", "é", "ǅ", "́a", "İ", "\x1c", "字"]
    for _ in range(40):
        texts = [" ".join(rng.choice(stock) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(12))]
        assert [np.frombuffer(b, "<u4").tolist() for b in words.batch(texts)] == [words.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(words.stems.words) <= 40 and len(words.others.words) <= 10


def test_most_used_words_stay_and_long_ones_do_not():
    asked = []

    def encode(words):
        asked.extend(words)
        return np.array([i for w in words for i in w.encode()], "<u4"), np.fromiter(map(len, words), np.int64, len(words))

    kept = tokenize._Kept(encode, most=10)
    for i in range(20):
        words = ["common", *(f"rare{i}-{k}" for k in range(4)), "l" * 65]
        ids, size = kept.of(pa.array(words, pa.large_string()))
        assert bytes(ids.astype("u1").tolist()).decode() == "".join(words) and size.tolist() == list(map(len, words))
        assert len(kept.words) == len(kept.size) == len(kept.used) <= 10 and len(kept.ids) == kept.size.sum() <= 10 * 64
    assert asked.count("common") == 1 and asked.count("l" * 65) == 20
