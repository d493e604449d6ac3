"""What a task holds at once: short runs of texts, and sets of a stretch only once."""

import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from lexspan.llm import jaccard, tokenize


def test_word_ids_hold_short_runs_of_a_batch(monkeypatch):
    words = tokenize.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"Some words, of text {i}; " * 130 for i in range(400)] + ["", "a-b " * 200_000, "end"]
    held, whole = [], tokenize.WordIds._slice
    monkeypatch.setattr(tokenize.WordIds, "_slice", lambda self, part: held.append(part) or whole(self, part))
    got = words.batch(texts)
    assert [t for part in held for t in part] == texts
    assert max(sum(map(len, part)) for part in held if len(part) > 1) <= 500_000
    for i in (0, 1, 150, 151, 399, 400, 402):
        assert got[i] == np.array(words.tok.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_frequent_counts_as_unique_does(least):
    rng = np.random.default_rng(least)
    for n in (0, 1, 2, 3, 500):
        sets = [np.unique(rng.integers(-40, 40, rng.integers(0, 30))) for _ in range(n)]
        h, k = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_counts=True)
        got = jaccard.frequent(sets, least)
        assert [x.tolist() for x in got] == [h[k >= least].tolist(), k[k >= least].tolist()] and not sets


def test_frequent_holds_the_sets_twice_at_most():
    tracemalloc.start()
    try:
        sets = [np.arange(i * 900, i * 900 + 1_000) for i in range(1_000)]
        size, _ = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        jaccard.frequent(sets, 3)
        assert tracemalloc.get_traced_memory()[1] < 2.2 * size
    finally:
        tracemalloc.stop()
