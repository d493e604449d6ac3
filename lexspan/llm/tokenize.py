"""Word-cached use of the public tokenizers inside tasks.

Every tokenizer here splits a text at places that depend only on the characters next to
them, so a text is cut there, each distinct word is encoded once per worker by the library
itself, and a text's ids are the concatenation of its words' ids.  Caches are bounded; a
text with characters on which Python and the library disagree goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain

from . import common

CACHE_WORDS = 300_000
#: Words kept with their ids at most, and characters of the texts whose distinct words are looked up at once.
KEPT_WORDS, STRETCH_CHARS = 100_000, 1_000_000
#: Words of more characters are not kept.
LONG_WORD = 64
#: Characters of the texts whose words are held at once.
SLICE_CHARS = 8_000_000
#: Control characters that Python counts as white space and the libraries do not.
_ODD = re.compile("[\x1c-\x1f]")
# Letters of the Latin blocks that have one lower-case letter (not U+0130), and closing punctuation.
_CLOSING = ".,;:!?"
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"
_PLAIN = f"{_LETTERS}[{_CLOSING}]*$"
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _slices(texts: list[str], chars: int = SLICE_CHARS):
    """Runs of texts of so many characters or a single longer text."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def _distinct(lists: list[list[str]]):
    """Distinct words of lists (an Arrow array), and the index in them of every word."""
    import numpy as np
    import pyarrow as pa

    coded = pa.array(list(chain.from_iterable(lists)), pa.large_string()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _gather(values, size, at):
    """The runs (of `size` values each, one after the other) at the places `at`, joined, and their sizes."""
    import numpy as np

    start = np.cumsum(size) - size
    n = size[at]
    end = np.cumsum(n)
    place = np.arange(end[-1] if len(end) else 0) + np.repeat(start[at] - (end - n), n)
    return values[place], n


class _Words:
    """A bounded map from a word to what `encode` makes of it, filled a batch at a time.

    Two generations: words still in use come back from the older one.  Words longer than
    LONG_WORD are encoded for their batch and not kept, so the bound holds in bytes too.
    """

    def __init__(self, encode):
        self.encode, self.known, self.older, self.long = encode, {}, {}, []

    def of(self, words: list[str]) -> dict:
        for w in self.long:
            self.known.pop(w, None)
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        missing = [w for w in words if w not in self.known]
        self.long = [w for w in missing if len(w) > LONG_WORD]
        self.fill(missing)
        return self.known

    def fill(self, words) -> None:
        """Makes the words known, from the older generation or encoded."""
        known, older = self.known, self.older
        known.update([(w, older[w]) for w in words if w in older])
        rest = [w for w in words if w not in known]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            known.update(zip(part, self.encode(part), strict=True))


class _Kept:
    """Ids of distinct words (Arrow arrays) by `encode`; those used most stay from one call to the next.

    All is held in flat arrays.  Beyond `most` words the half of them used in most calls stays, and
    uses so far count half; words longer than LONG_WORD never stay, so the bound holds in bytes too.
    """

    def __init__(self, encode, most: int = KEPT_WORDS):
        import numpy as np
        import pyarrow as pa

        self.np, self.encode, self.most = np, encode, most
        self.words = pa.array([], pa.large_string())
        self.ids, self.size, self.used = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, words):
        """The ids of the words, joined, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np, n = self.np, len(self.words)
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = at < 0
        self.used[at[~new]] += 1
        at[new] = n + np.arange(new.sum())
        words = words.filter(pa.array(new))
        ids, size = self.encode(words.to_pylist())
        got = _gather(np.concatenate([self.ids, ids]), np.concatenate([self.size, size]), at)
        short = pc.less_equal(pc.utf8_length(words), LONG_WORD)
        place = np.flatnonzero(short.to_numpy(zero_copy_only=False))
        ids, size = _gather(ids, size, place)
        self.words = pa.concat_arrays([self.words, words.filter(short)])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.ones(len(place), np.int64)])
        if len(self.words) > self.most:
            self.halve()
        return got

    def halve(self) -> None:
        """Leaves the words of most uses, of equal ones the later."""
        np = self.np
        stay = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
        self.words, self.used = self.words.take(stay), self.used[stay] // 2
        self.ids, self.size = _gather(self.ids, self.size, stay)


class WordIds:
    """Ids of a tokenizer that drops white space, as little-endian unsigned 32-bit bytes.

    Most words are letters of the Latin blocks with closing punctuation.  Normalisation
    only lowers such letters, and the tokenizer splits before the punctuation; so the
    lower-cased letters go to the library's model alone, without the rest of its stages,
    many words a call: each word's last token is one that ends a word.  The distinct words
    of a stretch of texts are looked up once, those used most are kept from one to the next.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.np, self.tok = np, load(path)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bare = Tokenizer(self.tok.model)  # the same model, held once
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.stems, self.others = _Kept(self._model_alone), _Kept(self._whole, KEPT_WORDS // 4)

    def _whole(self, texts: list[str]):
        """Ids of texts by the whole tokenizer, and how many each has."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return self.np.array(list(chain.from_iterable(got)), "<u4"), self.np.fromiter(map(len, got), self.np.int64, len(got))

    def _model_alone(self, words: list[str]):
        np, ids, sizes = self.np, [], []
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            got = np.array(self.bare.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            size = np.diff(np.flatnonzero(self.ends[got]), prepend=-1)
            if len(size) != len(part):  # not a tokenizer whose words end in such tokens
                got, size = self._whole(part)
            ids.append(got)
            sizes.append(size)
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([np.empty(0, np.int64), *sizes])

    def _encode(self, words):
        """Ids of distinct words (an Arrow array), and how many each has."""
        import pyarrow.compute as pc

        np = self.np
        plain = pc.match_substring_regex(words, _PLAIN)
        stem = pc.utf8_lower(pc.utf8_rtrim(words.filter(plain), characters=_CLOSING)).dictionary_encode()
        closing = pc.replace_substring_regex(words.filter(plain), _LETTERS, "").dictionary_encode()
        parts = [self.stems.of(stem.dictionary)]
        parts += [self.others.of(a) for a in (closing.dictionary, words.filter(pc.invert(plain)))]
        ids, size = (np.concatenate(a) for a in zip(*parts))
        # Each word is one or two of these parts.
        plain = plain.to_numpy(zero_copy_only=False)
        first, second = np.empty(len(plain), np.int64), np.full(len(plain), -1)
        first[plain] = stem.indices.to_numpy()
        second[plain] = closing.indices.to_numpy() + len(stem.dictionary)
        first[~plain] = np.arange((~plain).sum()) + len(stem.dictionary) + len(closing.dictionary)
        both = np.column_stack([first, second]).ravel()
        both = both[both >= 0]
        ids, n = _gather(ids, size, both)
        joined = np.where(plain, 2, 1)
        return ids, np.add.reduceat(n, np.cumsum(joined) - joined) if len(n) else n

    def batch(self, texts: list[str]) -> list[bytes]:
        return [r for part in _slices(texts, STRETCH_CHARS) for r in self._stretch(part)]

    def _stretch(self, texts: list[str]) -> list[bytes]:
        """Ids of a stretch: split a run at a time, distinct words looked up together, ids joined a run at a time."""
        import pyarrow as pa

        np, out = self.np, []
        # A run's words and the places of their ids take some forty bytes a character.
        runs, counts = zip(*[self._slice(part) for part in _slices(texts, STRETCH_CHARS // 4)])
        runs = pa.chunked_array(runs).unify_dictionaries().chunks
        ids, n = self._encode(runs[0].dictionary)
        for run, k in zip(runs, counts):
            got, m = _gather(ids, n, run.indices.to_numpy())
            end = np.concatenate([[0], np.cumsum(m)])
            cuts = end[np.cumsum([0, *k])].tolist()
            out += [got[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
        return out

    def _slice(self, texts: list[str]):
        """The words of a run of texts, dictionary-encoded, and how many each text has."""
        import pyarrow as pa

        lists = [[t] if _ODD.search(t) else t.split() for t in texts]
        return pa.array(list(chain.from_iterable(lists)), pa.large_string()).dictionary_encode(), list(map(len, lists))


class ByteCounts:
    """Token counts of a byte-level BPE whose pre-tokens carry at most one leading space."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.words = _Words(self._encode)

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, texts: list[str]) -> list[int]:
        return [r for part in _slices(texts, SLICE_CHARS // 4) for r in self._slice(part)]  # words are held as Python strings

    def _slice(self, texts: list[str]) -> list[int]:
        import numpy as np

        lists = []
        for t in texts:
            words = _INNER_SPACE.split(t) if t else []
            lists.append([words[0], *[" " + w for w in words[1:]]] if words else [])
        words, at = _distinct(lists)
        words = words.to_numpy(zero_copy_only=False).tolist()
        known = self.words.of(words).__getitem__
        n = np.concatenate([[0], np.cumsum(np.fromiter(map(known, words), np.int64, len(words))[at])])
        last = n[np.cumsum([len(w) for w in lists])]
        return np.diff(last, prepend=0).tolist()


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=4)
def byte_counts(path: str) -> ByteCounts:
    return ByteCounts(path)


common.keeps("tokenize", load, word_ids, byte_counts)
