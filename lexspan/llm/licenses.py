"""License scans with a generalised suffix automaton.

The words of all template clauses go into one suffix automaton, whose states know every
place of their passages.  A file's words stream through it and give, at each word, the
passages of every template that end there (matching statistics, template by template).
Matches of one template that can't be lengthened, in template order and close together,
are chained into spans; a label is added where a chain covers a whole short template or
`enough` words of a longer one, and where a phrase of the base scan stands.  A passage that
several templates share counts for each of them.

Defined cases: null or empty text: no words, no labels, score 0; very long texts are
streamed whole; repeated rows, null ids and other columns do no harm; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from . import common
from .licence_texts import templates as known_templates

# Phrases of the base scan with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Letters in lower case, digits and all bytes from 0x80 are word bytes; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """Of several token sequences; a state knows one (sequence, end) of its passages, its descendants by suffix link the others."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for tokens in sequences:
            last = 0
            for token in tokens:
                last = self._extend(last, token)
        # Every prefix's state, and all above it by suffix link, end at the prefix's last place.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, tokens in enumerate(sequences):
            state = 0
            for at, token in enumerate(tokens):
                state = self.next[state][token]
                up = state
                while up > 0:
                    self.ends[up].append((k, at))
                    up = self.link[up]
        self._places: dict[int, dict[tuple[int, int], int]] = {}

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The state for passages of length(p)+1 that end with token, parted from q if q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, self.next[last][token], token)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][token], token)
        return new

    def places(self, state: int, least: int) -> dict[tuple[int, int], int]:
        """Every (sequence, end) of a passage of `least` tokens or more that ends in this state, with the longest such passage."""
        known = self._places.get(state)
        if known is None:
            known = self._places[state] = {}
            up = state
            while up > 0 and self.length[up] >= least:
                for place in self.ends[up]:
                    known.setdefault(place, self.length[up])
                up = self.link[up]
        return known

    def maximal_matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, start in the sequence) of the passages that the next token does not lengthen, for every sequence."""
        out, state, size = [], 0, 0
        following, link, length = self.next, self.link, self.length
        now: dict[tuple[int, int], int] = {}
        for at, token in enumerate(tokens):
            if token < 0:
                state = size = 0
            else:
                to = following[state].get(token)
                while to is None and state > 0:
                    state = link[state]
                    size = length[state]
                    to = following[state].get(token)
                state, size = (0, 0) if to is None else (to, size + 1)
            if size < least and not now:
                continue
            before = now
            now = {p: min(n, size) for p, n in self.places(state, least).items()} if size >= least else {}
            out.extend((at - n, n, k, end - n + 1) for (k, end), n in before.items() if (k, end + 1) not in now)
        out.extend((len(tokens) - n, n, k, end - n + 1) for (k, end), n in now.items())
        return sorted(out)


class Scanner:
    def __init__(self, templates=None, phrases=None, least: int = 4, gap: int = 8, enough: int = 24):
        templates, phrases = templates or known_templates(), phrases or PHRASES
        self.least, self.gap, self.enough = least, gap, enough
        named = [(label, words_of(t)) for label, texts in sorted(templates.items()) for t in texts]
        self.labels, self.sizes = [n for n, _ in named], [len(t) for _, t in named]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in named for w in t}))}
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in t] for _, t in named])
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of each place where a phrase's words stand."""
        out = []
        for phrase, label in self.phrases:
            at, n = -1, len(phrase)
            last, more = phrase[-1], 0
            for _ in range(words.count(last)):
                more = words.index(last, more) + 1
                at = more - n
                if at >= 0 and words[at:more] == phrase:
                    out.append((at, label))
        return sorted(out)

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(start, end, template, words covered) of chained matches."""
        get = self.vocabulary.get
        chains: dict[int, list[list[int]]] = {}
        for start, size, k, at in self.automaton.maximal_matches([get(w, -1) for w in words], self.least):
            runs = chains.setdefault(k, [])
            if runs:
                last = runs[-1]
                over = max(0, last[1] - start, last[3] - at)  # what the chain has already
                if start - last[1] <= self.gap and at >= last[3] - over and 0 < size - over:
                    if start + over >= last[1] and at + over >= last[3]:
                        last[1], last[2], last[3] = start + size, last[2] + size - over, at + size
                        continue
            runs.append([start, start + size, size, at + size])
        return sorted((r[0], r[1], k, r[2]) for k, runs in chains.items() for r in runs)

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        base = self.base(words)
        spans = self.spans(words)
        found = {label for _, label in base}
        base_labels = ",".join(sorted(found))
        share = lambda s: min(1.0, s[3] / min(self.sizes[s[2]], self.enough))
        good = [s for s in spans if share(s) == 1.0]
        found |= {self.labels[s[2]] for s in good}
        score = max([1.0] * bool(base) + [share(s) for s in spans], default=0.0)
        starts = [at for at, _ in base]
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": base_labels, "labels": ",".join(sorted(found)), "score": float(score),
            "spans": [{"start": s[0], "end": s[1], "label": self.labels[s[2]], "covered": min(1.0, s[3] / self.sizes[s[2]])} for s in good],
        }


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


SCAN_SCHEMA = "doc_id long, no_id boolean, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, covered: double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row of SCAN_SCHEMA, but no_id, for each row of docs (doc_id, text)."""

    def run(batches):
        import pandas as pd

        scan = scanner().scan
        for pdf in batches:
            out = pd.DataFrame([scan(t) for t in pdf["text"].tolist()])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "no_id", pdf["no_id"].to_numpy())
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return common.null_ids(common.whole_ids(docs.select("doc_id", "text")).mapInPandas(run, SCAN_SCHEMA))


def op4_license_scan(spark, sf_dir):
    """Base phrases and labels of all documents."""
    return scan_licenses(common.table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
