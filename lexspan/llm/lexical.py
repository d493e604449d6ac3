"""Ranked lexical search by a dual tree over items and documents.

A document's vector holds, for each term of the items, weight times saturated frequency; an
item's holds how often it says the term; a score is their product.  Both sides stand in
trees whose nodes hold the maximum of each coordinate below them, so the product of two nodes bounds every
score between them.  A pair of nodes is left where its bound is below the weakest k-th score
of the node's items, and with it all its pairs at once; nothing else is left out, so the ranking is exact.

The documents are cut into terms twice: once for the corpus figures (N, L, df), and once into vectors, which
are searched batch by batch in the same task, each batch a tree.  Scores of a share of the documents, picked
by the hash of their texts, are found first: their k-th scores prune all batches from the start and keep
what tasks send on to about k / share rows an item.  Items go to the tasks in blocks of bounded
characters and number; more items mean more passes, not larger blocks.

Defined cases: null or empty text has no terms and is never ranked; items without terms, or
with terms that no document holds, get no rows; repeated rows of documents are ranked each; repeated
items are answered each, under their own id; ties of score stand by ascending doc_id, null ids last; very
long texts are read whole; empty tables give an empty result; other columns take no part.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of UTF-8: digits, letters and all beyond ASCII are of terms, A-Z in lower case; any other is a space.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Items and their characters in one block, about; documents of one tree and of one leaf at most.
BLOCK_ITEMS, BLOCK_CHARS = 4_096, 4_000_000
TREE_DOCS, LEAF_DOCS = 2_048, 16
#: One in so many documents is scored first.
SHARE = 32
HITS = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_BYTES).split() if text else []


class ItemTree:
    """Items of one block: terms by number, how often each item says them, and a tree over the items.

    Node 0 is the root; the items below a node are a run of `order`.
    """

    def __init__(self, texts: list[str], leaf: int = 4):
        import numpy as np

        counts = [Counter(terms_of(t.encode())) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        self.said = [sorted((self.vocabulary[t], n) for t, n in c.items()) for c in counts]
        # Items are dealt to halves by the term that most nearly halves them, so like items stand together.
        self.order: list[int] = []
        self.low, self.high, self.children, vectors = [], [], [], []

        def grow(items: list[int]) -> int:
            node = len(self.low)
            self.low.append(len(self.order))
            self.high.append(0)
            self.children.append(())
            most: dict[int, int] = {}
            for i in items:
                for t, n in self.said[i]:
                    most[t] = max(most.get(t, 0), n)
            vectors.append(sorted(most.items()))
            if len(items) > leaf:
                self.children[node] = tuple(grow(half) for half in self._halves(items))
            else:
                self.order.extend(items)
            self.high[node] = len(self.order)
            return node

        if texts:
            grow(list(range(len(texts))))
        # One node more for each item, so that items are nodes too.
        self.item_node = len(self.low)
        vectors += [self.said[i] for i in self.order]
        self.start = np.cumsum([0, *map(len, vectors)])
        self.terms = np.array([t for v in vectors for t, _ in v], np.int64)
        self.times = np.array([n for v in vectors for _, n in v], np.int64)
        self.low, self.high = np.array(self.low, np.int64), np.array(self.high, np.int64)

    def _halves(self, items: list[int]) -> tuple[list[int], list[int]]:
        held = Counter(t for i in items for t, _ in self.said[i])
        t = min(held, key=lambda t: (abs(2 * held[t] - len(items)), t), default=None)
        far = [i for i in items if t is not None and any(u == t for u, _ in self.said[i])]
        if not len(items) // 4 <= len(far) <= len(items) - len(items) // 4 or not far or len(far) == len(items):
            return items[: len(items) // 2], items[len(items) // 2 :]
        chosen = set(far)
        return [i for i in items if i not in chosen], far

    def gather(self, nodes):
        """Terms and times of the vectors of nodes, one after the other, and where each begins."""
        import numpy as np

        n = self.start[nodes + 1] - self.start[nodes]
        end = np.cumsum(n)
        place = np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[nodes] - (end - n), n)
        return self.terms[place], self.times[place], end - n, n


class Search:
    """The k best documents of every item among the batches that have come, searched tree against tree."""

    def __init__(self, tree: ItemTree, k: int, least=None):
        import numpy as np

        self.np, self.tree, self.k = np, tree, k
        n = len(tree.order)
        self.weakest = np.ones(n, np.int64) if least is None else np.maximum(np.asarray(least, np.int64)[tree.order], 1)
        self.found = [([], [], []) for _ in range(n)]  # scores, ids, whether the id is null
        self.buffer = np.zeros(len(tree.vocabulary), np.int64)
        self.scored = 0  # pairs of item and document whose score was worked out

    def batch(self, ids, null, start, terms, parts) -> None:
        """Documents: ids, whether null, and from `start` on the terms each holds and their parts of a score."""
        np = self.np
        if not len(self.tree.order) or not len(ids):
            return
        self.ids, self.null = ids, null
        self.start, self.terms, self.parts = start, terms, parts
        owner = np.repeat(np.arange(len(ids)), np.diff(start))
        docs = np.flatnonzero(np.diff(start) > 0)
        # Each document's term of most weight: where no term splits a node, documents alike in it stay together.
        self.main = np.full(len(ids), -1, np.int64)
        rising = np.lexsort((terms, parts, owner))
        self.main[owner[rising]] = terms[rising]
        self._visit(docs, np.isin(owner, docs).nonzero()[0], owner, np.zeros(1, np.int64))

    def _sums(self, nodes, values):
        """Product of each node's vector with the terms' values (one row, or a row a document)."""
        np = self.np
        t, n, at, size = self.tree.gather(nodes)
        if not len(t):
            return np.zeros((*values.shape[:-1], len(nodes)), np.int64)
        got = np.add.reduceat(values[..., t] * n, np.minimum(at, len(t) - 1), axis=-1)
        got[..., size == 0] = 0
        return got

    def _visit(self, docs, entries, owner, nodes) -> None:
        """Documents of one node (with their entries) against nodes of items."""
        np, tree = self.np, self.tree
        most = self.buffer
        np.maximum.at(most, self.terms[entries], self.parts[entries])
        bound = self._sums(nodes, most)
        if len(docs) <= LEAF_DOCS:
            # Down to single items while their bounds hold.
            live = nodes[bound >= self._weakest(nodes)]
            while (live < tree.item_node).any():
                live = self._down(live)
                live = live[self._sums(live, most) >= self._weakest(live)]
            most[self.terms[entries]] = 0
            if len(live):
                self._score(docs, np.sort(live) - tree.item_node)
            return
        most[self.terms[entries]] = 0
        keep = bound >= self._weakest(nodes)
        if not keep.any():
            return
        # The half with more of these items' terms first, so that k-th scores rise early.
        below = self._down(nodes[keep])
        for half, some in self._halves(docs, entries, owner):
            self._visit(half, some, owner, below)

    def _weakest(self, nodes):
        np, tree = self.np, self.tree
        low = np.where(nodes < tree.item_node, tree.low[np.minimum(nodes, tree.item_node - 1)], nodes - tree.item_node)
        high = np.where(nodes < tree.item_node, tree.high[np.minimum(nodes, tree.item_node - 1)], nodes - tree.item_node + 1)
        if not len(nodes):
            return np.empty(0, np.int64)
        edges = np.column_stack([low, high]).ravel()
        held = np.append(self.weakest, np.iinfo(np.int64).max)
        return np.minimum.reduceat(held, edges)[::2]

    def _down(self, nodes):
        """Children of inner nodes, items of leaves, items themselves."""
        np, tree = self.np, self.tree
        out = []
        for n in nodes.tolist():
            if n >= tree.item_node:
                out.append(n)
            elif tree.children[n]:
                out.extend(tree.children[n])
            else:
                out.extend(range(tree.item_node + int(tree.low[n]), tree.item_node + int(tree.high[n])))
        return np.array(out, np.int64)

    def _halves(self, docs, entries, owner):
        """Documents that hold the term with most weight among those that split them, and the rest."""
        np = self.np
        t = self.terms[entries]
        held = np.bincount(t, minlength=len(self.buffer))
        weight = np.bincount(t, self.parts[entries], minlength=len(self.buffer))
        weight[(held * 4 < len(docs)) | (held * 4 > 3 * len(docs))] = 0
        best = int(weight.argmax())
        if weight[best] > 0:
            has = np.zeros(len(self.ids), bool)
            has[owner[entries[t == best]]] = True
        else:  # no term splits them well
            has = np.zeros(len(self.ids), bool)
            has[docs[np.argsort(self.main[docs], kind="stable")[: len(docs) // 2]]] = True
        first, of_first = has[docs], has[owner[entries]]
        return (docs[first], entries[of_first]), (docs[~first], entries[~of_first])

    def _score(self, docs, items) -> None:
        np, tree = self.np, self.tree
        local = np.zeros((len(docs), len(self.buffer)), np.int64) if len(self.buffer) * len(docs) <= 4_000_000 else None
        row = np.empty(len(self.buffer), np.int64) if local is None else None
        scores = np.empty((len(docs), len(items)), np.int64)
        for i, d in enumerate(docs.tolist()):
            a, b = self.start[d], self.start[d + 1]
            if local is not None:
                local[i, self.terms[a:b]] = self.parts[a:b]
            else:
                row[:] = 0
                row[self.terms[a:b]] = self.parts[a:b]
                scores[i] = self._sums(items + tree.item_node, row)
        if local is not None:
            scores = self._sums(items + tree.item_node, local)
        self.scored += scores.size
        r, c = np.nonzero(scores >= self.weakest[items][None])
        for j in np.unique(c).tolist():
            at = r[c == j]
            item = int(items[j])
            s, i, n = self.found[item]
            s.extend(scores[at, j].tolist())
            i.extend(self.ids[docs[at]].tolist())
            n.extend(self.null[docs[at]].tolist())
            if len(s) >= 2 * self.k:
                self._trim(item)

    def _trim(self, item: int) -> None:
        s, i, n = self.found[item]
        best = sorted(zip([-x for x in s], n, i))[: self.k]
        self.found[item] = [-x for x, _, _ in best], [x for _, _, x in best], [x for _, x, _ in best]
        if len(best) == self.k:
            self.weakest[item] = max(self.weakest[item], -best[-1][0])

    def rows(self):
        """(item, id or None, score) of the k best of each item."""
        for at, item in enumerate(self.tree.order):
            self._trim(at)
            for s, i, n in zip(*self.found[at]):
                yield item, None if n else i, s


def figures(docs: DataFrame, tree) -> tuple[int, int, dict[int, int]]:
    """N, L and df by term number, over all of docs (text), for the terms of a broadcast tree."""

    def count(batches):
        import pyarrow as pa

        vocabulary, n, total, df = tree.value.vocabulary, 0, 0, Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = terms_of(text)
                n += bool(words)
                total += len(words)
                df.update(vocabulary.keys() & set(words))
        keys = [-1, -2, *(vocabulary[t] for t in df)]
        yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.int64()), "n": pa.array([n, total, *df.values()], pa.int64())})

    got = dict(docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    return got.pop(-1, 0), got.pop(-2, 0), got


def weights(spark, n: int, df: dict[int, int], size: int) -> list[int]:
    """floor(1000 ln((2N + 2) / (2 df + 1))) by term number, in doubles of the JVM."""
    rows = spark.createDataFrame([(t, df.get(t, 0)) for t in range(size)], "term long, df long") if size else None
    w = F.floor(1000 * F.log((F.lit(2 * n + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return [x for _, x in sorted(rows.select("term", w).collect())] if rows is not None else []


def _search(docs: DataFrame, sent, k: int) -> DataFrame:
    """HITS of each task: its k best documents of each item, of those not below the scores known before."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tree, w, n, total, least = sent.value
        search, vocabulary, w = Search(tree, k, least), tree.vocabulary, np.array(w, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_DOCS):
                part = batch.slice(at, TREE_DOCS)
                sizes, held, tf, words = [], [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    said = Counter(terms_of(text))
                    words.append(sum(said.values()))
                    own = [(vocabulary[t], said[t]) for t in vocabulary.keys() & said.keys()] if len(said) > len(vocabulary) else [(vocabulary[t], c) for t, c in said.items() if t in vocabulary]
                    sizes.append(len(own))
                    held += [t for t, _ in own]
                    tf += [c for _, c in own]
                sizes, held, tf = np.array(sizes, np.int64), np.array(held, np.int64), np.array(tf, np.int64)
                # 25 * n * N may pass 64 bits on a very large corpus, so this one is worked out in Python's integers.
                m = np.array([75 + 25 * x * n // total if total else 75 for x in words], np.int64)
                parts = w[held] * ((1_000_000_000 * tf) // (1_000 * tf + 12 * np.repeat(m, sizes))) if len(held) else held
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                search.batch(ids.fill_null(0).to_numpy(zero_copy_only=False), null, np.concatenate([[0], np.cumsum(sizes)]), held, parts)
        rows = list(search.rows())
        yield pa.RecordBatch.from_pydict({
            "item": pa.array([r[0] for r in rows], pa.int32()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.int64()),
        })

    return docs.select("doc_id", "text").mapInArrow(run, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, share: int = SHARE) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    items, docs = items.select("item_id", "text").where("text is not null"), docs.select("doc_id", "text")
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        own = own.orderBy("item_id", "text").collect()
        tree = ItemTree([r["text"] for r in own])
        N, L, df = figures(docs, spark.sparkContext.broadcast(tree))
        w = weights(spark, N, df, len(tree.vocabulary))
        few = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
        seen = _best(_search(few, spark.sparkContext.broadcast((tree, w, N, L, None)), k), k).where(F.col("rank") == k).select("item", "score").collect()
        least = [1] * len(own)
        for r in seen:
            least[r["item"]] = r["score"]
        hits = _best(_search(docs, spark.sparkContext.broadcast((tree, w, N, L, least)), k), k)
        named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], "item int, item_id long")
        got = hits.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        got = got if blocks == 1 else common.materialize(got, "ranked")  # a block at a time
        out = got if out is None else out.unionByName(got)
    return out


def op11_lexical_search(spark, sf_dir):
    """The 20 best documents of all for each benchmark item."""
    return ranked(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))


_TERMS_SQL = r"unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP11_SQL = f"""
WITH said AS (SELECT item_id, term, count(*) c FROM (SELECT item_id, {_TERMS_SQL.format('text')} term FROM benchmark) GROUP BY ALL),
words AS (SELECT doc_id, {_TERMS_SQL.format('text')} term FROM documents),
sizes AS (SELECT doc_id, count(*) n FROM words GROUP BY ALL),
corpus AS (SELECT count(*)::BIGINT big_n, sum(n)::BIGINT big_l FROM sizes),
held AS (SELECT doc_id, term, count(*) tf FROM words WHERE term IN (SELECT term FROM said) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT w FROM held, corpus GROUP BY term, big_n),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) part
  FROM held JOIN sizes USING (doc_id) JOIN weighed USING (term), corpus
),
scores AS (SELECT item_id, doc_id, sum(c * part)::BIGINT score FROM said JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank, doc_id, score FROM scores
WHERE score > 0 QUALIFY rank <= 20"""
