"""Similarity join of word-shingle sets by Jaccard, size-aware with a heavy-light order.

Documents with the same set form one class, and only one representative of each goes on.
Shingles are ordered light first: those seen often (found by merging the frequent ones of
each batch, over all documents) come last, by count.  The order decides only how much work
there is, never what is found.

Small sets (up to a size boundary) enumerate the two-element subsets of their prefix, large
ones go through inverted lists of the single shingles of theirs.  A set of n that overlaps
another in at least o elements shares k elements of its first n - o + k with it, so no link
is lost.  The boundary is the one of least estimated cost, from all sets' own figures.

Before lists are joined, members of large groups are tied to hubs that agree in a min-hash
and are verified; lists then join only members of different components, so no group of
copies is expanded into pairs.  Every link counted is verified on whole sets.

Defined cases: null text or one without words: an empty set, which links with nothing;
fewer words than a shingle: one shingle; rows that repeat a doc_id are one node of the
graph; null ids form no links (component null); very long texts give their whole sets; a
similarity just at the threshold links; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Frequent shingles that are told apart in the order; a bound of what is sent to tasks.
HEAVY = 1 << 18
BROADCAST_IDS = 500_000
#: Shingles counted together in a task: bounds its memory however long the texts are.
COUNTED = 3_000_000
#: Hubs whose whole sets are sent to all tasks, at most.
HUBS = 200
SIGNATURES = 6
SMALL_MOST = 64
#: Elements that prefixes hold beyond those that may differ: what a pair must share of them is checked before whole sets.
SHARED = 16


@lru_cache(maxsize=1)
def _word_hashes() -> dict:
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) > 200_000:
                self.clear()
            self[word] = h = xxhash.xxh3_64_intdigest(word)
            return h

    return Hashes()


common.keeps("jaccard", _word_hashes)


def shingle_set(text: str | None, size: int):
    """Sorted distinct 64-bit hashes (as int64) of a text's word shingles."""
    import numpy as np

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    known = _word_hashes()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    mixed = np.full(n, np.uint64(len(h) if len(h) < size else size))
    for j in range(min(size, len(h))):
        mixed = (mixed ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def frequent(sets: list, least: int):
    """(hashes, counts) of those in `least` sets or more; empties the list, so that the sets are held once."""
    import numpy as np

    h = np.concatenate([np.empty(0, np.int64), *sets])
    sets.clear()
    h.sort()
    # One that is there n times equals the one least - 1 places on n - least + 1 times; the rest is never copied.
    first = h[: max(0, len(h) - least + 1)]
    h, n = np.unique(first[first == h[least - 1 :]], return_counts=True)
    return h, n + (least - 1)


def heavy_shingles(docs: DataFrame, size: int, local: int = 3, least: int = 16, most: int = HEAVY) -> list[tuple[int, int]]:
    """(hash, count) of the most frequent shingles, counts ascending; stretches of about COUNTED shingles report those frequent in them."""

    def count(batches):
        import pandas as pd

        common.serve("jaccard")
        sets, held = [], 0
        for pdf in batches:
            for text in pdf["text"].tolist():
                sets.append(shingle_set(text, size))
                held += len(sets[-1])
                if held >= COUNTED:
                    yield pd.DataFrame(dict(zip("hn", frequent(sets, local))))
                    held = 0
        yield pd.DataFrame(dict(zip("hn", frequent(sets, local))))
        common.release()

    found = docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = found.orderBy(F.desc("n"), "h").limit(most).collect()
    return [(r["h"], r["n"]) for r in reversed(rows)]


def least_overlap(n: int, num: int, den: int) -> int:
    """The smallest overlap that a set of n has with any set of Jaccard num/den or more."""
    m = -(-num * n // den)
    return -(-num * (n + m) // (num + den))


def describe_sets(docs: DataFrame, size: int, num: int, den: int, heavy: list[tuple[int, int]]) -> DataFrame:
    """doc_id, n, set_key, p (elements that may differ, and two more), prefix in the light-first order, signatures, costs."""

    import numpy as np

    hashes = np.array([h for h, _ in heavy], np.int64)
    rank_of = hashes.argsort()
    hot, count_of = hashes[rank_of], np.array([n for _, n in heavy], np.float64)[rank_of]

    def run(batches):
        import numpy as np
        import pandas as pd
        import xxhash

        seeds = [np.uint64(2 * int.from_bytes(xxhash.xxh64_digest(b"%d" % j)[:7], "big") + 1) for j in range(SIGNATURES)]
        common.serve("jaccard")
        for pdf in common.slices(batches):
            rows = []
            for doc, none, text in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"].tolist(), strict=True):
                s = shingle_set(text, size)
                n = len(s)
                if not n:
                    rows.append((doc, none, 0, 0, None, [], [], 0.0, 0.0))
                    continue
                p = min(n, n - least_overlap(n, num, den) + 2)
                keep = min(n, p - 2 + SHARED)
                counts = np.ones(n)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    known = hot[at] == s
                    counts[known] = count_of[at[known]]
                    light, dark = s[~known], s[known][np.argsort(rank_of[at[known]], kind="stable")]
                    if len(light) >= keep:
                        counts = np.ones(keep)
                    else:
                        counts = np.concatenate([np.ones(len(light)), np.sort(counts[known])])
                    s_ordered = np.concatenate([light, dark])
                else:
                    s_ordered = s
                prefix, counts = s_ordered[:keep], counts[:keep]
                u = s.view(np.uint64)
                signature = [int(((u * seed) ^ ((u * seed) >> np.uint64(31))).min().view(np.int64)) for seed in seeds]
                single = float(counts[: p - 1].sum())
                pairs = p * (p - 1) / 2
                rows.append((doc, none, n, p, xxhash.xxh3_128_digest(s.tobytes()), prefix.tolist(), signature, single, pairs))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "n", "p", "set_key", "prefix", "signature", "cost_lists", "cost_subsets"])
        common.release()

    made = "n long, p long, set_key binary, prefix array<long>, signature array<long>, cost_lists double, cost_subsets double"
    return common.null_ids(common.whole_ids(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id long, no_id boolean, {made}"))


def boundary(reps: DataFrame) -> int:
    """The largest small size: that of least cost of subsets up to it and lists beyond it."""
    rows = reps.where(F.col("n") <= SMALL_MOST).groupBy("n").agg(F.sum("cost_lists").alias("a"), F.sum("cost_subsets").alias("b")).orderBy("n").collect()
    best, at, total = 0.0, 5, 0.0
    for r in rows:
        total += r["b"] - r["a"]
        if total < best:
            best, at = total, max(5, r["n"])
    return at


def _similar_sizes(num: int, den: int):
    return (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)


def verify(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The distinct pairs (a, b) whose whole sets reach the threshold, as a written table."""
    pairs = common.materialize(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # Sets are made anew for the documents in question only; few ids are sent to the tasks.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches):
        common.serve("jaccard")
        for pdf in common.slices(batches):
            yield pdf[["doc_id"]].assign(s=[shingle_set(t, size) for t in pdf["text"].tolist()])
        common.release()

    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInPandas(run, "doc_id long, s array<long>")
    sets = common.materialize(sets, "sets")
    rows, hubs = pairs, {}
    for side in ("a", "b"):  # each pair is shuffled to its sides' sets; pairs of a hub anywhere, without a set
        hubs[side] = common.hot_keys(pairs, side, HUBS)
        at, own = F.struct(F.col(side).alias("id"), F.lit(0).alias("dealt")), sets.select(F.struct(F.col("doc_id").alias("id"), F.lit(0).alias("dealt")).alias("at"), F.col("s").alias(f"s{side}"))
        if hubs[side] is not None:
            marked = hubs[side].withColumn("hub", F.lit(True))
            away = F.struct(F.lit(None).cast("long").alias("id"), (F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) + 1).cast("int").alias("dealt"))
            rows = rows.join(F.broadcast(marked), side, "left").withColumn("at", F.when(F.col("hub"), away).otherwise(at)).drop("hub")
        else:
            rows = rows.withColumn("at", at)
        rows = rows.join(own, "at", "left").drop("at")
    for side, some in hubs.items():  # a hub's set goes to all tasks, once, in place of once with each of its members
        if some is not None:
            far = sets.join(F.broadcast(some.withColumnRenamed(side, "doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias(side), F.col("s").alias("far"))
            rows = rows.join(F.broadcast(far), side, "left").withColumn(f"s{side}", F.coalesce(f"s{side}", "far")).drop("far")
    both = F.size(F.array_intersect("sa", "sb"))
    out = common.materialize(rows.where(both * den >= (F.size("sa") + F.size("sb") - both) * num).select("a", "b").distinct(), "links")
    common.discard(pairs, sets)
    return out


def hub_pairs(reps: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of each representative with two hubs that agree with it in a min-hash."""
    at = reps.select("doc_id", "n", F.posexplode("signature").alias("j", "value"))
    node = F.struct("doc_id", "n")
    hubs = at.groupBy("j", "value").agg(F.count(F.lit(1)).alias("k"), F.min(node).alias("h1"), F.max(F.struct("n", "doc_id")).alias("h2")).where("k > 1")
    hubs = hubs.select("j", "value", F.explode(F.array(F.struct(F.col("h1.doc_id").alias("a"), F.col("h1.n").alias("na")), F.struct(F.col("h2.doc_id").alias("a"), F.col("h2.n").alias("na")))).alias("h"))
    joined = at.join(hubs, ["j", "value"]).select("j", F.col("h.a").alias("a"), F.col("h.na").alias("na"), F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    alike = joined.where("a <> b").where(_similar_sizes(num, den)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "j").distinct()
    # Pairs that agree by chance, in a shared passage, are left to the lists.
    return alike.groupBy("a", "b").count().where(F.col("count") >= SIGNATURES // 2).select("a", "b")


def postings(reps: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """(token, pos, doc_id, n): two-element subsets of small sets' prefixes, single elements of large ones'.

    pos is the place of the element, of a subset that of its last one less one, from 1.
    """
    p = F.slice("prefix", 1, F.col("p").cast("int"))
    entry = lambda token, pos: F.struct(token.alias("token"), pos.cast("int").alias("pos"))
    pair = lambda i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y, j: entry(F.xxhash64(F.element_at(p, i + 1), y, F.lit(2)), i + j + 1))
    subsets = F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - 2), pair))
    lists = F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: entry(x, i + 1))
    near = F.col("n") * den >= small * num  # may link with a large set
    none = F.array().cast("array<struct<token: bigint, pos: int>>")
    tokens = F.concat(F.when(F.col("n") <= small, subsets).otherwise(none), F.when((F.col("n") > small) | near, lists).otherwise(none))
    # Different sets of up to five elements can't reach 0.85; prefixes hold two elements at least from there.
    usable = reps.where("p >= 2")
    return usable.select(F.explode(tokens).alias("t"), "doc_id", "n").select("t.token", "t.pos", "doc_id", "n")


def list_pairs(reps: DataFrame, small: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of different components (column c) that share a token, and the written lists they are made of."""
    found = postings(reps.drop("c"), small, num, den).join(reps.select("doc_id", "c"), "doc_id")
    mixed = found.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    kept = common.materialize(found.join(mixed, "token", "left_semi"), "lists")
    one = kept.select("token", F.col("pos").alias("ia"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    two = kept.select("token", F.col("pos").alias("ib"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    # For sets of these two sizes the prefixes end earlier than for the smallest partner.
    needed = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    inside = (F.col("ia") <= F.col("na") - needed + 1) & (F.col("ib") <= F.col("nb") - needed + 1)
    found = one.join(two, "token").where("a < b and ca <> cb").where(_similar_sizes(num, den) & inside).select("a", "b").distinct()
    # Longer prefixes share more: a pair that has one element by chance ends here.
    overlap = F.col("n") - F.col("p") + 2  # the least overlap of a set of n, or less
    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("prefix").alias(f"x{k}"), overlap.alias(f"o{k}"))
    shared = F.size(F.array_intersect("xa", "xb"))
    return found.join(side("a"), "a").join(side("b"), "b").where(shared >= F.least(F.lit(SHARED), "oa", "ob")).select("a", "b"), kept


def similar_groups(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text); sets link from a Jaccard of num/den."""
    docs = docs.select("doc_id", "text")
    heavy = heavy_shingles(docs, shingle)
    sets = common.materialize(describe_sets(docs, shingle, num, den, heavy), "sets")
    rest = ["doc_id", "n", "p", "prefix", "signature", "cost_lists", "cost_subsets"]
    usable = sets.where("n > 0 and doc_id is not null")
    reps = usable.groupBy("set_key").agg(F.min(F.struct(*rest)).alias("r")).select("set_key", "r.*")
    reps = common.materialize(reps, "classes")
    # From here on only keys and sizes of all sets are asked for; prefixes and signatures stay with the classes.
    sizes = common.materialize(sets.select("doc_id", "n", "set_key"), "sizes")
    common.discard(sets)
    small = boundary(reps)
    linked = verify(hub_pairs(reps, num, den), docs, shingle, num, den)
    first = components(linked)
    light = reps.select("doc_id", "n", "p", "prefix").join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    light = common.materialize(light, "light")
    keys = common.materialize(reps.select("set_key", F.col("doc_id").alias("rep")), "keys")
    common.discard(reps)
    pairs, lists = list_pairs(light, small, num, den)
    more = verify(pairs, docs, shingle, num, den)
    common.discard(lists, light)
    # Rows of one id with different texts are one node: their representatives hang on that id.
    keyed = common.join_unique(sizes.where("n > 0 and doc_id is not null").select("doc_id", "set_key"), keys, "set_key")
    same = keyed.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    stars = first.select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = components(stars.unionByName(more).unionByName(same)).withColumnRenamed("id", "doc_id")
    rows = sizes.select("doc_id", F.col("n").alias("n_shingles"))
    return rows.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op3_jaccard_join(spark, sf_dir):
    """doc_id, n_shingles, component_id of all documents: sets of four-word shingles, linked from a Jaccard of 0.85."""
    common.small_batches(spark)
    return similar_groups(common.table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, num=85, den=100)


#: Shingles joined pair by pair; components by following links from every id.
OP3_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a AS id, b AS other FROM pairs UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other),
least_of AS (SELECT id, least(id, min(other)) AS c FROM reach GROUP BY id)
SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id FROM sets LEFT JOIN least_of ON id = doc_id"""
