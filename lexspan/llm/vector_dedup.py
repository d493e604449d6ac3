"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a product grid; every vector is
indexed in its cell.  A query walks the cells in order of the sum of its two distances
(multi-sequence traversal) and visits as many as a calibration found necessary for the
target recall: the true partners of queries chosen by a hash, found among all rows.
Candidates of equal label are then verified by cosine in double precision, a block of
queries against a block of a cell.  Codebooks grow with the square root of the number of
vectors, so cells keep their size.

Equal vectors form one class with a weight, so copies are never expanded; a block reports
counts and one star edge a vector, never all pairs.  A link that only one of its two
vectors would find is counted for both.

Defined cases: vectors that are null, zero or hold null or non-finite components, null
labels and null ids link with nothing; vectors of another width are never compared; rows
that repeat a vec_id are separate vectors of one node and get the largest of their link
counts; a cosine just at the threshold links; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Bound of the sample that codebooks are fitted on: rows, or rows a code where there are many codes.
SAMPLE, SAMPLE_A_CODE = 20_000, 40
#: Queries, about, whose partners among all rows set the number of visited cells.
QUERIES = 1_500
#: Members and queries that meet in one block, and rows that a task takes at once.
BLOCK, QUERY_BLOCK, TASK_ROWS = 1_024, 4_096, 16_384
CELL_ROWS = 16
#: Cells that are sent to all tasks; more are joined by key.
BROADCAST_CELLS = 500_000


def k_means(rows, k: int, rounds: int = 10):
    """At most k different centres by Lloyd's rounds, started from rows spread evenly."""
    import numpy as np

    centres = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    step = max(1, 20_000_000 // len(centres))
    for _ in range(rounds):
        length = (centres * centres).sum(1)
        near = np.concatenate([(length - 2 * rows[at : at + step] @ centres.T).argmin(1) for at in range(0, len(rows), step)])
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def squared_distances(rows, centres):
    """Rows by centres; each is the same number whatever the other rows are."""
    import numpy as np

    step = max(1, 4_000_000 // max(1, centres.size))
    parts = [((rows[at : at + step, None] - centres[None]) ** 2).sum(2) for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.empty((0, len(centres)))


class MultiIndex:
    def __init__(self, first, second, visits: int):
        self.first, self.second, self.visits = first, second, visits

    def distances(self, rows):
        half = self.first.shape[1]
        return squared_distances(rows[:, :half], self.first), squared_distances(rows[:, half:], self.second)

    def homes(self, rows):
        d1, d2 = self.distances(rows)
        return d1.argmin(1) * len(self.second) + d2.argmin(1)

    def walks(self, rows):
        """Of each row its home, the cells it visits and the largest sum of distances among these.

        In the order of the sums, the cell of the a-th nearest code of one half and the b-th
        of the other comes after a * b - 1 others: only those of a * b up to the number of
        visits have to be looked at.
        """
        import numpy as np

        k1, k2 = len(self.first), len(self.second)
        visits = min(self.visits, k1 * k2)
        a = [np.full(min(visits // i, k2), i - 1) for i in range(1, min(visits, k1) + 1)]
        b = np.concatenate([np.arange(len(x)) for x in a])
        a = np.concatenate(a)
        out = []
        step = max(1, 4_000_000 // len(a))
        for at in range(0, len(rows), step):
            d1, d2 = self.distances(rows[at : at + step])
            o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
            sums = np.take_along_axis(d1, o1, 1)[:, a] + np.take_along_axis(d2, o2, 1)[:, b]
            far = np.partition(sums, visits - 1, axis=1)[:, visits - 1]
            for k in range(len(sums)):
                got = np.flatnonzero(sums[k] <= far[k])
                cells = o1[k, a[got]].astype(np.int64) * k2 + o2[k, b[got]]
                out.append((int(o1[k, 0]) * k2 + int(o2[k, 0]), cells, float(far[k])))
        return out

    def visits_home_of(self, rows, far, homes):
        """Rows by homes: whether a row's walk, which ends at `far`, comes to a home."""
        d1, d2 = self.distances(rows)
        return d1[:, homes // len(self.second)] + d2[:, homes % len(self.second)] <= far[:, None]

    def ranks(self, row, cells):
        """Places of cells in the walk of one row; cells at equal distance all count."""
        import numpy as np

        d1, d2 = (d[0] for d in self.distances(row[None]))
        s2 = np.sort(d2)
        cells = np.asarray(cells)
        sums = d1[cells // len(d2)] + d2[cells % len(d2)]
        return np.array([np.searchsorted(s2, x * (1 + 1e-12) - d1, "right").sum() for x in sums])


def fit(rows, codes: int) -> MultiIndex:
    """Codebooks; the number of visited cells is left to visits_needed."""
    half = rows.shape[1] // 2 or 1
    return MultiIndex(k_means(rows[:, :half], codes), k_means(rows[:, half:], codes), 1)


def visits_needed(index: MultiIndex, rows, targets, threshold: float, recall: float) -> int:
    """Cells that `recall` of the queries' true pairs need; targets: (query, cell of a partner, number of such pairs).

    It must hold over all pairs and over pairs weighted so that all queries count alike, so
    that a few large groups don't speak for many small ones.
    """
    import numpy as np

    found: dict[int, tuple[list[int], list[int]]] = {}
    for x, cell, n in targets:
        cells, ns = found.setdefault(x, ([], []))
        cells.append(cell)
        ns.append(n)
    rng = np.random.default_rng(0)
    # Few true pairs in the whole table: neighbours made up at the threshold stand in for them.
    if sum(n for _, _, n in targets) < 50:
        for x in range(min(200, len(rows))):
            noise = rng.normal(size=rows.shape[1])
            noise -= noise @ rows[x] * rows[x]
            y = threshold * rows[x] + np.sqrt(1 - threshold * threshold) * noise / max(np.linalg.norm(noise), 1e-12)
            cells, ns = found.setdefault(x, ([], []))
            cells.append(int(index.homes(y[None])[0]))
            ns.append(1)
    if not found:
        return 2
    place, by_pair, by_query = [], [], []
    for x, (cells, ns) in found.items():
        place.append(index.ranks(rows[x], cells))
        by_pair.append(np.array(ns, float))
        by_query.append(by_pair[-1] / sum(ns))
    place = np.concatenate(place)
    order = place.argsort(kind="stable")
    need = 2
    for weights in (np.concatenate(by_pair), np.concatenate(by_query)):
        total = np.cumsum(weights[order])
        need = max(need, int(place[order[np.searchsorted(total, recall * total[-1] * (1 - 1e-12))]]))
    return need


def unit_rows(vectors):
    import numpy as np

    rows = np.stack(vectors).astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def chosen_by_hash(classes: DataFrame, n: int, most: int, tag: str) -> DataFrame:
    return classes.where(F.pmod(F.xxhash64("key", F.lit(tag)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, most / max(1, n))))


def train(classes: DataFrame, n: int, threshold: float, recall: float) -> MultiIndex | None:
    """Codebooks of about SAMPLE classes of one width, fitted in one task; visits from about QUERIES classes against all."""
    import pickle

    codes = int(max(2, (n / CELL_ROWS) ** 0.5))

    def learn(pdf):
        import pandas as pd

        index = fit(unit_rows(pdf.sort_values("cid")["v"].tolist()), codes)
        return pd.DataFrame({"model": [pickle.dumps((index.first, index.second))]})

    sample = chosen_by_hash(classes, n, max(SAMPLE, SAMPLE_A_CODE * codes), "sample").select("cid", "v", F.lit(1).alias("one"))
    got = sample.groupBy("one").applyInPandas(learn, "model binary").collect()
    if not got:
        return None
    index = MultiIndex(*pickle.loads(got[0]["model"]), 1)
    queries = chosen_by_hash(classes, n, QUERIES, "query").select("cid", "label", "v").orderBy("cid").collect()
    if not queries:
        index.visits = visits_needed(index, [], [], threshold, recall)
        return index
    rows = unit_rows([r["v"] for r in queries])
    targets = partners(classes, index, rows, [r["label"] for r in queries], [r["cid"] for r in queries], threshold)
    index.visits = visits_needed(index, rows, targets, threshold, recall)
    return index


def partners(classes: DataFrame, index: MultiIndex, queries, labels, cids, threshold: float) -> list:
    """(query, cell, number) of the true partners of each query among all classes, by brute force in blocks."""

    def find(batches):
        import numpy as np
        import pandas as pd

        own, ids = np.asarray(labels), np.asarray(cids)
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                rows = unit_rows(part["v"].tolist())
                near = (rows @ queries.T >= threshold) & (part["label"].to_numpy()[:, None] == own[None]) & (part["cid"].to_numpy()[:, None] != ids[None])
                r, q = near.nonzero()
                pairs = pd.DataFrame({"q": q, "cell": index.homes(rows)[r]})
                yield pairs.groupby(["q", "cell"]).size().reset_index(name="n").astype("int64")

    found = classes.select("cid", "label", "v").mapInPandas(find, "q long, cell long, n long")
    return [tuple(r) for r in found.groupBy("q", "cell").agg(F.sum("n").alias("n")).orderBy("q", "cell").collect()]


LINK_SCHEMA = "cid long, rep long, n long, root long"


def _link_blocks(index: MultiIndex, threshold: float):
    """Links of the blocks (label, cell, mb, qb) that one task takes at once."""

    def block(v, cid, rep, weight, home, far, q, m):
        """Counts and roots of the queries q and members m, as places in the task's rows."""
        import numpy as np

        near = v[q] @ v[m].T >= threshold
        near &= cid[q][:, None] != cid[m][None]
        hit, hit_m = near.any(1), near.any(0)
        if not hit.any():
            return []
        q, m, near = q[hit], m[hit_m], near[hit][:, hit_m]
        # Where the member's own walk does not come to the query's cell, its link is counted here.
        alone = near & ~index.visits_home_of(v[m], far[m], home[q]).T
        # Smallest id of the block that each vector reaches through links of the block.
        rq, rm, top = rep[q], rep[m], np.iinfo(np.int64).max
        while True:
            nm = np.minimum(rm, np.where(near, rq[:, None], top).min(0))
            nq = np.minimum(rq, np.where(near, nm[None], top).min(1))
            if (nm == rm).all() and (nq == rq).all():
                break
            rq, rm = nq, nm
        return [(cid[q], rep[q], near @ weight[m], rq), (cid[m], rep[m], weight[q] @ alone, rm)]

    def link(pdf):
        import numpy as np
        import pandas as pd

        unit = pdf.groupby(["label", "cell", "mb", "qb"], sort=False).ngroup().to_numpy()
        query = pdf["query"].to_numpy()
        order = np.lexsort((query, unit))
        unit, query = unit[order], query[order]
        v = unit_rows(pdf["v"].tolist())
        cid, rep, weight, home, far = (pdf[c].to_numpy() for c in ("cid", "rep", "weight", "home", "far"))
        found = []
        cuts = np.flatnonzero(np.diff(unit)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)]):
            mid = lo + int(np.searchsorted(query[lo:hi], True))
            if lo < mid < hi:
                found += block(v, cid, rep, weight, home, far, order[mid:hi], order[lo:mid])
        out = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("cid", "rep", "n", "root"), out))).astype("int64")

    return link


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # -0.0 + 0.0 is 0.0: equal vectors have equal keys.
    key = F.struct(F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x + F.lit(0.0)).alias("v"))
    used = rows.where(sound).select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"), F.unhex(F.sha2(F.to_json(key), 256)).alias("key"))
    used = common.materialize(used, "vectors")
    classes = used.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    width = F.size("v")
    first = used.join(classes.withColumnRenamed("rep", "vec_id"), ["key", "vec_id"]).dropDuplicates(["key"])
    # One id may represent several classes: these are told apart by a number.
    first = first.select(F.monotonically_increasing_id().alias("cid"), "key", F.col("vec_id").alias("rep"), "weight", "label", "v", width.alias("width"))
    first = common.materialize(first, "classes")
    widths = [r["width"] for r in first.groupBy("width").count().orderBy("width").collect()]
    found = None
    for w in widths:
        part = _links_of_width(first.where(F.col("width") == w), threshold, recall)
        found = part if found is None else found.unionByName(part)
    member = common.join_unique(used.select("vec_id", "key"), first.select("key", "cid", "rep", "weight"), "key").drop("key")
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = common.materialize(found, "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    # Ids that stand in several rows tie their classes together.
    ties = member.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    groups = components(edges.unionByName(ties)).withColumnRenamed("id", "vec_id")
    counts = first.select("cid").join(counts, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))
    per_row = common.join_unique(member, counts, "cid").groupBy("vec_id").agg(F.max(F.col("n") + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id").join(per_row, "vec_id", "left").join(groups, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of_width(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    n = classes.count()
    index = train(classes, n, threshold, recall)

    def place(batches):
        for pdf in batches:
            got = index.walks(unit_rows(pdf["v"].tolist())) if len(pdf) else []
            home, walk, far = ([g[k] for g in got] for k in range(3))
            yield pdf[["cid", "rep", "weight", "label", "v"]].assign(home=home, walk=walk, far=far)

    placed = classes.select("cid", "rep", "weight", "label", "v").mapInPandas(place, "cid long, rep long, weight long, label string, v array<double>, home long, walk array<long>, far double")
    placed = common.materialize(placed, "placed")
    # Full cells are dealt to blocks of members, and what visits them to blocks of queries.
    members = placed.groupBy("label", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("nm"))
    visitors = placed.select("label", F.explode("walk").alias("cell")).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("nq"))
    parts = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    cells = members.join(visitors, ["label", "cell"]).where("nq > 1 or nm > 1")  # else a vector meets itself alone
    cells = common.materialize(cells.withColumn("mbs", parts("nm", BLOCK)).withColumn("qbs", parts("nq", QUERY_BLOCK)), "cells")
    size = cells.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nm") * F.col("qbs") + F.col("nq") * F.col("mbs")).alias("rows")).first()
    tasks = max(1, -(-int(size["rows"] or 0) // TASK_ROWS))
    sent = F.broadcast(cells) if size["n"] <= BROADCAST_CELLS else cells
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, tag: F.pmod(F.xxhash64("cid", F.lit(tag)), F.col(c)).cast("int")
    cols = ["label", "cell", "mb", "qb", "query", "cid", "rep", "weight", "home", "far", "v"]
    home = placed.withColumn("cell", F.col("home")).join(sent, ["label", "cell"]).withColumn("mb", dealt("mbs", 0)).withColumn("qb", every("qbs"))
    walks = placed.withColumn("cell", F.explode("walk")).join(sent, ["label", "cell"]).withColumn("qb", dealt("qbs", 1)).withColumn("mb", every("mbs"))
    both = home.withColumn("query", F.lit(False)).select(*cols).unionByName(walks.withColumn("query", F.lit(True)).select(*cols))
    task = F.pmod(F.xxhash64("label", "cell", "mb", "qb"), F.lit(tasks))
    return both.withColumn("task", task).groupBy("task").applyInPandas(_link_blocks(index, threshold), LINK_SCHEMA)


def op8_vector_dedup(spark, sf_dir):
    """Links and components of all vectors."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


#: Links by all pairs of equal label, components by following links from every id.
OP8_SQL = """WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON degree.id = vec_id LEFT JOIN least ON least.id = vec_id"""
