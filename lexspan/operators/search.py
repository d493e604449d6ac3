"""Exact nearest neighbours, the prompt budget and retrieval scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: A query set up to this many rows is sent to every task; a larger one is met in blocks.
BROADCAST_QUERIES = 20_000
#: Queries and vectors of one block.
QUERY_BLOCK, VECTOR_BLOCK = 2_048, 16_384
NEAR = "query_id long, vec_id long, d double"


def check_width(vectors: DataFrame, column: str, width: int) -> DataFrame:
    """vectors, whose read fails with a named error where a vector has another width."""
    message = F.concat(F.lit(f"{column} must hold {width} components, not "), F.size(column).cast("string"))
    checked = F.when(F.col(column).isNull() | (F.size(column) == width), F.col(column)).otherwise(F.raise_error(message))
    return vectors.withColumn(column, checked)


def _block_nearest(ids, vectors, query_ids, queries, k: int):
    """Rows of NEAR: of each query the k nearest of the vectors, and those that tie with the last."""
    import numpy as np
    import pandas as pd

    out = []
    length = (vectors * vectors).sum(1)
    for at in range(0, len(queries), 256):
        q, qid = queries[at : at + 256], query_ids[at : at + 256]
        far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + length[None] - 2 * q @ vectors.T, 0))
        far[qid[:, None] == ids[None]] = np.inf
        last = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(q), np.inf)
        r, c = np.nonzero((far <= last[:, None] + 2e-6) & np.isfinite(far))
        d = np.sqrt(((q[r] - vectors[c]) ** 2).sum(1))  # of those kept, without cancellation
        out.append(pd.DataFrame({"query_id": qid[r], "vec_id": ids[c], "d": d}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "d": []})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 12) -> DataFrame:
    """query_id, vec_id, d, rank of the k nearest (vec_id, embedding) of each query (query_id, query) by Euclidean distance.

    The query set is sent to the tasks if its size, checked here, is small; otherwise blocks
    of queries meet blocks of vectors.  Only about k rows a query and block leave a task.
    Null vectors, and those without an id, are nobody's neighbours; all others must have one width.
    """
    import numpy as np

    spark = vectors.sparkSession
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    vectors = vectors.where("embedding is not null and vec_id is not null").select("vec_id", as_double("embedding").alias("embedding"))
    queries = queries.where("query is not null and query_id is not null").select("query_id", as_double("query").alias("query"))
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        rows = queries.collect()
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), np.array([r["query"] for r in rows], np.float64)))

        def search(batches):
            ids, asked = sent.value
            for pdf in batches:
                if len(pdf) and len(ids):
                    yield _block_nearest(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].tolist()), ids, asked, k)

        near = vectors.mapInPandas(search, NEAR)
    else:
        parts, blocks = max(1, -(-vectors.count() // VECTOR_BLOCK)), -(-n // QUERY_BLOCK)
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        left = vectors.withColumn("v", dealt("vec_id", parts)).withColumn("q", every(blocks))
        right = queries.withColumn("q", dealt("query_id", blocks)).withColumn("v", every(parts))

        def meet(a, b):
            if not len(a) or not len(b):
                return _block_nearest(np.empty(0), np.empty((0, 1)), np.empty(0), np.empty((0, 1)), k)
            return _block_nearest(a["vec_id"].to_numpy(), np.stack(a["embedding"].tolist()), b["query_id"].to_numpy(), np.stack(b["query"].tolist()), k)

        near = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInPandas(meet, NEAR)
    best = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return near.withColumn("d", F.round("d", 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Centres of an index at most, and vectors that each is fitted on, about.
CENTRES, FITTED = 1_024, 20
#: Distances closer than this are told apart by id, as they are rounded.
TIE = 2e-6
VISIT = "query_id long, query array<double>, cell int, away double, reach double"


def centres_of(vectors: DataFrame, count: int):
    """Up to `count` centres of a bounded sample of vectors, by hash of the id: a few rounds of Lloyd's method."""
    import numpy as np

    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit("centre")), "vec_id").limit(count * FITTED).select("embedding").collect()
    sample = np.array([r[0] for r in rows], np.float64)
    centres = np.unique(sample[: count * 2 : 2] if len(sample) >= 2 * count else sample[:count], axis=0)
    for _ in range(5):
        near = _to_centres(sample, centres).argmin(1)
        centres = np.array([sample[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _to_centres(x, centres):
    import numpy as np

    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0))


def _meet_cell(away_of_vectors, ids, vectors, query_ids, queries, away, reach, k: int, counted):
    """Rows of NEAR of one part of a cell: of each query the vectors within its reach, the k nearest of them and ties."""
    import numpy as np
    import pandas as pd

    out = []
    for at in range(0, len(queries), 64):
        q, qid = queries[at : at + 64], query_ids[at : at + 64]
        # Triangle: a vector whose way to the centre differs by more than the reach is beyond it.
        r, c = np.nonzero((np.abs(away[at : at + 64, None] - away_of_vectors[None]) <= reach[at : at + 64, None] + TIE) & (qid[:, None] != ids[None]))
        if counted is not None:
            counted.add(len(r))
        d = np.sqrt(((q[r] - vectors[c]) ** 2).sum(1))
        order = np.lexsort((d, r))
        r, c, d = r[order], c[order], d[order]
        start = np.searchsorted(r, np.arange(len(q) + 1))
        last = np.full(len(q), np.inf)
        full = np.diff(start) >= k
        last[full] = d[start[:-1][full] + k - 1]
        keep = (d <= last[r] + TIE) & (d <= reach[at : at + 64][r] + TIE)
        out.append(pd.DataFrame({"query_id": qid[r[keep]], "vec_id": ids[c[keep]], "d": d[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "d": []})


def nearest_pruned(vectors: DataFrame, queries: DataFrame, k: int = 12, centres: int | None = None, counted=None) -> DataFrame:
    """nearest(), with vectors in cells around centres, and cells left out that can't hold any of the k nearest.

    A cell's radius is the way of its farthest vector; no vector of it is nearer to a query than the way
    to the centre less the radius.  A query first meets the cells nearest to it that hold k vectors
    together; their k-th distance is its reach, and then it meets every other cell whose bound is
    within that.  So the result is exact.  `counted`, an accumulator, takes the distances worked out.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    vectors = vectors.where("embedding is not null and vec_id is not null").select("vec_id", as_double("embedding").alias("embedding"))
    queries = queries.where("query is not null and query_id is not null").select("query_id", as_double("query").alias("query"))
    n = vectors.count()
    if not n:
        return nearest(vectors, queries, k)
    middle = centres_of(vectors, centres or int(min(CENTRES, max(1, np.sqrt(n) / 2))))

    def place(batches):
        for pdf in batches:
            far = _to_centres(np.stack(pdf["embedding"].tolist()), middle) if len(pdf) else np.empty((0, 1))
            yield pdf.assign(cell=far.argmin(1).astype("int32"), away=far.min(1)) if len(pdf) else pdf.assign(cell=pd.Series(dtype="int32"), away=0.0)

    placed = materialize(vectors.mapInPandas(place, "vec_id long, embedding array<double>, cell int, away double"), "cells")
    # One row a centre.
    held = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    size = np.array([held.get(c, (0, 0))[0] for c in range(len(middle))])
    radius = np.array([held.get(c, (0, 0))[1] for c in range(len(middle))], np.float64)
    parts = np.maximum(1, -(-size // VECTOR_BLOCK))

    def visits(first: bool):
        """Rows of VISIT: the cells that a query meets first, or those that it has to meet within its reach."""

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                far = _to_centres(np.stack(pdf["query"].tolist()), middle)
                order = np.argsort(far, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                near = np.zeros(far.shape, bool)
                np.put_along_axis(near, order, before < k + 1, axis=1)
                near &= size[None] > 0
                if first:
                    chosen, reach = near, np.full(len(pdf), np.inf)
                else:
                    reach = pdf["reach"].fillna(np.inf).to_numpy()
                    chosen = ~near & (size[None] > 0) & (far - radius[None] <= reach[:, None] + TIE)
                r, c = np.nonzero(chosen)
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[r], "query": pdf["query"].to_numpy()[r], "cell": c.astype("int32"), "away": far[r, c], "reach": reach[r]})

        return run

    cut = F.array(*(F.lit(int(p)) for p in parts))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.element_at(cut, F.col("cell") + 1)).cast("int"))

    def meet(a, b):
        if not len(a) or not len(b):
            return _meet_cell(np.empty(0), np.empty(0), np.empty((0, 1)), np.empty(0), np.empty((0, 1)), np.empty(0), np.empty(0), k, None)
        arrays = a["away"].to_numpy(), a["vec_id"].to_numpy(), np.stack(a["embedding"].tolist()), b["query_id"].to_numpy(), np.stack(b["query"].tolist())
        return _meet_cell(*arrays, b["away"].to_numpy(), b["reach"].to_numpy(), k, counted)

    def candidates(asked: DataFrame, first: bool) -> DataFrame:
        met = asked.mapInPandas(visits(first), VISIT).withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(cut, F.col("cell") + 1) - 1)))
        return dealt.groupBy("cell", "part").cogroup(met.groupBy("cell", "part")).applyInPandas(meet, NEAR)

    near = materialize(candidates(queries, True), "near")
    by_distance = Window.partitionBy("query_id").orderBy("d")
    reach = near.withColumn("_n", F.row_number().over(by_distance)).where(F.col("_n") == k).select("query_id", F.col("d").alias("reach"))
    more = candidates(queries.join(reach, "query_id", "left"), False)
    best = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return near.unionByName(more).withColumn("d", F.round("d", 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def within_budget(rows: DataFrame, group: str, order: list, cost: Column, budget: int) -> DataFrame:
    """rows with `kept`: the prefix by order whose running cost stays in the budget; the first row always."""
    w = Window.partitionBy(group).orderBy(*order)
    running = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("position", F.row_number().over(w)).withColumn("kept", (running <= budget) | (F.col("position") == 1))


def prefix_within(rows: DataFrame, group: str, order: list, cost: Column, budget: int, least: int) -> DataFrame:
    """The kept rows of within_budget with their position, where every cost is `least` or more.

    Rows beyond the place that the budget can reach at the least cost are cut in each task,
    before the groups are shuffled, so a large group is never sorted in one task.
    """
    w = Window.partitionBy(group).orderBy(*order)
    near = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= budget // least + 1)
    running = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_kept", (running <= budget) | (F.col("position") == 1)).where("_kept").drop("_kept")
