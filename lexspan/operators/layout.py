"""Layout of one walk for reading: rows of what each search result led to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT = "query_id {key}, row int, searched string, place int, source string, id string, hop int, path array<string>"


def walk_rows(walks: DataFrame) -> DataFrame:
    """query_id, row, searched, place, source, id, hop, path of walks (query_id, searched array, traversed array, edges array<struct<source, target, hop>>).

    A row begins with its search result (source null, hop -1) and the holder it was lifted
    to (hop 0); then every node stands once, under the first source that leads to it, sources
    in breadth-first order.  What no edge leads to stands at the end of the last row (hop null).
    path: the node and those before it, by the last edge to each, back to where no edge leads or
    the way comes round.  Null arrays are empty; each edge is looked at once.
    """
    key = dict(walks.dtypes)["query_id"]
    names = [c.split()[0] for c in LAYOUT.split(", ")[1:]]

    def place(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
        for batch in batches:
            out, of = [], []
            columns = (batch.column(c).to_pylist() for c in ("searched", "traversed", "edges"))
            for n, (searched, traversed, found) in enumerate(zip(*columns)):
                edges = [(e["source"], e["target"], e["hop"]) for e in found or ()]
                source_of = {t: s for s, t, _ in edges}
                rows = _rows(searched or [], traversed or [], edges)
                out += [(*r, _way(r[4], source_of)) for r in rows]
                of += [n] * len(rows)
            held = list(zip(*out)) or [()] * len(names)
            # Keys never leave Arrow, so null or large ones come back as they are.
            arrays = [batch.column("query_id").take(pa.array(of, pa.int64())), *(pa.array(v, k) for v, k in zip(held, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", *names])

    return walks.select("query_id", "searched", "traversed", "edges").mapInArrow(place, LAYOUT.format(key=key))


def _way(node: str, source_of: dict[str, str]) -> list[str]:
    path: dict[str, None] = {}
    while node is not None and node not in path:
        path[node] = None
        node = source_of.get(node)
    return list(path)


def _rows(searched: list[str], traversed: list[str], edges: list[tuple[str, str, int]]) -> list[tuple]:
    lifts = {s: t for s, t, hop in edges if hop == 0}
    hops = {t: hop for _, t, hop in edges}
    leads: dict[str, list[tuple[str, int]]] = {}
    for s, t, hop in edges:
        if hop:
            leads.setdefault(s, []).append((t, hop))
    searched = list(dict.fromkeys(searched))
    out, seen = [], set()
    for row, start in enumerate(searched):
        line = [(None, start, -1)] + ([(start, lifts[start], 0)] if start in lifts else [])
        seen.update(node for _, node, _ in line)
        for _, source, _ in line:  # grows while it is gone through
            for t, hop in leads.get(source, ()):
                if t not in seen:
                    seen.add(t)
                    line.append((source, t, hop))
        out += [(row, start, place, s, t, hop) for place, (s, t, hop) in enumerate(line)]
    rest = [t for t in traversed if t not in seen]
    if rest and searched:
        last = out[-1][2] + 1
        out += [(len(searched) - 1, searched[-1], last + n, searched[-1], t, hops.get(t)) for n, t in enumerate(rest)]
    return out


def reveal_order(rows: DataFrame) -> DataFrame:
    """rows with `reveal`, the place in which nodes appear: search results, lifted holders, then by hop."""
    from pyspark.sql import Window

    tier = F.when(F.col("hop") == -1, 0).when(F.col("hop") == 0, 1).otherwise(2)
    far = F.coalesce("hop", F.lit(2**31 - 1))
    order = Window.partitionBy("query_id").orderBy(tier, F.when(tier == 2, far).otherwise(0), "row", "place")
    return rows.withColumn("reveal", F.row_number().over(order))


def summary(n_searched: Column, n_traversed: Column, n_lifted: Column, n_dropped: Column) -> Column:
    """A sentence or three on a walk; nothing on the cut where n_dropped is null."""
    s = lambda c: c.cast("string")
    found = F.concat(F.lit("Search found "), s(n_searched), F.when(n_searched == 1, " provision.").otherwise(" provisions."))
    followed, reached = n_traversed - n_lifted, n_searched + n_traversed
    holder = F.when(n_lifted == 1, "its").otherwise("their")
    walked = (
        F.when(n_traversed == 0, " The walk reached nothing beyond them.").when(n_lifted == 0, F.concat(F.lit(" The walk followed their references to "), s(followed), F.lit(" more.")))
        .otherwise(F.concat(F.lit(" The walk lifted "), s(n_lifted), F.lit(" of them to "), holder, F.lit(" whole article and followed references to "), s(followed), F.lit(" more.")))
    )
    were = F.when(n_dropped == 1, "was").otherwise("were")
    cut = (
        F.when(n_dropped.isNull(), "").when(n_dropped == 0, F.concat(F.lit(" All "), s(reached), F.lit(" reached fit the prompt.")))
        .otherwise(F.concat(F.lit(" Of the "), s(reached), F.lit(" reached, "), s(n_dropped), F.lit(" "), were, F.lit(" set aside to fit the prompt, shown dashed, and never read.")))
    )
    return F.concat(found, walked, cut)
