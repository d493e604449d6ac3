"""Word diffs of whole batches: all runs, in little memory."""

import tracemalloc

import pyarrow as pa

from lexspan.operators import compare


def test_word_diff_hands_on_few_runs_at_once(monkeypatch):
    monkeypatch.setattr(compare, "SLICE_CHARS", 20_000, raising=False)
    old = [" ".join(f"w{i}x{k % 50}" for k in range(1_000)) for i in range(120)]
    new = [" ".join(f"w{i}x{k % 50 if k % 2 else -k}" for k in range(1_000)) for i in range(120)]
    old[5], new[7], old[9] = None, None, ""
    batch = pa.array(old), pa.array(new)
    sizes = []
    tracemalloc.start()
    try:
        for part in compare.word_diff.func(iter([batch])):
            sizes.append(len(part))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 1.8 MB of texts are about 360,000 runs; as dicts of the whole batch they took 83 MB.
    assert sum(sizes) == 120 and max(sizes) <= 4 and peak < 6_000_000, (sizes, peak)
    got = [row for part in compare.word_diff.func(iter([batch])) for row in part.to_pylist()]
    assert got == [dict(zip(("before", "after"), compare.diff(a, b))) for a, b in zip(old, new)]


def test_word_diff_keeps_rows_together_over_slices(spark):
    long = "a b " * 75_000  # a slice of its own
    rows = [(1, "the old rule", "the new rule"), (2, long + "c", long + "d"), (3, None, "x y"), (4, long + "e", long), (5, "", ""), (6, long, long + "f"), (7, "same.", "same.")]
    got = spark.createDataFrame(rows, "k int, a string, b string").coalesce(1).select("k", compare.word_diff("a", "b").alias("x")).collect()
    for r, (k, a, b) in zip(got, rows, strict=True):
        assert (r.k, [s.asDict() for s in r.x.before], [s.asDict() for s in r.x.after]) == (k, *compare.diff(a, b))
    assert [[s.text for s in got[1].x[side] if s.changed] for side in (0, 1)] == [["c"], ["d"]]
