"""Report lines: figures rounded as printf rounds them, no group left out."""

import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import report
from lexspan.plans import catalogue, corpus  # noqa: F401  (registers its queries)


def test_figures_are_rounded_by_their_exact_value(spark):
    rng = random.Random(4)
    rows = [0.125, 0.375, 0.25, 0.35, 0.45, 1.005, 2.675, 60.555, 0.145, 1e-9, 0.0, 123456.75, -0.125] + [rng.randrange(10**7) / 10 ** rng.randrange(2, 7) for _ in range(3_000)]
    frame = spark.createDataFrame([(x,) for x in rows], "x double").coalesce(1)
    got = frame.select("x", *(report.fixed(F.col("x"), d).alias(f"d{d}") for d in (1, 2, 3))).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(f"{r.x:.{d}f}" for d in (1, 2, 3)) for r in got] and len(got) == len(rows)
    assert frame.limit(1).select(report.fixed(F.lit(None).cast("double"), 2)).first()[0] is None


@pytest.mark.parametrize("name", ["arm_summary", "report_tables", "summary_file"])
def test_summaries_of_odd_events_equal_their_sql(spark, tmp_path, name):
    import duckdb
    import oracle

    rng = random.Random(6)
    # Costs and seconds at halves, calls of one number, a group of one call, users and kinds that are null.
    rows = [(i, rng.choice([None, *range(9)]), rng.choice(["a", "b", None])) for i in range(900)]
    rows += [(0, u, "dup") for u in (2, 4, 4)] + [(250, 2, "dup"), (1_250, 4, "dup"), (350, 8, "one"), (50, 1, "one")]
    rows += [(1_000 * k + 185, 2 * k, "dear") for k in range(1, 6)] + [(1_000 * k + 100 + 70, 2, "dear") for k in range(30)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    cur = con.execute(catalogue.SQL[name])
    want = oracle.rows_of([c[0] for c in cur.description], cur.fetchall())
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    got = oracle.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == want and len(got) > 8
