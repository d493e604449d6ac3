"""Compares queries with their SQL: python tests/oracle.py [sf] [name...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple("∅" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def compare(spark, name, f, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = f(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description), (name, df.columns)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        raise AssertionError(f"{name}: {len(got)} and {len(want)} rows; only here {sorted(a)[:2]}, only there {sorted(b)[:2]}")
    return len(got)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sqls, qs = e.oracle_sql(), e.queries()
    for name in sys.argv[2:] or [n for n in qs if not n.startswith(("op", "pipeline"))]:
        s = time.time()
        try:
            n = compare(spark, name, qs[name], sqls[name], f"/root/testdata/{sf}") if name in sqls else qs[name](spark, f"/root/testdata/{sf}").count()
            print("OK" if name in sqls else "rows", name, n, round(time.time() - s, 1), flush=True)
        except Exception as x:
            print("BAD", name, str(x)[:int(os.environ.get("CHARS", "500"))], flush=True)
