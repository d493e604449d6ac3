"""Every query with SQL gives that SQL's rows."""

import pytest
from oracle import compare

from lexspan.plans import answers, catalogue, corpus, streams  # noqa: F401  (each registers its queries)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
