"""Every core query with SQL gives what DuckDB gives; every other one runs."""

import pytest

from claimloom.plans import catalogue
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, con, name):
    same, _, _, detail = compare(spark, con, name, catalogue.QUERIES[name], catalogue.SQL[name], SF)
    assert same, detail


def test_every_query_has_a_schema(spark):
    for name, query in catalogue.QUERIES.items():
        if name not in ("link_incremental", "p5_found", "p5_review", "registry_exact", "registry_batch"):
            assert query(spark, SF).columns, name
