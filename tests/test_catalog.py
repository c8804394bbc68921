"""Every registered query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

from factloom.plans import catalog, catalog_more, catalog_writes  # noqa: F401 - the others add to the first
from factloom.plans.derived import GIVEN

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    twin = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in twin.description]
    assert sorted(found.columns) == sorted(columns)
    assert table(found.collect(), found.columns) == table(twin.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
