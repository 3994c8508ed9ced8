"""Every query with SQL against DuckDB on the smallest tables; the others run and have a stable schema."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

CORE = [m for m in entry._plans() if ".llm." not in m.__name__]
QUERIES = {k: f for m in CORE for k, f in m.queries().items()}
SQL = {k: s for m in CORE if hasattr(m, "oracle_sql") for k, s in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(cells, names):
    at = [names.index(n) for n in sorted(names)]
    plain = lambda v: "nan" if isinstance(v, float) and v != v else v + 0.0 if isinstance(v, float) else v
    return Counter(tuple(plain(r[i]) for i in at) for r in cells)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_cartesian_products(spark):
    """Joins of the tables run on keys; only single rows (bounds, totals) are joined without."""
    for name in ("knn_links", "radius_join", "tiered_lookup", "components", "voronoi_boundary"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_only_what_they_use(spark):
    plan = QUERIES["grid_filter_best"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "descriptor" not in plan
