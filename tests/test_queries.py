"""Every registered query against its SQL oracle in DuckDB, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from tidemark import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def comparable(v):
    return (v is not None, repr(round(v, 6)) if isinstance(v, float) else str(v))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted([comparable(r[c]) for c in columns] for r in found.collect())
    if name not in registry.oracle_sql():
        assert rows
        return
    result = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted([comparable(r[i]) for i in at] for r in result.fetchall())


def test_names_and_oracles_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())


NO_PYTHON = ["reconcile_plan", "clock_compare", "orphan_chunks", "deny_components", "nearest_policy", "debounce", "lru_eviction", "conflict_groups", "manifest_build"]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_native_plans(spark, name):
    """The main paths stay in the JVM, and none multiplies two tables."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan


def test_alignment_shuffles_once(spark):
    """Three sides meet in one exchange on the path."""
    plan = registry.queries()["reconcile_plan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
