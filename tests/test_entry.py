"""The driver contract: every query runs, and agrees with its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__
from compare import canonical

SF = "/root/testdata/sf0.001"
FROM_CATALOG = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", FROM_CATALOG)
def test_query(spark, con, name):
    ours = __spark_entry__.queries()[name](spark, SF).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        theirs = con.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert canonical(ours) == canonical(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["job_id", "t", "reasons", "score"]


def test_plans_have_no_cartesian_product(spark):
    for name in ("overlap_pairs", "span_owner_argmax", "tiered_window_pick", "nearest_anchor", "boundary_shortlist"):
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
