"""Every registered query against its SQL on the smallest tables, and plan-wide rules."""

import duckdb
import pytest
from tests.conftest import SMALL

import check
from freshet.queries import load_all

QUERIES = load_all()
# The smallest tables leave no dataset rows, and the learners refuse an empty side.
NEEDS_ROWS = {n for n in QUERIES if n.startswith("forest_")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NEEDS_ROWS))
def test_query_matches_sql(spark, con, name):
    result, _ = check.compare(spark, con, name, QUERIES[name], SMALL)
    assert result.startswith("ok"), result


def test_inventory_is_covered():
    sizes = {"A": 18, "B": 15, "C": 14, "D": 42, "E": 14, "F": 7, "G": 5, "H": 16, "I": 7, "J": 8}
    wanted = {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)}
    covered = {c for q in QUERIES.values() for c in q.covers}
    assert wanted - covered == set() and covered - wanted == set()


@pytest.mark.parametrize("name", sorted(
    n for n in set(QUERIES) - NEEDS_ROWS if QUERIES[n].sql and not n.startswith(("stream", "live", "incremental", "arriving"))))
def test_plans_have_no_python_and_no_pairing(spark, name):
    plan = QUERIES[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "EvalPython", "CartesianProduct", "NestedLoopJoin", "InPandas"):
        assert word not in plan, word
