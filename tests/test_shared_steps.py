"""Steps that the field queries share: what they sort, and how often they read the readings."""

from pyspark.sql import functions as F

from freshet.operators.runs import runs
from freshet.plans import field
from freshet.queries import field as queries
from freshet.sources import gauges, nodes
from tests.conftest import SMALL


def test_runs_of_numbers_are_hashed_and_small_steps_are_judged_without_the_time_between(spark):
    found = runs(nodes.readings(spark, SMALL), field.NODE, field.ORDER, ["level_cm"])
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = spark.sql("""SELECT * FROM VALUES (10, 20, 0, 1), (10, 21, 0, 1), (10, 30, 0, 600), (10, 31, 0, 600), (CAST(NULL AS INT), 90, 0, 1)
        AS t (a, b, s, e)""").select("a", "b", *[F.timestamp_seconds(c).cast("timestamp_ntz").alias(c) for c in ("s", "e")])
    fast = rows.select(field.too_fast(F.col("a"), F.col("s"), F.col("b"), F.col("e")).alias("fast")).collect()
    assert [r["fast"] for r in fast] == [False, True, False, True, None]
    at = spark.sql("SELECT timestamp_ntz'1970-01-01 00:04:59.999999' AS ts UNION ALL SELECT timestamp_ntz'1970-01-01 00:05:00'")
    assert sorted(r[0] for r in at.select(field.slot_of(F.col("ts"))).collect()) == [0, 1]


def test_rain_is_computed_once_for_the_checks_and_the_query(spark, monkeypatch):
    reads, readings = [], gauges.readings
    monkeypatch.setattr(gauges, "readings", lambda *a: reads.append(a) or readings(*a))
    for run in (queries.incoherent_rises, queries.runoff_by_observed_curve_number):
        reads.clear()
        run(spark, SMALL)
        assert len(reads) == 1
