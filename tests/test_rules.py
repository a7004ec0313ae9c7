import pytest
from pyspark.sql import functions as F

from freshet.functions import hydrology, rules


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "p, r24, want",
    [(0.95, 0.0, 0.0066), (0.001, 0.0, 0.001), (0.95, 0.1, 0.95), (0.95, None, 0.95),
     (None, 0.0, None), (0.95, float("nan"), 0.95)],
)
def test_dry_rule(spark, p, r24, want):
    got = rules.dry_rule(F.lit(p).cast("double"), F.lit(r24).cast("double"))
    assert one(spark, got) == want


def test_dry_rule_on_rows_is_idempotent(spark):
    df = spark.createDataFrame([(0.9, 0.0), (0.5, 0.0), (0.9, 3.0)], "p double, r double")
    once = df.withColumn("p", rules.dry_rule(F.col("p"), F.col("r")))
    twice = once.withColumn("p", rules.dry_rule(F.col("p"), F.col("r")))
    assert [r.p for r in once.collect()] == [0.0066, 0.0066, 0.9]
    assert [r.p for r in twice.collect()] == [0.0066, 0.0066, 0.9]


def test_cap_is_normal(spark):
    assert one(spark, rules.state(F.lit(rules.DRY_PROBABILITY_CAP))) == "NORMAL"


@pytest.mark.parametrize(
    "p, want",
    [(0.2999, "NORMAL"), (0.30, "PRECAUCIÓN"), (0.6999, "PRECAUCIÓN"), (0.70, "ALERTA"), (None, None)],
)
def test_thresholds_are_inclusive(spark, p, want):
    assert one(spark, rules.state(F.lit(p).cast("double"))) == want


def test_labels(spark):
    labels = [one(spark, rules.label_of_level(rules.level(F.lit(s)))) for s in rules.STATES]
    assert labels == ["Sin alerta", "Precaución", "Alerta roja"]
    assert one(spark, rules.level(F.lit("other"))) == 0
    assert one(spark, rules.label_of_level(F.lit(-1))) == "Sin datos"


def test_runoff_boundary(spark):
    ia = hydrology.abstraction(hydrology.DEFAULT_CN)
    assert one(spark, hydrology.runoff(ia, hydrology.DEFAULT_CN)) == 0.0
    assert one(spark, hydrology.runoff(ia + 10, hydrology.DEFAULT_CN)) > 0
    assert one(spark, hydrology.runoff(F.lit(None).cast("double"), hydrology.DEFAULT_CN)) is None
    assert one(spark, ia) == pytest.approx(11.84, abs=0.01)
    assert one(spark, hydrology.runoff(F.lit(0.0), 100.0)) == 0.0


def test_composite_curve_number(spark):
    reaches = spark.createDataFrame(
        [("b", *r) for r in hydrology.DEFAULT_REACHES], "basin string, reach string, area_share double, cn double"
    )
    assert hydrology.composite_cn(reaches, ["basin"]).first().cn == hydrology.DEFAULT_CN
