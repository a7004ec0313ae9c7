"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import rules
from freshet.operators import features as feats
from freshet.operators.series import quality_split, runoff_series
from freshet.plans import evaluation
from freshet.sources import gauges

KEYS = ["basin"]


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round the named (default: all double) columns."""
    cols = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in cols})


def series(spark: SparkSession, sf_dir: str, users_per_basin: int = gauges.USERS_PER_BASIN) -> DataFrame:
    return runoff_series(gauges.readings(spark, sf_dir, users_per_basin))


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runoff_series(gauges.long_readings(spark, sf_dir))


def dataset(spark: SparkSession, sf_dir: str, horizon: int = 6) -> DataFrame:
    return feats.dataset(series(spark, sf_dir), horizon)


def surrogate() -> Column:
    """A logistic stand-in for the forest whose values SQL can reproduce."""
    z = (
        F.lit(-2.2) + 0.1 * F.col("roll_sum_24h") + 0.35 * F.col("Q_actual") + 0.15 * F.col("P_basin")
        + F.when(F.col("hora_dia") % 12 == 3, 1.8).otherwise(0.0)
    )
    return 1.0 / (1.0 + F.exp(-z))


def score(df: DataFrame) -> DataFrame:
    return df.withColumn("proba_modelo", surrogate())


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete feature row with probability and state: the prediction log."""
    quality, _ = quality_split(series(spark, sf_dir))
    return rules.with_rules(score(feats.complete(feats.feature_rows(quality))))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows with label, probability and state."""
    rows = rules.with_rules(score(dataset(spark, sf_dir)))
    return evaluation.with_label(rows, "target_6h", KEYS)


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).filter("split = 'test'")
