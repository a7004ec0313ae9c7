"""Parity between two computations of the same features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet import schema as S

EPSILON = 1e-6
SAMPLE = 500
SEED = 42


class ParityError(RuntimeError):
    """Two computations of the same features disagree."""


def seeded_sample(df: DataFrame, n: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """min(n, rows) rows, the same ones on every run: the smallest seeded hashes of the key."""
    key = F.xxhash64(F.lit(seed), "basin", "hour_idx")
    return df.withColumn("_h", key).orderBy("_h", "basin", "hour_idx").limit(n).drop("_h")


def mismatches(
    expected: DataFrame,
    actual: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    eps: float = EPSILON,
) -> DataFrame:
    """One row per expected row and column that differs by more than ``eps``.

    Unknown on one side only is a mismatch, unknown on both is not. A row without a
    counterpart is one mismatch with ``feature`` = 'missing'. Only differing columns
    are expanded, so agreement costs one join and no extra rows.
    """
    columns = columns or list(S.FEATURES)
    left = expected.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("_e"))
    right = actual.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("_a"))
    joined = left.join(right, keys, "left")

    def pair(c: str):
        e, a = F.col("_e").getField(c), F.col("_a").getField(c)
        return F.struct(F.lit(c).alias("feature"), e.alias("expected"), a.alias("actual"))

    def differs(p):
        e, a = p.getField("expected"), p.getField("actual")
        return F.coalesce(F.abs(e - a) > eps, e.isNull() != a.isNull())

    nothing = F.lit(None).cast("double")
    missing = F.array(
        F.struct(F.lit("missing").alias("feature"), nothing.alias("expected"), nothing.alias("actual"))
    )
    found = F.when(F.col("_a").isNull(), missing).otherwise(
        F.filter(F.array(*[pair(c) for c in columns]), differs)
    )
    return joined.select(*keys, F.inline(found))


def require_parity(expected: DataFrame, actual: DataFrame, keys: list[str]) -> None:
    """Raise with the first 20 mismatches, so nothing is published after a disagreement."""
    first = mismatches(expected, actual, keys).orderBy(*keys, "feature").limit(20).collect()
    if first:
        raise ParityError("features disagree: " + "; ".join(str(r.asDict()) for r in first))
