"""SCS curve-number runoff as column expressions; the curve number may vary by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric curve-number constants, and the default basin's reaches.
RETENTION_SCALE = 25400.0
RETENTION_OFFSET = 254.0
ABSTRACTION_RATIO = 0.2
DEFAULT_REACHES = [("alto", 0.40, 70.0), ("medio", 0.30, 92.0), ("bajo", 0.30, 85.0)]
DEFAULT_CN = 81.1


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def retention(cn) -> Column:
    return F.lit(RETENTION_SCALE) / _col(cn) - F.lit(RETENTION_OFFSET)


def abstraction(cn) -> Column:
    return F.lit(ABSTRACTION_RATIO) * retention(cn)


def runoff(rain: Column, cn) -> Column:
    """Runoff depth in mm: NULL for unknown rain, 0 up to the initial abstraction."""
    excess = rain - abstraction(cn)
    return F.when(rain.isNull(), F.lit(None).cast("double")).when(
        excess <= 0, F.lit(0.0)
    ).otherwise(excess * excess / (excess + retention(cn)))


def with_cn(rows: DataFrame, cn, keys: list[str]) -> tuple[DataFrame, Column | float]:
    """Rows and the curve number to use on them.

    A table (keys, cn) is joined as column ``_cn``; what it does not name has the default.
    """
    if not isinstance(cn, DataFrame):
        return rows, cn
    return rows.join(cn.select(*keys, F.col("cn").alias("_cn")), keys, "left"), F.coalesce("_cn", F.lit(DEFAULT_CN))


def composite_cn(reaches: DataFrame, keys: list[str]) -> DataFrame:
    """Area-weighted curve number per basin, to one decimal."""
    return reaches.groupBy(*keys).agg(
        F.round(F.sum(F.col("area_share") * F.col("cn")), 1).alias("cn")
    )
