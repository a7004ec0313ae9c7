"""Checks of the runoff series around known events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.timegrid import day_index, epoch_micros

HALF_WINDOW_HOURS = 48
TOP_SHARE = 0.95
HOUR_MICROS = 3_600_000_000


def percentile_of(value: Column, scalar: Column) -> Column:
    """Aggregate: share (in %) of known values at or below a scalar; NULL if either is unknown."""
    return 100.0 * F.avg(F.when(value.isNotNull(), (value <= scalar).cast("double")))


def ranked_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """Add each runoff value's percentile in its series and the series' top-5 % threshold.

    Ranks come from one sorted pass per series, so any number of events is looked up
    without scanning the series again for each.
    """
    known = Window.partitionBy(*keys, F.col("Q_scs_proxy").isNull()).orderBy("Q_scs_proxy")
    top = F.percentile("Q_scs_proxy", TOP_SHARE).over(Window.partitionBy(*keys))
    pct = F.when(F.col("Q_scs_proxy").isNotNull(), 100.0 * F.cume_dist().over(known))
    return series.select("*", pct.alias("percentile"), top.alias("top_threshold"))


def windows(series: DataFrame, events: DataFrame, keys: list[str], hours: int = HALF_WINDOW_HOURS) -> DataFrame:
    """Series rows within ± ``hours`` of each event, both ends included.

    ``events`` has ``keys``, ``event_id`` and ``event_ts``. Both sides meet on the
    calendar day (an event touches a handful of days), so this is an equi-join with
    a range check rather than a comparison of every event with every row.
    """
    at = epoch_micros(F.col("event_ts")) / HOUR_MICROS
    spread = events.withColumns({"_lo": F.ceil(at - hours), "_hi": F.floor(at + hours)})
    spread = spread.withColumn("_day", F.explode(F.sequence(day_index(F.col("_lo")), day_index(F.col("_hi")))))
    rows = series.withColumn("_day", day_index(F.col("hour_idx")))
    inside = F.col("hour_idx").between(F.col("_lo"), F.col("_hi"))
    return rows.join(spread, [*keys, "_day"]).filter(inside).drop("_day", "_lo", "_hi")


def nearest(windowed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The row closest in time to each event; the earlier one when two are as close."""
    away = F.abs(F.col("hour_idx") * HOUR_MICROS - epoch_micros(F.col("event_ts")))
    pick = F.struct(away.alias("_away"), "hour_idx", *values)
    best = windowed.groupBy(*keys, "event_id").agg(F.min(pick).alias("_best"))
    return best.select(
        *keys, "event_id", *[F.col("_best").getField(c).alias(c) for c in ("hour_idx", *values)]
    )


def verdicts(series: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Per event: the nearest hour, its percentile, and whether it misses the top 5 %.

    Events without a single row in their window keep NULLs and no verdict.
    """
    values = ["timestamp", "P_basin", "P_acc_24h", "Q_scs_proxy", "percentile", "top_threshold"]
    found = nearest(windows(ranked_series(series, keys), events, keys), keys, values)
    out = events.join(found, [*keys, "event_id"], "left")
    q = F.col("Q_scs_proxy")
    flag = F.when(F.col("timestamp").isNotNull(), q.isNull() | (q < F.col("top_threshold")))
    return out.withColumn("red_flag", flag)
