"""Availability, funnel, split and raw-profile diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.functions.timegrid import epoch_micros, month_start
from freshet.operators.features import feature_rows

N = "n_estaciones_disponibles"
# The rainy season's months.
RAINY_MONTHS = [4, 5, 10, 11]


def availability_by_month(series: DataFrame, keys: list[str]) -> DataFrame:
    """Hours per month by number of stations, and the shares that matter for quality."""
    counts = [F.count_if(F.col(N) == k).alias(f"n{k}") for k in range(4)]
    out = series.dropna(subset=["timestamp"]).groupBy(
        *keys, month_start(F.col("timestamp")).alias("month")
    ).agg(*counts, F.count(F.lit(1)).alias("total_mes"))

    def share(c: Column) -> Column:
        return c.cast("double") / F.col("total_mes")

    return out.withColumns(
        {
            "pct_n0": share(F.col("n0")),
            "pct_n1": share(F.col("n1")),
            "pct_nlt2": share(F.col("n0") + F.col("n1")),
        }
    )


def dominated_months(availability: DataFrame, share: float = 0.5) -> DataFrame:
    """Months mostly without stations, or mostly with a single one."""
    return availability.filter((F.col("pct_n0") > share) | (F.col("pct_n1") > share))


def unexplained_months(availability: DataFrame, outages: DataFrame, keys: list[str]) -> DataFrame:
    """Months with low-availability hours that touch no known outage of their series.

    ``outages`` is a table (keys, start, end); one without an end lasts to the end of the series. Each is spread over its months,
    which meet the series' months by an equi-join, so neither plan nor join grows with the list.
    """
    # Months before or after a series match nothing: the bounds of all series will do.
    first, last = (availability.agg(f("month")).scalar() for f in (F.min, F.max))
    begin = F.greatest(F.trunc(F.col("start").cast("date"), "MM"), first)
    end = F.least(F.coalesce(F.trunc(F.col("end").cast("date"), "MM"), last), last)
    touched = outages.withColumns({"_b": begin, "_e": end}).filter("_b <= _e")
    months = touched.select(*keys, F.explode(F.sequence("_b", "_e", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    low = availability.filter(F.col("n0") + F.col("n1") > 0)
    return low.join(months.distinct(), [*keys, "month"], "left_anti").select(*availability.columns)


def season_months(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rainy- and dry-season months per group, with its time range."""
    ym = month_start(F.col("timestamp"))
    rainy = F.month("timestamp").isin(RAINY_MONTHS)
    # Collapse to one row per month first, so the distinct count never sees the hours.
    months = df.groupBy(*keys, ym.alias("_ym"), rainy.alias("_rainy")).agg(
        F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi")
    )
    return months.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        F.count_if("_rainy").alias("rainy_months"),
        F.count_if(~F.col("_rainy")).alias("dry_months"),
        F.min("_lo").alias("first_ts"),
        F.max("_hi").alias("last_ts"),
    )


def stage_funnel(series: DataFrame, keys: list[str], horizon: int = 6) -> DataFrame:
    """Rows left after the quality, feature and target filters, and the loss at each.

    Low-quality hours are masked instead of removed, so all stages are counted in one
    pass over the series.
    """
    good = F.col(N) >= S.MIN_STATIONS
    masked = series.withColumns({c: F.when(good, F.col(c)) for c in ("P_basin", "Q_scs_proxy")})
    rows = feature_rows(masked, (horizon,), keys, carry=[N])
    ready = F.lit(True)
    for c in S.FEATURES:
        ready = ready & F.col(c).isNotNull()
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("after_quality"),
        F.count_if(ready).alias("after_features"),
        F.count_if(ready & F.col(f"target_{horizon}h").isNotNull()).alias("after_target"),
    )
    return out.withColumns(
        {
            "lost_quality": F.col("total") - F.col("after_quality"),
            "lost_features": F.col("after_quality") - F.col("after_features"),
            "lost_target": F.col("after_features") - F.col("after_target"),
        }
    )


def split_summary(df: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Sizes and ranges of both sides, zero targets, missing cells, leakage check."""
    cells = [c for c in df.columns if c not in (*keys, "hour_idx")]
    missing = sum((F.col(c).isNull().cast("int") for c in cells), F.lit(0))
    train, test = F.col("split") == "train", F.col("split") == "test"
    ts = F.col("timestamp")
    out = df.groupBy(*keys).agg(
        F.count_if(train).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.min(F.when(train, ts)).alias("train_from"),
        F.max(F.when(train, ts)).alias("train_to"),
        F.min(F.when(test, ts)).alias("test_from"),
        F.max(F.when(test, ts)).alias("test_to"),
        (100.0 * F.count_if(F.col(target) == 0) / F.count(F.lit(1))).alias("pct_target_zero"),
        (100.0 * F.sum(missing) / (F.count(F.lit(1)) * len(cells))).alias("pct_missing"),
    )
    return out.withColumn("no_leak", F.col("train_to") < F.col("test_from"))


def extremes_by_split(df: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Rows above the 90th percentile of all rows (both sides), per split."""
    p90 = F.percentile(target, 0.90).over(Window.partitionBy(*keys))
    marked = df.withColumn("p90_all", p90)
    return marked.groupBy(*keys).agg(
        F.max("p90_all").alias("p90_all"),
        *[
            F.count_if((F.col("split") == s) & (F.col(target) > F.col("p90_all"))).alias(f"{s}_extremes")
            for s in ("train", "test")
        ],
    )


def series_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    """Row count, range and runoff statistics of a stored series."""
    q = F.col("Q_scs_proxy")
    n = F.count(F.lit(1))
    return series.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        (100.0 * F.count_if(q.isNull()) / n).alias("pct_q_null"),
        (100.0 * F.count_if(q == 0) / n).alias("pct_q_zero"),
        F.min(q).alias("q_min"),
        F.max(q).alias("q_max"),
        F.avg(q).alias("q_mean"),
    )


def window_stats(series: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Availability inside a known outage window, both ends included."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = series.filter(F.col("timestamp").between(lo, hi))
    return inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(N) == k).alias(f"n{k}") for k in range(4)],
        F.min(N).alias("n_min"),
        F.max(N).alias("n_max"),
        F.count_if(F.col("P_basin") == 0).alias("rain_zero"),
        F.count_if(F.col("P_basin").isNull()).alias("rain_null"),
    )


def step_counts(readings: DataFrame, keys: list[str]) -> DataFrame:
    """How often each time step (seconds) separates consecutive readings of a station.

    Equal times collapse to a count first (their steps are zero). The remaining times
    are compared within station and day; steps across days come from the first and last
    time of each day. No window group exceeds one station's distinct times in a day, so
    a station with most of the readings stays spread out.
    """
    times = readings.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_copies"))
    times = times.withColumns(
        {"_t": epoch_micros(F.col("ts")), "_day": F.col("ts").cast("date")}
    )
    within = Window.partitionBy(*keys, "_day").orderBy("_t")
    seconds = ((F.col("_t") - F.lag("_t").over(within)) / 1e6).alias("step_s")
    inner = times.select(*keys, seconds).dropna().groupBy(*keys, "step_s").agg(
        F.count(F.lit(1)).alias("n")
    )
    same = times.filter("_copies > 1").groupBy(*keys).agg(F.sum(F.col("_copies") - 1).alias("n"))
    same = same.select(*keys, F.lit(0.0).alias("step_s"), "n")
    days = times.groupBy(*keys, "_day").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    across = Window.partitionBy(*keys).orderBy("_day")
    jump = ((F.col("_lo") - F.lag("_hi").over(across)) / 1e6).alias("step_s")
    outer = days.select(*keys, jump).dropna().groupBy(*keys, "step_s").agg(F.count(F.lit(1)).alias("n"))
    return inner.unionByName(same).unionByName(outer).groupBy(*keys, "step_s").agg(F.sum("n").alias("n"))


def commonest_steps(steps: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The k most frequent steps per group; ties go to the shorter step."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "step_s")
    return steps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def raw_profile(readings: DataFrame, keys: list[str], value: str = "mm") -> DataFrame:
    """Size, sensors, value range, time range and median step per station."""
    shape = readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_join(F.sort_array(F.collect_set("sensor_id")), ",").alias("sensors"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    median = counted_quantile(step_counts(readings, keys), keys, "step_s", 0.5)
    return shape.join(median.withColumnRenamed("quantile", "median_step_s"), keys, "left")


def counted_quantile(counts: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Exact interpolated quantile of values given as (value, n).

    Runs over sorted distinct values, which spill, instead of an in-memory value map.
    Steps between readings add up to the record's length T, so a station has at most
    sqrt(2 T) distinct ones (about 25,000 for ten years of whole seconds).
    """
    group = Window.partitionBy(*keys)
    ranked = counts.withColumns(
        {
            "_upto": F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)),
            "_pos": (F.sum("n").over(group) - 1) * F.lit(p),
        }
    )
    ends = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") > F.floor("_pos"), F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil("_pos"), F.col(value))).alias("_hi"),
        F.max(F.col("_pos") - F.floor("_pos")).alias("_frac"),
    )
    return ends.select(
        *keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile")
    )


def sensor_breakdown(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per sensor, only for stations with more than one (unknown counts as one)."""
    counts = readings.groupBy(*keys, "sensor_id").agg(F.count(F.lit(1)).alias("n"))
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return counts.withColumn("_sensors", several).filter("_sensors > 1").drop("_sensors")
