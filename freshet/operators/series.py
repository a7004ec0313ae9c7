"""Readings -> station hours -> basin hours -> runoff estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.functions import hydrology
from freshet.functions.timegrid import hour_index, hour_start
from freshet.operators.frames import add_windowed, fill_gaps, trailing


def principal_sensor(readings: DataFrame, meta: DataFrame) -> DataFrame:
    """Readings of each station's principal sensor; unknown stations drop out."""
    m = meta.select("station_id", F.col("principal_sensor").alias("sensor_id"))
    return readings.join(m, ["station_id", "sensor_id"], "left_semi")


def qa_sensor(readings: DataFrame, meta: DataFrame) -> DataFrame:
    """Side output: readings of the sensors kept for quality checks."""
    m = meta.filter("qa_sensor IS NOT NULL")
    m = m.select("station_id", F.col("qa_sensor").alias("sensor_id"))
    return readings.join(m, ["station_id", "sensor_id"], "left_semi")


def station_hours(readings: DataFrame, value: str = "mm", unique: bool = False) -> DataFrame:
    """Hourly sum per station of distinct readings; hours with only bad values stay NULL.

    Identical rows count once. The distinct is hashed on the whole row, which also
    spreads a hot station; readings already unique (``unique=True``) skip it.
    """
    rows = readings if unique else readings.distinct()
    keyed = rows.withColumn("hour_idx", hour_index(F.col("ts")))
    return keyed.groupBy("basin", "station_id", "hour_idx").agg(F.sum(value).alias("mm"))


def basin_hours(stations: DataFrame) -> DataFrame:
    """Mean over the stations with data, and how many there were."""
    return stations.groupBy("basin", "hour_idx").agg(
        F.avg("mm").alias("P_basin"),
        F.count("mm").cast("int").alias("n_estaciones_disponibles"),
    )


def complete_grid(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every hour from a basin's first to its last; absent hours have no stations."""
    cols = ["P_basin", "n_estaciones_disponibles"]
    full = fill_gaps(hours, keys or ["basin"], "hour_idx", cols)
    n = F.coalesce("n_estaciones_disponibles", F.lit(0))
    return full.withColumn("n_estaciones_disponibles", n).drop("filled")


def with_runoff(
    hours: DataFrame,
    cn: Column | float | DataFrame = hydrology.DEFAULT_CN,
    keys: list[str] | None = None,
    chunk_len: int | None = None,
) -> DataFrame:
    """24 h accumulation (NULL under 12 valid hours) and curve-number runoff.

    ``cn`` is one number, a column, or a table with a number per key.
    """
    keys = keys or ["basin"]

    def columns(w):
        total = trailing(w, F.sum("P_basin"), S.ACCUMULATION_HOURS)
        valid = trailing(w, F.count("P_basin"), S.ACCUMULATION_HOURS)
        return {"P_acc_24h": F.when(valid >= S.MIN_VALID_HOURS, total)}

    acc = add_windowed(
        hours, keys, "hour_idx", columns,
        back=S.ACCUMULATION_HOURS, chunk_len=chunk_len,
    )
    acc, number = hydrology.with_cn(acc, cn, keys)
    return acc.withColumn("Q_scs_proxy", hydrology.runoff(F.col("P_acc_24h"), number)).drop("_cn")


def runoff_series(
    readings: DataFrame,
    cn: Column | float | DataFrame = hydrology.DEFAULT_CN,
    unique: bool = False,
    chunk_len: int | None = None,
) -> DataFrame:
    """The hourly basin series: rain, accumulation, runoff, availability.

    Gap filling and the 24 h frame share one shuffle on the basin; what reaches it is
    one row per basin and hour, whatever the number of stations or readings.
    """
    hours = basin_hours(station_hours(readings, unique=unique))
    return timestamped(with_runoff(complete_grid(hours), cn, chunk_len=chunk_len))


def timestamped(series: DataFrame) -> DataFrame:
    return series.withColumn("timestamp", hour_start(F.col("hour_idx")))


def aligned_stations(stations: DataFrame, names: list[str]) -> DataFrame:
    """Wide form: one column per named station, all hours where any of them has a row."""
    return stations.filter(F.col("station_id").isin(names)).groupBy("basin", "hour_idx").pivot(
        "station_id", names
    ).agg(F.first("mm"))


def quality_split(series: DataFrame, minimum: int = S.MIN_STATIONS) -> tuple[DataFrame, DataFrame]:
    """Rows that continue and rows set aside for too few stations."""
    n = F.col("n_estaciones_disponibles")
    return series.filter(n >= minimum), series.filter(n < minimum)


def latest_row(df: DataFrame, keys: list[str], idx: str = "hour_idx") -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c != idx]
    last = df.groupBy(*keys).agg(F.max(F.struct(idx, *rest)).alias("_last"))
    return last.select(*keys, *[F.col("_last").getField(c).alias(c) for c in [idx, *rest]])


def every_kth(df: DataFrame, keys: list[str], idx: str, at_most: int = 200) -> DataFrame:
    """First of every k rows, k = max(1, n // at_most), per group in time order."""
    order = Window.partitionBy(*keys).orderBy(idx)
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / at_most))
    marked = df.withColumn("_keep", F.pmod(F.row_number().over(order) - 1, k) == 0)
    return marked.filter("_keep").drop("_keep")
