"""Landing tables: year slices, range reads, gaps and high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.text import code_variants
from freshet.functions.timegrid import hour_start, period_text
from freshet.sources.tables import write_table

# Fixed value: where an update starts when nothing is known yet.
DEFAULT_START = "2026-09-30 18:00:00"


def write_year_slices(readings: DataFrame, path: str, files: int | None = None) -> None:
    """Readings partitioned by year and range-ordered by station and time inside.

    Ranges are cut on (year, station, time), so a station with most of the rows is
    spread over several files and each file covers a narrow station and time range.
    """
    rows = readings.withColumn("year", F.year("ts"))
    order = ["year", "station_id", "ts"]
    rows = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("year").parquet(path)


def read_range(
    spark: SparkSession, path: str, start: str, end: str, stations: list[str] | None = None
) -> DataFrame:
    """Readings with start <= ts <= end; whole years outside the range are not listed."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = spark.read.parquet(path).filter(F.col("year").between(int(start[:4]), int(end[:4])))
    rows = rows.filter(F.col("ts").between(lo, hi))
    return rows.filter(F.col("station_id").isin(stations)) if stations else rows


def with_code(df: DataFrame, code: Column, column: str = "codigoestacion") -> DataFrame:
    """Rows whose code is any spelling of ``code``."""
    return df.filter(F.array_contains(code_variants(code), F.col(column)))


def expected_slices(stations: DataFrame, start: str, end: str, step: str = "7 days") -> DataFrame:
    """Ranges each station should cover: consecutive slices of ``step`` from start to end."""
    dates = F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"INTERVAL {step}")
    )
    return stations.select("station_id", F.explode(dates).alias("slice_start"))


def gap_ledger(stations: DataFrame, readings: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """Expected slices without a single reading."""
    origin = F.unix_date(F.lit(start).cast("date"))
    n = F.floor((F.unix_date(F.col("ts").cast("date")) - origin) / days)
    seen = readings.filter(n >= 0).select(
        "station_id", F.date_add(F.lit(start).cast("date"), (n * days).cast("int")).alias("slice_start")
    ).distinct()
    slices = expected_slices(stations, start, end, f"{days} days")
    missing = slices.join(seen, ["station_id", "slice_start"], "left_anti")
    last = F.least(F.date_add("slice_start", days - 1), F.lit(end).cast("date"))
    return missing.select("station_id", "slice_start", last.alias("slice_end")).withColumn(
        "rango", period_text(F.col("slice_start"), F.col("slice_end"))
    )


def record_gaps(ledger: DataFrame, path: str) -> None:
    """Replace the stored ledger; a complete download leaves it empty."""
    write_table(ledger, path)


def high_water_marks(
    stations: DataFrame, readings: DataFrame, basin_end: DataFrame, default: str = DEFAULT_START
) -> DataFrame:
    """Where each station's next read starts.

    Its last reading; without any, 72 h before the end of its basin's series, at the
    hour; without that, ``default``. ``stations`` has ``basin, station_id``,
    ``basin_end`` has ``basin, hour_idx`` (last hour of the stored series).
    """
    last = readings.groupBy("basin", "station_id").agg(F.max("ts").alias("_last"))
    out = stations.join(last, ["basin", "station_id"], "left").join(
        basin_end.select("basin", hour_start(F.col("hour_idx") - 72).alias("_safe")), "basin", "left"
    )
    start = F.coalesce("_last", "_safe", F.lit(default).cast("timestamp_ntz"))
    return out.select("basin", "station_id", start.alias("since"))


def last_reading_text(stations: DataFrame, readings: DataFrame) -> DataFrame:
    """Last reading per station as text to the minute; empty when there is none."""
    last = readings.select("station_id", "ts").groupBy("station_id").agg(F.max("ts").alias("_last"))
    text = F.date_format("_last", "yyyy-MM-dd HH:mm")
    return stations.join(last, "station_id", "left").select(
        "station_id", F.coalesce(text, F.lit("")).alias("last_reading")
    )
