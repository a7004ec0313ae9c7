"""Reading scans: text landing files to typed readings."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.functions.text import bare_code
from freshet.sources.columns import first_candidate, reading_columns


def scan_text(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """All stations in one scan, every column as text (no inference pass over the data)."""
    reader = spark.read.schema(S.READINGS_TEXT)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def scan_series(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored series or log; rows come in no particular order until a report sorts them."""
    return spark.read.format(fmt).load(path)


def typed(raw: DataFrame) -> DataFrame:
    """Typed readings: bad numbers and times become NULL, rows without a time are dropped.

    Columns are found by candidate name; all other columns are kept because identity
    of readings is decided on the whole row.
    """
    cols = reading_columns(raw)
    station = first_candidate(raw.columns, S.STATION_NAMES)
    renamed = {
        "sensor_id": bare_code(F.col(cols["sensor"])),
        "ts": F.trim(F.col(cols["time"]).cast("string")).try_cast("timestamp_ntz"),
        "mm": F.nanvl(F.col(cols["value"]).try_cast("double"), F.lit(None).cast("double")),
    }
    if station:
        renamed["station_id"] = bare_code(F.col(station))
    used = {*cols.values(), station}
    rest = [c for c in raw.columns if c not in used]
    return raw.select(*[e.alias(n) for n, e in renamed.items()], *rest).dropna(subset=["ts"])


def in_range(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a published table with start <= time <= end, by the first date column it has, in order of preference.

    A table without a usable date column gives no row (and a warning) instead of a wrong selection.
    """
    column = first_candidate(raw.columns, S.DATE_NAMES)
    if column is None:
        warnings.warn(f"no date column among {raw.columns}: nothing is read", stacklevel=2)
        return raw.limit(0)
    ts = F.trim(F.col(column).cast("string")).try_cast("timestamp_ntz")
    return raw.filter(ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def absent_stations(readings: DataFrame, meta: DataFrame) -> DataFrame:
    """Configured stations without a single reading."""
    return meta.join(readings.select("station_id").distinct(), "station_id", "left_anti")


def require_any(readings: DataFrame) -> DataFrame:
    if readings.isEmpty():
        raise FileNotFoundError("no readings for any configured station")
    return readings
