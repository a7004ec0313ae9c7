"""Finding columns under the names a source happens to publish."""

from __future__ import annotations

from pyspark.sql import DataFrame

from freshet import schema as S


def first_in_table(columns: list[str], candidates: list[str]) -> str | None:
    """First column of the table, in table order, whose trimmed lower-case name is a candidate."""
    return next((c for c in columns if c.strip().lower() in candidates), None)


def first_candidate(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate, in order of preference, that is a column (exact name)."""
    return next((c for c in candidates if c in columns), None)


def reading_columns(df: DataFrame) -> dict[str, str]:
    """Sensor, value and time columns of a readings table; fails when one cannot be found."""
    wanted = {"sensor": S.SENSOR_NAMES, "value": S.VALUE_NAMES, "time": S.TIME_NAMES}
    found = {k: first_in_table(df.columns, names) for k, names in wanted.items()}
    missing = [k for k, c in found.items() if c is None]
    if missing:
        raise ValueError(f"no column found for {', '.join(missing)} among {df.columns}")
    return found


def available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only those of ``wanted`` that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
