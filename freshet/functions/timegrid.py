"""Hour and day grids as integers.

Series are keyed by ``hour_idx`` (hours since 1970-01-01 of the wall clock), so
window frames are plain integer ranges and nothing depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations used in Spanish dates.
MONTHS_ES = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]


def hour_index(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 3600)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of the wall clock."""
    fraction = F.extract(F.lit("SECOND"), ts) % 1
    return F.unix_timestamp(ts) * 1000000 + (fraction * 1000000).cast("long")


def hour_start(hour_idx: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), hour_idx.cast("int")
    )


def day_index(hour_idx: Column) -> Column:
    return F.floor(hour_idx / 24)


def date_index(day: Column) -> Column:
    return F.unix_date(day.cast("date")).cast("long")


def day_date(day_idx: Column) -> Column:
    return F.date_from_unix_date(day_idx.cast("int"))


def hour_of_day(hour_idx: Column) -> Column:
    return F.pmod(hour_idx, F.lit(24)).cast("int")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def spanish_date(ts: Column, with_year: bool = True, with_time: bool = True) -> Column:
    """``02-ene-2024 13:00``; year and time are optional."""
    months = F.array(*[F.lit(m) for m in MONTHS_ES])
    parts = [F.lpad(F.dayofmonth(ts).cast("string"), 2, "0"), F.element_at(months, F.month(ts))]
    if with_year:
        parts.append(F.lpad(F.year(ts).cast("string"), 4, "0"))
    text = F.concat_ws("-", *parts)
    if with_time:
        clock = [F.lpad(f(ts).cast("string"), 2, "0") for f in (F.hour, F.minute)]
        text = F.concat(text, F.lit(" "), F.concat_ws(":", *clock))
    return text


def period_text(start: Column, end: Column) -> Column:
    """``2016-01-01 a 2016-01-07``."""
    return F.concat_ws(" a ", *[d.cast("date").cast("string") for d in (start, end)])


def local_now(zone: str = "America/Bogota") -> Column:
    """Wall-clock time of the query in the gauges' zone."""
    return F.convert_timezone(None, F.lit(zone), F.current_timestamp().cast("timestamp_ntz"))
