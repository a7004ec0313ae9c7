"""Reports over the prediction log and the basin series.

Reports that look back from "now" use the data's own last time, per basin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import rules
from freshet.functions.timegrid import date_index, day_date, day_index, hour_index, spanish_date
from freshet.operators.frames import fill_gaps
from freshet.operators.series import latest_row
from freshet.schema import LOG_COLUMNS
from freshet.sources.tables import on_days_of

KEYS = ["basin"]


def prediction_log(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Log rows from complete feature rows with ``proba_modelo``."""
    return rules.with_rules(scored).select(*keys, *LOG_COLUMNS)


def reapply_rules(log: DataFrame) -> DataFrame:
    """Rules applied again to a stored log; a current log is unchanged."""
    return rules.with_rules(log, raw="proba_alerta")


def state_by_year(log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    counts = log.groupBy(*keys, F.year("timestamp").alias("anio")).pivot("estado", rules.STATES)
    return counts.count().fillna(0, rules.STATES)


def daily_worst(log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Worst level and highest probability per day with readings."""
    day = F.col("timestamp").cast("date")
    return log.groupBy(*keys, day.alias("dia")).agg(
        F.max(rules.level(F.col("estado"))).alias("nivel"),
        F.max("proba_alerta").alias("proba_max"),
    )


def calendar(log: DataFrame, days: int = 90, keys: list[str] = KEYS) -> DataFrame:
    """The last ``days`` days up to the log's last one; a day without readings is -1."""
    daily = daily_worst(log, keys).withColumn("day_idx", date_index(F.col("dia")))
    last = F.max("day_idx").over(Window.partitionBy(*keys))
    recent = daily.withColumn("_start", last - (days - 1)).filter("day_idx >= _start")
    full = fill_gaps(recent, keys, "day_idx", ["nivel"], first_at=F.col("_start"))
    level = F.coalesce("nivel", F.lit(-1))
    return full.select(
        *keys, day_date(F.col("day_idx")).alias("dia"), level.alias("nivel"),
        rules.label_of_level(level).alias("etiqueta"),
    )


def missing_days(log: DataFrame, days: int = 90, keys: list[str] = KEYS) -> DataFrame:
    """Days of the calendar without readings."""
    return calendar(log, days, keys).filter("nivel = -1").select(*keys, "dia")


def last_days(rows: DataFrame, last: DataFrame, hours: int, day: Column, keys: list[str] = KEYS) -> DataFrame:
    """The rows on the days that hold the ``hours`` before each series' last hour, with that hour as ``_last``.

    ``last`` (keys, hour_idx) is spread over its days, so rows meet it by an equi-join on series and day whatever the
    keys are. The days are few scalars: a stored table partitioned by ``day`` reads only theirs.
    """
    ends = last.select(*keys, F.col("hour_idx").alias("_last"))
    span = F.sequence(day_index(F.col("_last") - hours), day_index(F.col("_last")))
    ends = ends.withColumn("_day", F.explode(span)).withColumn("_day", day_date(F.col("_day")))
    if "day" in rows.columns:
        rows = on_days_of(rows, ends.select(F.col("_day").alias("day")))
    return rows.withColumn("_day", day).join(ends, [*keys, "_day"]).drop("_day")


def trailing_rain(series: DataFrame, keys: list[str] = KEYS, last: DataFrame | None = None) -> DataFrame:
    """Rain of the last 24 h, 7 d and 30 d, counted back from the last hour, ends included.

    ``last`` (keys, hour_idx) spares the scan that looks for the last hours; a live update keeps such a table (``ends``).
    """
    if last is None:
        last = series.groupBy(*keys).agg(F.max("hour_idx").alias("hour_idx"))
    day = F.col("day") if "day" in series.columns else day_date(day_index(F.col("hour_idx")))
    back = last_days(series, last, 30 * 24, day, keys)
    back = back.withColumn("_ago", F.col("_last") - F.col("hour_idx")).filter(f"_ago BETWEEN 0 AND {30 * 24}")

    def total(hours: int):
        return F.coalesce(F.sum(F.when(F.col("_ago") <= hours, F.col("P_basin"))), F.lit(0.0))

    return back.groupBy(*keys).agg(
        total(24).alias("ult_24h"), total(7 * 24).alias("ult_7d"), total(30 * 24).alias("ult_30d"),
        F.max("timestamp").cast("date").alias("ref_fecha"),
    )


def alert_days(log: DataFrame, days: int = 30, keys: list[str] = KEYS, last: DataFrame | None = None) -> DataFrame:
    """Distinct dates in alert within ``days`` of the log's last hour (``last`` as in ``trailing_rain``)."""
    if last is None:
        last = log.groupBy(*keys).agg(hour_index(F.max("timestamp")).alias("hour_idx"))
    day = F.col("day") if "day" in log.columns else F.col("timestamp").cast("date")
    recent = last_days(log, last, days * 24, day, keys)
    ago = F.col("_last") - hour_index(F.col("timestamp"))
    alert = F.when(F.col("estado") == rules.STATES[2], F.col("timestamp").cast("date"))
    return recent.filter(ago.between(0, days * 24)).groupBy(*keys).agg(F.count_distinct(alert).alias("dias_alerta"))


def recent_alert_days(log: DataFrame, k: int = 6, keys: list[str] = KEYS) -> DataFrame:
    """The k latest days above normal, with worst state and highest probability."""
    order = Window.partitionBy(*keys).orderBy(F.desc("dia"))
    days = daily_worst(log, keys).filter("nivel > 0").withColumn("rank", F.row_number().over(order))
    return days.filter(F.col("rank") <= k).select(
        *keys, "rank", "dia", rules.state_of_level(F.col("nivel")).alias("estado"), "proba_max",
        spanish_date(F.col("dia").cast("timestamp_ntz"), with_year=False, with_time=False).alias("fecha"),
    )


# Display names of the log's columns.
DISPLAY = {
    "timestamp": "Fecha y hora",
    "P_basin": "Lluvia en la cuenca (mm/h)",
    "Q_actual": "Escorrentía actual",
    "Q_lag_1h": "Escorrentía hace 1 h",
    "roll_sum_24h": "Lluvia acumulada 24 h",
    "hora_dia": "Hora del día",
    "mes": "Mes",
    "proba_modelo": "Probabilidad del modelo (antes de la regla)",
    "proba_alerta": "Probabilidad de riesgo",
    "estado": "Estado de alerta",
}


def recent_log(log: DataFrame, k: int = 100, keys: list[str] = KEYS) -> DataFrame:
    """The last k rows per basin, newest ranked first, with labels and two decimals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("timestamp"))
    rows = log.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    doubles = [f.name for f in log.schema.fields if f.dataType.typeName() == "double"]
    rounded = {c: F.round(c, 2) for c in doubles}
    label = rules.label_of_level(rules.level(F.col("estado")))
    return rows.withColumns(rounded | {"estado": label})


def display_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in DISPLAY.items() if k in df.columns})


def current_state(log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    cols = [*keys, "timestamp", "proba_alerta", "estado"]
    last = latest_row(log.select(*cols), keys, "timestamp")
    return last.withColumn("fecha", spanish_date(F.col("timestamp")))


def reading_at(log: DataFrame, day: str, clock: str, keys: list[str] = KEYS) -> DataFrame:
    """The reading of one date at one HH:mm, per basin."""
    hit = (F.col("timestamp").cast("date") == F.lit(day).cast("date")) & (
        F.date_format("timestamp", "HH:mm") == clock
    )
    return latest_row(log.filter(hit), keys, "timestamp")


def default_range(series: DataFrame, days: int = 90, keys: list[str] = KEYS) -> DataFrame:
    """Default report range: the last ``days`` days, clipped to the series' start."""
    day = F.col("timestamp").cast("date")
    ends = series.groupBy(*keys).agg(F.min(day).alias("_first"), F.max(day).alias("hasta"))
    return ends.select(
        *keys, F.greatest("_first", F.date_sub("hasta", days)).alias("desde"), "hasta"
    )


def hours_by_state(log: DataFrame, start: str, end: str, keys: list[str] = KEYS) -> DataFrame:
    """Hours in caution and in alert between two dates, both included."""
    day = F.col("timestamp").cast("date")
    inside = log.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.groupBy(*keys).agg(
        F.count_if(F.col("estado") == rules.STATES[2]).alias("horas_alerta"),
        F.count_if(F.col("estado") == rules.STATES[1]).alias("horas_precaucion"),
    )
