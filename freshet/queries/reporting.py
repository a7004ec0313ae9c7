"""Report queries over the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import rules
from freshet.functions.timegrid import local_now
from freshet.operators.series import every_kth
from freshet.plans import reporting as rep
from freshet.queries import query
from freshet.queries.base import KEYS, long_series, r6, scored_rows, series
from freshet.queries.sql import LEVEL, r, with_ctes
from freshet.session import shared_folder
from freshet.sources import tables

LOG_SQL = f"""basin, timestamp, {r('P_basin')} AS P_basin, {r('Q_actual')} AS Q_actual, {r('Q_lag_1h')} AS Q_lag_1h,
  {r('roll_sum_24h')} AS roll_sum_24h, hora_dia, mes, {r('proba_modelo')} AS proba_modelo,
  {r('proba_alerta')} AS proba_alerta, estado"""
MONTHS = "['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic']"
LABEL = "CASE {0} WHEN 2 THEN 'Alerta roja' WHEN 1 THEN 'Precaución' WHEN 0 THEN 'Sin alerta' ELSE 'Sin datos' END"


def _log(spark, sf_dir):
    return rep.prediction_log(scored_rows(spark, sf_dir))


@query("prediction_log", "I2 H3 H4 B11", with_ctes(f"SELECT {LOG_SQL} FROM log", "log"))
def prediction_log(spark, sf_dir):
    return r6(_log(spark, sf_dir))


@query(
    "rules_reapplied", "I7 H3 H4",
    with_ctes(f"SELECT basin, timestamp, {r('proba_alerta')} AS proba_alerta, estado FROM log", "log"),
)
def rules_reapplied(spark, sf_dir):
    """An old log without rules (raw probability, no states) read through the rules."""
    old = scored_rows(spark, sf_dir).withColumns(
        {"proba_alerta": F.col("proba_modelo"), "estado": F.lit(rules.STATES[0])}
    )
    again = rep.reapply_rules(rep.reapply_rules(old))
    return r6(again.select("basin", "timestamp", "proba_alerta", "estado"))


@query(
    "states_by_year", "D30",
    with_ctes(
        """SELECT basin, CAST(year(timestamp) AS INTEGER) AS anio, count(*) FILTER (estado = 'NORMAL') AS "NORMAL",
             count(*) FILTER (estado = 'PRECAUCIÓN') AS "PRECAUCIÓN", count(*) FILTER (estado = 'ALERTA') AS "ALERTA"
           FROM log GROUP BY ALL""", "log"),
)
def states_by_year(spark, sf_dir):
    return rep.state_by_year(_log(spark, sf_dir))


DAILY = f"SELECT basin, CAST(timestamp AS DATE) AS dia, max({LEVEL}) AS nivel, max(proba_alerta) AS proba_max FROM log GROUP BY ALL"


@query(
    "daily_worst_state", "D31 D34 H15",
    with_ctes(f"SELECT basin, dia, CAST(nivel AS INTEGER) AS nivel, {r('proba_max')} AS proba_max FROM daily", "log", daily=DAILY),
)
def daily_worst_state(spark, sf_dir):
    return r6(rep.daily_worst(_log(spark, sf_dir)))


CAL = """SELECT basin, CAST(unnest(generate_series(max(dia) - INTERVAL 89 DAY, CAST(max(dia) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS dia
         FROM daily GROUP BY basin"""
CAL_FULL = "SELECT cal.basin, cal.dia, CAST(coalesce(nivel, -1) AS INTEGER) AS nivel FROM cal LEFT JOIN daily USING (basin, dia)"


@query(
    "alert_calendar", "C11 D31",
    with_ctes(f"SELECT basin, dia, nivel, {LABEL.format('nivel')} AS etiqueta FROM full_cal", "log", daily=DAILY, cal=CAL, full_cal=CAL_FULL),
)
def alert_calendar(spark, sf_dir):
    return rep.calendar(_log(spark, sf_dir))


@query(
    "days_without_readings", "C14",
    with_ctes("SELECT basin, dia FROM full_cal WHERE nivel = -1", "log", daily=DAILY, cal=CAL, full_cal=CAL_FULL),
)
def days_without_readings(spark, sf_dir):
    return rep.missing_days(_log(spark, sf_dir))


def _trailing_sql(source: str) -> str:
    part = "coalesce(sum(P_basin) FILTER (timestamp >= last - INTERVAL {}), 0)"
    return with_ctes(
        f"""SELECT basin, {r(part.format("24 HOUR"))} AS ult_24h, {r(part.format("7 DAY"))} AS ult_7d,
              {r(part.format("30 DAY"))} AS ult_30d, CAST(max(last) AS DATE) AS ref_fecha
            FROM (SELECT *, max(timestamp) OVER (PARTITION BY basin) AS last FROM {source}) GROUP BY basin""", source)


@query("trailing_rain_totals", "D32", _trailing_sql("proxy"))
def trailing_rain_totals(spark, sf_dir):
    return r6(rep.trailing_rain(series(spark, sf_dir)))


@query("long_trailing_rain_totals", "D32", _trailing_sql("long_proxy"))
def long_trailing_rain_totals(spark, sf_dir):
    return r6(rep.trailing_rain(long_series(spark, sf_dir)))


@query(
    "alert_days_last_month", "D33",
    with_ctes(
        """SELECT basin, count(DISTINCT CAST(timestamp AS DATE)) FILTER (estado = 'ALERTA') AS dias_alerta
           FROM (SELECT *, max(timestamp) OVER (PARTITION BY basin) AS last FROM log)
           WHERE timestamp >= last - INTERVAL 30 DAY GROUP BY basin""", "log"),
)
def alert_days_last_month(spark, sf_dir):
    return rep.alert_days(_log(spark, sf_dir))


@query(
    "latest_days_above_normal", "F4 D31 D34 H9",
    with_ctes(
        f"""SELECT basin, CAST(rank AS INTEGER) AS rank, dia, CASE nivel WHEN 2 THEN 'ALERTA' ELSE 'PRECAUCIÓN' END AS estado,
              {r('proba_max')} AS proba_max, lpad(CAST(day(dia) AS VARCHAR), 2, '0') || '-' || {MONTHS}[month(dia)] AS fecha
            FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY dia DESC) AS rank FROM daily WHERE nivel > 0)
            WHERE rank <= 6""", "log", daily=DAILY),
)
def latest_days_above_normal(spark, sf_dir):
    return r6(rep.recent_alert_days(_log(spark, sf_dir)))


@query(
    "recent_log_rows", "F3 B14 H15",
    with_ctes(
        f"""SELECT basin, timestamp, round(P_basin, 2) AS P_basin, round(Q_actual, 2) AS Q_actual, round(Q_lag_1h, 2) AS Q_lag_1h,
              round(roll_sum_24h, 2) AS roll_sum_24h, hora_dia, mes, round(proba_modelo, 2) AS proba_modelo,
              round(proba_alerta, 2) AS proba_alerta, {LABEL.format(LEVEL)} AS estado, CAST(rank AS INTEGER) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY timestamp DESC) AS rank FROM log) WHERE rank <= 100""", "log"),
)
def recent_log_rows(spark, sf_dir):
    return rep.recent_log(_log(spark, sf_dir))


@query(
    "recent_log_with_display_names", "B14 F3",
    with_ctes(
        f"""SELECT basin, timestamp AS "Fecha y hora", round(P_basin, 2) AS "Lluvia en la cuenca (mm/h)", round(Q_actual, 2) AS "Escorrentía actual",
              round(Q_lag_1h, 2) AS "Escorrentía hace 1 h", round(roll_sum_24h, 2) AS "Lluvia acumulada 24 h", hora_dia AS "Hora del día",
              mes AS "Mes", round(proba_modelo, 2) AS "Probabilidad del modelo (antes de la regla)", round(proba_alerta, 2) AS "Probabilidad de riesgo",
              {LABEL.format(LEVEL)} AS "Estado de alerta", CAST(rank AS INTEGER) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY timestamp DESC) AS rank FROM log) WHERE rank <= 24""", "log"),
)
def recent_log_with_display_names(spark, sf_dir):
    """The last day of the log as the report shows it."""
    return rep.display_names(rep.recent_log(_log(spark, sf_dir), k=24))


@query(
    "hours_behind_the_local_clock", "H13",
    with_ctes("SELECT basin, true AS behind, true AS same_clock FROM (SELECT DISTINCT basin FROM proxy)", "proxy"),
)
def hours_behind_the_local_clock(spark, sf_dir):
    """Each series' last hour against the gauges' wall clock: readings are of the past, and the clock is five hours behind UTC."""
    last = series(spark, sf_dir).groupBy("basin").agg(F.max("timestamp").alias("_last"))
    now = local_now()
    utc = F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    same = F.abs(F.unix_timestamp(utc) - F.unix_timestamp(now) - 5 * 3600) <= 1
    return last.select("basin", (F.col("_last") < now).alias("behind"), same.alias("same_clock"))


@query(
    "current_state", "E13 H9",
    with_ctes(
        f"""SELECT basin, timestamp, {r('proba_alerta')} AS proba_alerta, estado,
              strftime(timestamp, '%d-') || {MONTHS}[month(timestamp)] || strftime(timestamp, '-%Y %H:%M') AS fecha
            FROM log QUALIFY row_number() OVER (PARTITION BY basin ORDER BY timestamp DESC) = 1""", "log"),
)
def current_state(spark, sf_dir):
    return r6(rep.current_state(_log(spark, sf_dir)))


@query(
    "reading_at_a_moment", "C12",
    with_ctes(f"""SELECT {LOG_SQL} FROM log WHERE CAST(timestamp AS DATE) = DATE '2024-01-16'
                    AND strftime(timestamp, '%H:%M') = '15:00'""", "log"),
)
def reading_at_a_moment(spark, sf_dir):
    return r6(rep.reading_at(_log(spark, sf_dir), "2024-01-16", "15:00"))


@query(
    "hours_by_state_in_range", "D41 B8",
    with_ctes(
        """SELECT basin, count(*) FILTER (estado = 'ALERTA') AS horas_alerta, count(*) FILTER (estado = 'PRECAUCIÓN') AS horas_precaucion
           FROM log WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-27' GROUP BY basin""", "log"),
)
def hours_by_state_in_range(spark, sf_dir):
    return rep.hours_by_state(_log(spark, sf_dir), "2024-01-08", "2024-01-27")


@query(
    "default_report_range", "B8",
    with_ctes(
        """SELECT basin, greatest(min(CAST(timestamp AS DATE)), CAST(max(CAST(timestamp AS DATE)) - INTERVAL 90 DAY AS DATE)) AS desde,
             max(CAST(timestamp AS DATE)) AS hasta FROM (SELECT * FROM proxy UNION ALL SELECT * FROM long_proxy) GROUP BY basin""",
        "proxy", "long_proxy"),
)
def default_report_range(spark, sf_dir):
    both = series(spark, sf_dir).unionByName(long_series(spark, sf_dir))
    return rep.default_range(both)


@query(
    "thinned_warning_marks", "E12",
    with_ctes(
        """SELECT basin, timestamp FROM (SELECT basin, timestamp, row_number() OVER (PARTITION BY basin ORDER BY timestamp) - 1 AS i,
             count(*) OVER (PARTITION BY basin) AS n FROM long_quality WHERE P_basin > 0) WHERE i % greatest(1, n // 200) = 0""", "long_quality"),
)
def thinned_warning_marks(spark, sf_dir):
    from freshet.operators.series import quality_split

    wet = quality_split(long_series(spark, sf_dir))[0].filter("P_basin > 0")
    return every_kth(wet, KEYS, "timestamp").select("basin", "timestamp")


@query(
    "serving_snapshot", "A15 A16",
    with_ctes("SELECT basin, CAST(timestamp AS DATE) AS dia, count(*) AS n, count(*) > 0 AS stamped FROM log GROUP BY ALL", "log"),
)
def serving_snapshot(spark, sf_dir):
    """Published twice (full replace), seeded not at all, then read back per day."""
    path = shared_folder(spark, "lecturas")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    log = _log(spark, sf_dir)
    tables.seed_snapshot(spark, log, table, path)
    tables.publish_snapshot(log, table, path)
    tables.seed_snapshot(spark, log.limit(0), table, path)
    back = spark.table(table)
    return back.groupBy("basin", "dia").agg(
        F.count(F.lit(1)).alias("n"), (F.count("actualizado_en") > 0).alias("stamped")
    )


