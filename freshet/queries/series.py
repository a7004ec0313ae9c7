"""Hourly series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import hydrology
from freshet.operators import dedup
from freshet.operators import series as ops
from freshet.plans import diagnostics
from freshet.queries import query
from freshet.queries.base import KEYS, long_series, r6, series
from freshet.queries.sql import r, runoff, with_ctes
from freshet.session import shared_folder
from freshet.sources import gauges
from freshet.sources.readings import scan_series
from freshet.sources.tables import write_table

PROXY_COLS = f"""basin, timestamp, {r('P_basin')} AS P_basin, {r('P_acc_24h')} AS P_acc_24h,
  {r('Q_scs_proxy')} AS Q_scs_proxy, n_estaciones_disponibles"""
PROXY = ["basin", "timestamp", "P_basin", "P_acc_24h", "Q_scs_proxy", "n_estaciones_disponibles"]


@query(
    "hourly_basin_series", "A3 C1 C2 D1 D2 D3 E1 E2 H1",
    with_ctes(f"SELECT {PROXY_COLS} FROM proxy", "proxy"),
)
def hourly_basin_series(spark, sf_dir):
    return r6(series(spark, sf_dir).select(*PROXY))


@query(
    "long_basin_series_chunked", "C2 E1 E2 H1 D3",
    with_ctes(f"SELECT {PROXY_COLS} FROM long_proxy", "long_proxy"),
)
def long_basin_series_chunked(spark, sf_dir):
    hours = ops.basin_hours(ops.station_hours(gauges.long_readings(spark, sf_dir)))
    full = ops.with_runoff(ops.complete_grid(hours), chunk_len=31 * 24)
    return r6(ops.timestamped(full).select(*PROXY))


@query(
    "station_hourly_sums", "B1 D1 D2 G3",
    with_ctes(f"SELECT basin, station_id, hour_idx, {r('mm')} AS mm FROM station_hours", "station_hours"),
)
def station_hourly_sums(spark, sf_dir):
    return r6(ops.station_hours(gauges.readings(spark, sf_dir)))


@query(
    "aligned_station_columns", "C1",
    with_ctes("""
      SELECT basin, hour_idx, max(mm) FILTER (station_id = 'S0') AS S0,
        max(mm) FILTER (station_id = 'S1') AS S1, max(mm) FILTER (station_id = 'S2') AS S2
      FROM station_hours GROUP BY ALL""", "station_hours"),
)
def aligned_station_columns(spark, sf_dir):
    stations = ops.station_hours(gauges.readings(spark, sf_dir))
    return ops.aligned_stations(stations, gauges.STATIONS)


REACHES_SQL = """
  SELECT s_nationkey % 3 AS zone, s_suppkey,
    abs(s_acctbal) / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey % 3) AS area_share,
    CAST(60 + s_suppkey % 35 AS DOUBLE) AS cn FROM supplier"""
ZONE_CN_SQL = "SELECT zone, round(sum(area_share * cn), 1) AS cn FROM reaches GROUP BY zone"


def _zone_cn(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    zone = (F.col("s_nationkey") % 3).alias("zone")
    area = F.abs("s_acctbal")
    # Shares from one grouped total: zones hold any number of reaches.
    total = s.groupBy(zone).agg(F.sum(area).alias("_total"))
    reaches = s.withColumn("zone", F.col("s_nationkey") % 3).join(total, "zone").select(
        "zone", (area / F.col("_total")).alias("area_share"),
        (60 + F.col("s_suppkey") % 35).cast("double").alias("cn"),
    )
    return hydrology.composite_cn(reaches, ["zone"])


@query("composite_curve_number", "D39", with_ctes(ZONE_CN_SQL, reaches=REACHES_SQL))
def composite_curve_number(spark, sf_dir):
    return _zone_cn(spark, sf_dir)


_S = "(25400.0::DOUBLE / cn - 254.0::DOUBLE)"


@query(
    "runoff_by_basin_curve_number", "H1 D39",
    with_ctes(
        f"""SELECT basin, timestamp, cn, {r(runoff('P_acc_24h', f'(0.2::DOUBLE * {_S})', _S))} AS q
            FROM proxy JOIN zones ON CAST(substr(basin, 2) AS BIGINT) % 3 = zones.zone""",
        "proxy", reaches=REACHES_SQL, zones=ZONE_CN_SQL,
    ),
)
def runoff_by_basin_curve_number(spark, sf_dir):
    base = series(spark, sf_dir).withColumn("zone", (F.substring("basin", 2, 9).cast("int") % 3))
    joined = base.join(_zone_cn(spark, sf_dir), "zone")
    q = hydrology.runoff(F.col("P_acc_24h"), F.col("cn"))
    return joined.select("basin", "timestamp", "cn", F.round(q, 6).alias("q"))


@query(
    "series_quality_stats", "D14 A13 A17",
    with_ctes(f"""
      SELECT basin, count(*) AS n_rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
        {r('100.0 * count(*) FILTER (Q_scs_proxy IS NULL) / count(*)')} AS pct_q_null,
        {r('100.0 * count(*) FILTER (Q_scs_proxy = 0) / count(*)')} AS pct_q_zero,
        {r('min(Q_scs_proxy)')} AS q_min, {r('max(Q_scs_proxy)')} AS q_max, {r('avg(Q_scs_proxy)')} AS q_mean
      FROM proxy GROUP BY basin""", "proxy"),
)
def series_quality_stats(spark, sf_dir):
    """Written, read back and summarised from what was stored."""
    path = shared_folder(spark, "series")
    write_table(series(spark, sf_dir), path)
    return r6(diagnostics.series_stats(scan_series(spark, path), KEYS))


@query(
    "outage_window_stats", "D14 B8",
    with_ctes("""
      SELECT basin, count(*) AS n_rows,
        count(*) FILTER (n_estaciones_disponibles = 0) AS n0, count(*) FILTER (n_estaciones_disponibles = 1) AS n1,
        count(*) FILTER (n_estaciones_disponibles = 2) AS n2, count(*) FILTER (n_estaciones_disponibles = 3) AS n3,
        min(n_estaciones_disponibles) AS n_min, max(n_estaciones_disponibles) AS n_max,
        count(*) FILTER (P_basin = 0) AS rain_zero, count(*) FILTER (P_basin IS NULL) AS rain_null
      FROM proxy WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-14'
      GROUP BY basin""", "proxy"),
)
def outage_window_stats(spark, sf_dir):
    return diagnostics.window_stats(series(spark, sf_dir), "2024-01-10", "2024-01-14", KEYS)


SPLICE_SQL = {
    "old_readings": "SELECT * FROM readings WHERE ts < TIMESTAMP '2024-01-25'",
    "new_readings": "SELECT * FROM readings WHERE ts >= TIMESTAMP '2024-01-22'",
}


def _splice_sql() -> str:
    from freshet.queries.sql import _series

    extra = dict(SPLICE_SQL)
    for side in ("old", "new"):
        ctes = _series(f"{side}_", f"{side}_readings")
        for name in ("station_hours", "basin_hours", "grid", "acc", "proxy"):
            extra[f"{side}_{name}"] = ctes[f"{side}_{name}"][1]
    extra["ends"] = """
      SELECT basin, greatest(n.lo + 24, o.hi - 48) AS cut, n.lo IS NULL OR o.hi IS NULL AS one_side FROM
        (SELECT basin, min(hour_idx) AS lo FROM new_proxy GROUP BY basin) n
        FULL JOIN (SELECT basin, max(hour_idx) AS hi FROM old_proxy GROUP BY basin) o USING (basin)"""
    return with_ctes(
        f"""SELECT {PROXY_COLS} FROM old_proxy JOIN ends USING (basin) WHERE one_side OR hour_idx < cut
            UNION ALL
            SELECT {PROXY_COLS} FROM new_proxy JOIN ends USING (basin) WHERE one_side OR hour_idx >= cut""",
        "readings", **extra,
    )


@query("spliced_series", "G4 I4", _splice_sql())
def spliced_series(spark, sf_dir):
    rows = gauges.readings(spark, sf_dir)
    old = ops.runoff_series(rows.filter("ts < timestamp_ntz'2024-01-25 00:00:00'"))
    new = ops.runoff_series(rows.filter("ts >= timestamp_ntz'2024-01-22 00:00:00'"))
    return r6(dedup.splice(old, new, KEYS).select(*PROXY))


@query(
    "long_series_stats", "D14",
    with_ctes("""SELECT basin, count(*) AS n_rows, count(P_basin) AS known, count(P_acc_24h) AS accumulated,
      max(n_estaciones_disponibles) AS n_max FROM long_proxy GROUP BY basin""", "long_proxy"),
)
def long_series_stats(spark, sf_dir):
    return long_series(spark, sf_dir).groupBy("basin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("P_basin").alias("known"),
        F.count("P_acc_24h").alias("accumulated"), F.max("n_estaciones_disponibles").alias("n_max"),
    )
