"""Event-window queries. Known events come from large purchases in ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.plans import events as ev
from freshet.queries import query
from freshet.queries.base import KEYS, r6, series
from freshet.queries.sql import r, with_ctes
from freshet.sources import gauges

# Every 150 or more is an "event"; user 0's are moved a year ahead, outside any series.
EVENTS_SQL = """SELECT 'B' || CAST(user_id // 75 AS VARCHAR) AS basin, event_id,
  CASE WHEN user_id % 40 = 0 THEN ts + INTERVAL 366 DAY ELSE ts END AS event_ts
  FROM events WHERE event_type = 'purchase' AND value >= 150"""
NEAR = """SELECT e.basin, e.event_id, e.event_ts, p.hour_idx, p.timestamp, p.P_basin, p.P_acc_24h, p.Q_scs_proxy
  FROM known e JOIN proxy p ON p.basin = e.basin
    AND p.timestamp BETWEEN e.event_ts - INTERVAL 48 HOUR AND e.event_ts + INTERVAL 48 HOUR"""
BEST = "SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(timestamp) - epoch_us(event_ts)), hour_idx) = 1"


def known_events(spark, sf_dir):
    e = gauges.events(spark, sf_dir).filter("event_type = 'purchase' AND value >= 150")
    ts = F.col("ts").cast("timestamp_ntz")
    later = ts + F.make_dt_interval(F.lit(366))
    return e.select(
        F.concat(F.lit("B"), F.floor(F.col("user_id") / gauges.USERS_PER_BASIN).cast("string")).alias("basin"),
        "event_id", F.when(F.col("user_id") % 40 == 0, later).otherwise(ts).alias("event_ts"),
    )


@query(
    "event_windows", "C5",
    with_ctes(
        f"SELECT basin, event_id, timestamp, {r('P_basin')} AS P_basin, {r('Q_scs_proxy')} AS Q_scs_proxy FROM win",
        "proxy", known=EVENTS_SQL, win=NEAR),
)
def event_windows(spark, sf_dir):
    win = ev.windows(series(spark, sf_dir), known_events(spark, sf_dir), KEYS)
    return r6(win.select("basin", "event_id", "timestamp", "P_basin", "Q_scs_proxy"))


@query(
    "event_nearest_hours", "C6",
    with_ctes(
        f"SELECT basin, event_id, timestamp, {r('P_basin')} AS P_basin, {r('P_acc_24h')} AS P_acc_24h FROM best",
        "proxy", known=EVENTS_SQL, win=NEAR, best=BEST),
)
def event_nearest_hours(spark, sf_dir):
    win = ev.windows(series(spark, sf_dir), known_events(spark, sf_dir), KEYS)
    near = ev.nearest(win, KEYS, ["timestamp", "P_basin", "P_acc_24h"])
    return r6(near.drop("hour_idx"))


@query(
    "event_verdicts", "D10 D11 D12",
    with_ctes(
        f"""SELECT e.basin, e.event_id, e.event_ts, b.timestamp, {r('b.Q_scs_proxy')} AS Q_scs_proxy,
              {r('''100.0 * (SELECT count(*) FROM proxy s WHERE s.basin = b.basin AND s.Q_scs_proxy <= b.Q_scs_proxy)
                    / (SELECT count(s.Q_scs_proxy) FROM proxy s WHERE s.basin = b.basin AND b.Q_scs_proxy IS NOT NULL)''')} AS percentile,
              {r('t.p95')} AS top_threshold,
              CASE WHEN b.timestamp IS NOT NULL THEN b.Q_scs_proxy IS NULL OR b.Q_scs_proxy < t.p95 END AS red_flag
            FROM known e LEFT JOIN best b USING (event_id)
            LEFT JOIN (SELECT basin, quantile_cont(Q_scs_proxy, 0.95) AS p95 FROM proxy GROUP BY basin) t ON t.basin = b.basin""",
        "proxy", known=EVENTS_SQL, win=NEAR, best=BEST),
)
def event_verdicts(spark, sf_dir):
    out = ev.verdicts(series(spark, sf_dir), known_events(spark, sf_dir), KEYS)
    return r6(out.select(
        "basin", "event_id", "event_ts", "timestamp", "Q_scs_proxy", "percentile", "top_threshold", "red_flag"
    ))
