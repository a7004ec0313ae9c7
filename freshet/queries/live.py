"""Streaming and live-update queries: results must equal the batch definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet import schema as S
from freshet.operators import features as feats
from freshet.operators.series import quality_split
from freshet.plans import update
from freshet.plans.update import live_update
from freshet.queries import query
from freshet.queries.base import r6, score, series
from freshet.queries.dataset import FEATURE_SQL
from freshet.queries.reporting import LOG_SQL
from freshet.queries.sql import _series, r, with_ctes
from freshet.session import shared_folder
from freshet.sources import gauges
from freshet.sources.tables import read
from freshet.streaming import arrivals, hours, ingest, parity

# An hour is closed once the watermark (latest reading - 48 h) has passed its end.
CLOSED = "hour_idx + 1 <= (SELECT epoch_us(max(ts)) - 48 * 3600000000 FROM readings) / 3600000000"


def _stream(spark, sf_dir):
    """The events table as a file stream of principal-sensor readings."""
    # A pattern, because the table may be one file or a folder of files.
    path = f"{sf_dir}/event[s].parquet"
    raw = spark.readStream.schema(gauges.events(spark, sf_dir).schema).parquet(path)
    return gauges.from_events(raw).filter(F.col("sensor_id") == gauges.PRINCIPAL_SENSOR)


def _run(spark, sf_dir) -> str:
    root = shared_folder(spark, "stream")
    hours.start(_stream(spark, sf_dir).drop("tips"), root, score).awaitTermination()
    return root


@query(
    "streamed_hour_features", "I1 I4",
    with_ctes(f"SELECT basin, timestamp, {FEATURE_SQL} FROM features WHERE {CLOSED}", "features", "readings"),
)
def streamed_hour_features(spark, sf_dir):
    rows = read(spark, f"{_run(spark, sf_dir)}/features", hours.FEATURES)
    return r6(rows.select("basin", "timestamp", *S.FEATURES))


@query(
    "streamed_prediction_log", "I2 I1",
    with_ctes(f"SELECT {LOG_SQL} FROM log WHERE {CLOSED}", "log", "readings"),
)
def streamed_prediction_log(spark, sf_dir):
    rows = read(spark, f"{_run(spark, sf_dir)}/log", hours.LOG)
    return r6(rows.select("basin", *S.LOG_COLUMNS))


@query(
    "stream_batch_parity", "C4 I5 F6",
    with_ctes(f"SELECT count(*) AS compared, CAST(0 AS BIGINT) AS mismatches FROM features WHERE {CLOSED}", "features", "readings"),
)
def stream_batch_parity(spark, sf_dir):
    """Every streamed feature row against the batch ones; nothing may differ."""
    streamed = read(spark, f"{_run(spark, sf_dir)}/features", hours.FEATURES).drop("day", "batch")
    batch = feats.feature_rows(quality_split(series(spark, sf_dir))[0])
    keys = ["basin", "hour_idx"]
    parity.require_parity(streamed, batch, keys)
    found = parity.mismatches(streamed, batch, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    checked = streamed.select(*keys).join(found, keys, "left")
    return checked.agg(
        F.count(F.lit(1)).alias("compared"), F.coalesce(F.sum("n"), F.lit(0)).alias("mismatches")
    )


@query(
    "parity_report_of_shifted_feature", "C4 F6",
    with_ctes(
        """SELECT feature, count(*) AS n FROM (
             SELECT 'lag_1h' AS feature FROM features WHERE abs(lag_1h - lag_3h) > 1e-6 OR (lag_1h IS NULL) <> (lag_3h IS NULL)
             UNION ALL SELECT 'missing' FROM features WHERE hora_dia = 5) GROUP BY feature""",
        "features"),
)
def parity_report_of_shifted_feature(spark, sf_dir):
    """A deliberately wrong copy (one lag shifted, one hour of day lost) against the right one."""
    right = feats.feature_rows(quality_split(series(spark, sf_dir))[0])
    wrong = right.withColumn("lag_1h", F.col("lag_3h"))
    lost = right.filter("hora_dia <> 5")
    keys = ["basin", "hour_idx"]
    found = parity.mismatches(right, wrong, keys).unionByName(parity.mismatches(right, lost, keys))
    return found.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("seeded_feature_sample", "F7", with_ctes("SELECT least(500, count(*)) AS n, CAST(least(500, count(*)) AS BIGINT) AS distinct_hours FROM complete", "complete"))
def seeded_feature_sample(spark, sf_dir):
    rows = feats.complete(feats.feature_rows(quality_split(series(spark, sf_dir))[0]))
    picked = parity.seeded_sample(rows)
    return picked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("basin", "hour_idx").alias("distinct_hours"))


def _readings(spark, sf_dir):
    return gauges.from_events(gauges.events(spark, sf_dir)).drop("tips").withColumn("arrival", F.lit(0).cast("long"))


@query(
    "incremental_ingest", "I3 G1",
    with_ctes(
        f"""SELECT basin, station_id, sensor_id, count(*) AS n, {r('sum(tips) * 1.5::DOUBLE')} AS mm FROM (
              SELECT DISTINCT basin, station_id, sensor_id, ts, max(tips) OVER (PARTITION BY basin, station_id, sensor_id, ts) AS tips
              FROM all_readings) GROUP BY ALL""", "all_readings"),
)
def incremental_ingest(spark, sf_dir):
    """Two landings with an overlap of three days, two runs of one checkpointed stream."""
    root = shared_folder(spark, "ingest")
    rows = _readings(spark, sf_dir).drop("arrival")
    landings = ["ts < timestamp_ntz'2024-01-20 00:00:00'", "ts >= timestamp_ntz'2024-01-17 00:00:00'"]
    for part in landings:
        rows.filter(part).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landing")
        ingest.start_ingest(stream, f"{root}/readings", f"{root}/checkpoint").awaitTermination()
    stored = read(spark, f"{root}/readings", S.READINGS_TABLE)
    return r6(stored.groupBy("basin", "station_id", "sensor_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mm").alias("mm")
    ))


def _updated(spark, sf_dir):
    """History up to 25 January, then a batch from the 22nd on."""
    root = shared_folder(spark, "live")
    rows = _readings(spark, sf_dir).filter(F.col("sensor_id") == gauges.PRINCIPAL_SENSOR)
    live_update(spark, rows.filter("ts < timestamp_ntz'2024-01-25 00:00:00'"), root, score, "2024-01-25 00:00:00")
    batch = rows.filter("ts >= timestamp_ntz'2024-01-22 00:00:00'")
    return root, live_update(spark, batch, root, score, "2024-02-01 00:00:00")


@query("live_update_log", "I6 I4 G4 B10", with_ctes(f"SELECT {LOG_SQL} FROM log", "log"))
def live_update_log(spark, sf_dir):
    root, _ = _updated(spark, sf_dir)
    return r6(read(spark, f"{root}/log", S.LOG_TABLE).select("basin", *S.LOG_COLUMNS))


def _dataset_sql() -> str:
    ctes = _series("old_", "old_readings")
    parts = {"old_readings": "SELECT * FROM readings WHERE ts < TIMESTAMP '2024-01-25'"}
    parts |= {n: ctes[f"old_{n[4:]}"][1] for n in (
        "old_station_hours", "old_basin_hours", "old_grid", "old_acc", "old_proxy", "old_quality",
        "old_features", "old_complete", "old_ds6")}
    parts["cuts"] = "SELECT basin, min(hour_idx) AS cut FROM old_ds6 WHERE split = 'test' GROUP BY basin"
    return with_ctes(
        f"""SELECT basin, timestamp, {FEATURE_SQL}, {r('target_6h')} AS target_6h,
              CASE WHEN cut IS NULL THEN split WHEN hour_idx >= cut THEN 'test' ELSE 'train' END AS split
            FROM ds6 LEFT JOIN cuts USING (basin)""", "ds6", **parts)


@query("live_update_dataset", "I6 E10 E7", _dataset_sql())
def live_update_dataset(spark, sf_dir):
    """The training rows after the second update keep the first build's cut."""
    root, _ = _updated(spark, sf_dir)
    rows = read(spark, f"{root}/dataset_6h", S.dataset_table(6))
    return r6(rows.select("basin", "timestamp", *S.FEATURES, "target_6h", "split"))


@query(
    "live_update_summary", "I6 D38 A11",
    with_ctes(
        """SELECT basin, station_id, count(DISTINCT ts) FILTER (ts >= TIMESTAMP '2024-01-25') AS new_rows,
             strftime(max(ts), '%Y-%m-%d %H:%M') AS last_reading FROM readings GROUP BY ALL""", "readings"),
)
def live_update_summary(spark, sf_dir):
    return _updated(spark, sf_dir)[1]


@query("arriving_prediction_log", "I1 I2 I4 I5", with_ctes(f"SELECT {LOG_SQL} FROM log", "log"))
def arriving_prediction_log(spark, sf_dir):
    """Two landings; half a day of the 19th arrives with the second, after later hours were scored without it."""
    root = shared_folder(spark, "arrivals")
    rows = _readings(spark, sf_dir).filter(F.col("sensor_id") == gauges.PRINCIPAL_SENSOR).drop("arrival")
    late = "ts >= timestamp_ntz'2024-01-19 03:00:00' AND ts < timestamp_ntz'2024-01-19 15:00:00'"
    first = f"ts < timestamp_ntz'2024-01-20 00:00:00' AND NOT ({late})"
    for part in (first, f"NOT ({first})"):
        rows.filter(part).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landing")
        arrivals.start_updates(stream, root, score).awaitTermination()
    return r6(read(spark, f"{root}/log", S.LOG_TABLE).select("basin", *S.LOG_COLUMNS))


@query(
    "late_readings", "I4 I1",
    with_ctes(
        """SELECT basin, station_id, sensor_id, ts, tips * 1.5::DOUBLE AS mm FROM readings
           WHERE ts >= TIMESTAMP '2024-01-15 03:00:00' AND ts < TIMESTAMP '2024-01-15 15:00:00'
             AND epoch_us(ts) <= (SELECT epoch_ms(max(ts)) * 1000 FROM readings WHERE ts < TIMESTAMP '2024-01-20') - 48 * 3600000000""",
        "readings"),
)
def late_readings(spark, sf_dir):
    """Half of the 15th lands with the readings from the 20th on: too late for the closed hours, stored and counted."""
    root = shared_folder(spark, "late")
    rows = _readings(spark, sf_dir).filter(F.col("sensor_id") == gauges.PRINCIPAL_SENSOR).drop("arrival")
    late = "ts >= timestamp_ntz'2024-01-15 03:00:00' AND ts < timestamp_ntz'2024-01-15 15:00:00'"
    first = f"ts < timestamp_ntz'2024-01-20 00:00:00' AND NOT ({late})"
    for part in (first, f"NOT ({first})"):
        rows.filter(part).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landing")
        hours.start(stream, f"{root}/out", score).awaitTermination()
    return hours.late_readings(spark, f"{root}/out").select("basin", "station_id", "sensor_id", "ts", "mm")


def _whole_build(spark, sf_dir, batches, rebuild: bool = False):
    """Updates with (filter, now) batches of the principal readings; the log of the published version."""
    root = shared_folder(spark, "live")
    rows = _readings(spark, sf_dir).filter(F.col("sensor_id") == gauges.PRINCIPAL_SENSOR)
    for part, now in batches:
        live_update(spark, rows.filter(part), root, score, now, horizons=(6,))
    if rebuild:
        update.rebuild(spark, root, score, horizons=(6,))
    return r6(read(spark, f"{root}/log", S.LOG_TABLE).select("basin", *S.LOG_COLUMNS))


@query("live_update_late_reading", "I6 I4", with_ctes(f"SELECT {LOG_SQL} FROM log", "log"))
def live_update_late_reading(spark, sf_dir):
    """Half a day of the 10th comes two weeks late: it is stored at once and takes effect by a rebuild."""
    late = "ts >= timestamp_ntz'2024-01-10 03:00:00' AND ts < timestamp_ntz'2024-01-10 15:00:00'"
    first = f"ts < timestamp_ntz'2024-01-25 00:00:00' AND NOT ({late})"
    return _whole_build(spark, sf_dir, [(first, "2024-01-25 00:00:00"), (f"NOT ({first})", "2024-02-01 00:00:00")], rebuild=True)


@query("live_update_early_reading", "I6", with_ctes(f"SELECT {LOG_SQL} FROM log", "log"))
def live_update_early_reading(spark, sf_dir):
    """Everything is offered on the 25th; what is stamped later is kept and taken by the update that finds it due."""
    return _whole_build(spark, sf_dir, [("true", "2024-01-25 00:00:00"), ("false", "2024-02-01 00:00:00")])
