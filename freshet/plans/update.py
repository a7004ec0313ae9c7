"""Live update: ingest -> recompute the recent slice -> splice -> score -> publish.

Only the recent slice is recomputed and only the days from the cut on are rewritten.
Everything is staged and checked first, and becomes readable in one step (``sources.published``): readers see the
tables of one update or of the one before, wherever a run fails.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.functions import hydrology
from freshet.functions.timegrid import day_date, day_index, hour_index, hour_start, local_now
from freshet.operators.dedup import splice
from freshet.operators.features import (
    CHUNK_HOURS, chronological_split, complete, existing_cut, feature_rows,
)
from freshet.operators.series import quality_split, runoff_series
from freshet.plans.reporting import prediction_log
from freshet.session import shared_folder
from freshet.sources.landing import high_water_marks
from freshet.sources import published
from freshet.sources.tables import publish_snapshot, read, read_or_none, refresh_snapshot, write_table
from freshet.streaming.ingest import merge_readings
from freshet.streaming.parity import require_parity

KEYS = ["basin"]
# Small state tables beside the large ones: the last reading of each station, the last hour of each basin, the split cuts.
MARKS = "basin string, station_id string, ts timestamp_ntz"
ENDS = "basin string, hour_idx bigint"
CUTS = "basin string, horizon int, cut_idx bigint"
# The slice reaches back over the splice overlap, a feature's look-back and its runoff's.
SLICE_HOURS = 48 + S.LOOK_BACK_HOURS + S.ACCUMULATION_HOURS


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", day_date(day_index(F.col("hour_idx"))))


def _from_hour(df: DataFrame, hour: int) -> DataFrame:
    since = day_date(day_index(F.lit(hour)))
    return df.filter((F.col("day") >= since) & (F.col("hour_idx") >= hour)).drop("day")


def _left_behind(spark: SparkSession, root: str) -> int | None:
    """The first hour that a failed run left to be recomputed."""
    left = read_or_none(spark, f"{root}/pending", "hour_idx bigint")
    return None if left is None else left.agg(F.min("hour_idx")).first()[0]


def _state(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame | None:
    """A state table; None where it is missing or a failed run may have left it behind its source."""
    return None if _left_behind(spark, root) is not None else read_or_none(spark, f"{root}/{name}", schema)


def last_readings(spark: SparkSession, root: str) -> DataFrame | None:
    """basin, station_id, ts of each station's last stored reading; the whole table is read without a valid state only."""
    stored = read_or_none(spark, f"{root}/readings", S.READINGS_TABLE)
    if stored is None:
        return None
    state = _state(spark, root, "marks", MARKS)
    return stored.groupBy("basin", "station_id").agg(F.max("ts").alias("ts")) if state is None else state


def last_hours(spark: SparkSession, root: str) -> DataFrame | None:
    """basin, hour_idx of the last published hour of each basin; published with the series, so never behind it."""
    return published.read(spark, root, "ends", ENDS)


# Readings that cannot be stored, and readings that are not due yet.
REJECTED = "basin string, station_id string, sensor_id string, ts timestamp_ntz, arrival bigint, mm double, reason string, run bigint"
DEFERRED = "basin string, station_id string, sensor_id string, ts timestamp_ntz, arrival bigint, mm double"
COUNTS = "now timestamp_ntz, offered bigint, due bigint, recomputed bigint, waiting bigint, deferred bigint, rejected bigint, run bigint"
FIRST_TIME, AHEAD_DAYS = "1990-01-01 00:00:00", 366


def sorted_out(batch: DataFrame, until: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Due readings, readings of the coming ``AHEAD_DAYS`` (to be offered again when they are due), and rejected ones with a reason.

    A time before ``FIRST_TIME`` or farther ahead is a clock at fault; filling the hours up to it would make one series of millions.
    """
    ts = F.col("ts")
    far = (ts < F.lit(FIRST_TIME).cast("timestamp_ntz")) | (ts > until + F.make_dt_interval(F.lit(AHEAD_DAYS)))
    no_key = F.col("basin").isNull() | F.col("station_id").isNull() | F.col("sensor_id").isNull() | ts.isNull()
    reason = F.when(no_key, "no key").when(far, "implausible time")
    rows = batch.select("basin", "station_id", "sensor_id", "ts", F.col("arrival").cast("long").alias("arrival"), "mm", reason.alias("reason"))
    good = rows.filter("reason IS NULL").drop("reason")
    return good.filter(ts <= until), good.filter(ts > until), rows.filter("reason IS NOT NULL")


def new_readings(spark: SparkSession, due: DataFrame, root: str, late_hours: int = 0) -> DataFrame:
    """Due readings with ``in_slice``: those that are recomputed at once. All are stored.

    These are the rows from each station's high-water mark, less ``late_hours``, on. Older ones wait for a rebuild.
    """
    stored = last_readings(spark, root)
    if stored is None:
        return due.withColumn("in_slice", F.lit(True))
    ends = last_hours(spark, root)
    ends = spark.createDataFrame([], ENDS) if ends is None else ends
    stations = due.select("basin", "station_id").distinct()
    marks = high_water_marks(stations, stored, ends, default="1970-01-01 00:00:00")
    start = F.col("since") - F.make_dt_interval(F.lit(0), F.lit(late_hours))
    return due.join(marks, ["basin", "station_id"]).withColumn("in_slice", F.col("ts") >= start).drop("since")


def _first_hour(spark: SparkSession, due: DataFrame, root: str, ends: DataFrame | None) -> int | None:
    """The hour from which the series is to be rebuilt: the oldest of

    the readings to recompute, the hours a failed run left behind, and the hour after the last stored one
    of each basin with new readings (so that a silence is filled as in a full build).
    """
    fresh = due.filter("in_slice")
    hours = [fresh.agg(F.min(hour_index(F.col("ts")))).first()[0]]
    hours.append(_left_behind(spark, root))
    if ends is not None:
        touched = fresh.select("basin").distinct()
        last = ends.join(touched, "basin", "left_semi").agg(F.min("hour_idx")).first()[0]
        hours.append(None if last is None else last + 1)
    known = [h for h in hours if h is not None]
    return min(known) if known else None


def _pending(spark: SparkSession, root: str, hour: int | None) -> None:
    """Note the first hour that stored readings are ahead of the published tables; None when they agree."""
    write_table(spark.createDataFrame([(hour,)], "hour_idx bigint"), f"{root}/pending")


def _merged_marks(spark: SparkSession, merged: DataFrame, root: str, stage: str) -> DataFrame:
    """The stations' last readings once ``merged`` is stored."""
    marks = merged.select("basin", "station_id", "ts")
    before = last_readings(spark, root)
    marks = marks if before is None else marks.unionByName(before)
    write_table(marks.groupBy("basin", "station_id").agg(F.max("ts").alias("ts")), f"{stage}/marks")
    return read(spark, f"{stage}/marks", MARKS)


def update_summary(merged: DataFrame, marks: DataFrame) -> DataFrame:
    news = merged.groupBy("basin", "station_id").agg(F.count_if("is_new").alias("new_rows"))
    return marks.join(news, ["basin", "station_id"], "left").select(
        "basin", "station_id", F.coalesce("new_rows", F.lit(0)).alias("new_rows"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("last_reading"),
    )


def live_update(
    spark: SparkSession,
    batch: DataFrame,
    root: str,
    score: Callable[[DataFrame], DataFrame],
    now: str | None = None,
    late_hours: int = 48,
    cn: float | DataFrame = hydrology.DEFAULT_CN,
    horizons: tuple[int, ...] = S.HORIZONS,
    snapshot: str | None = None,
) -> DataFrame:
    """Apply a batch of readings (basin, station_id, sensor_id, ts, mm, arrival).

    ``now`` defaults to the gauges' local time. Every reading is stored; those more than ``late_hours`` before the
    high-water mark change the series at the next ``rebuild`` only. Readings stamped after ``now`` are kept and offered again by later updates;
    readings without a key or with an implausible time go to the table ``rejected``. ``update_counts`` has the numbers of each run.
    A run that failed after storing readings is made up for by the next one. Series, features' datasets, log and last hours are
    published in one step. The datasets keep their earlier split cut; a horizon other than the first that fails only warns. ``cn`` may be
    a table (basin, cn). ``snapshot`` names a serving table whose touched days are refreshed.
    Returns new rows and last reading of every station, those without news included.
    """
    stage = shared_folder(spark, "update")
    until = F.lit(now).cast("timestamp_ntz") if now else local_now()
    run = len(_runs(spark, root)) + 1
    before = read_or_none(spark, f"{root}/deferred", DEFERRED)
    offered = batch.select("basin", "station_id", "sensor_id", "ts", F.col("arrival").cast("long").alias("arrival"), "mm")
    offered = offered if before is None else offered.unionByName(before)
    due, ahead, bad = sorted_out(offered, until)
    write_table(ahead.distinct(), f"{stage}/deferred")
    write_table(bad.withColumn("run", F.lit(run).cast("long")), f"{stage}/rejected")
    write_table(new_readings(spark, due, root, late_hours), f"{stage}/due")
    due = spark.read.parquet(f"{stage}/due")
    write_table(merge_readings(due, f"{root}/readings"), f"{stage}/merged")
    merged = read(spark, f"{stage}/merged", f"{S.READINGS_TABLE}, is_new boolean, touched boolean")
    marks = _merged_marks(spark, merged, root, stage)
    summary = update_summary(merged, marks)
    ends = last_hours(spark, root)
    first_ts = _first_hour(spark, due, root, ends)
    _note_run(spark, root, stage, run, until, offered, due)
    if first_ts is None and merged.isEmpty():
        return summary
    # Noted before the readings move ahead of the series, taken back after publication.
    _pending(spark, root, first_ts)
    write_table(merged.drop("is_new", "touched"), f"{root}/readings", ["day"])
    write_table(marks, f"{root}/marks")
    if first_ts is None:
        return summary

    since = first_ts - SLICE_HOURS
    readings = read(spark, f"{root}/readings", S.READINGS_TABLE).filter(
        (F.col("day") >= day_date(day_index(F.lit(since)))) & (F.col("ts") >= hour_start(F.lit(since)))
    )
    # Stored readings are unique by key.
    fresh = runoff_series(readings.select("basin", "station_id", "sensor_id", "ts", "mm"), cn, unique=True)
    write_table(_by_day(fresh), f"{stage}/slice")
    part = read(spark, f"{stage}/slice", S.SERIES_TABLE).drop("day")

    stored = published.read(spark, root, "series", S.SERIES_TABLE, _day(since))
    joined = part if stored is None else splice(_from_hour(stored, since), part, KEYS)
    write_table(_by_day(joined), f"{stage}/series")
    new_ends = joined.select("basin", "hour_idx")
    new_ends = new_ends if ends is None else new_ends.unionByName(ends)
    write_table(new_ends.groupBy("basin").agg(F.max("hour_idx").alias("hour_idx")), f"{stage}/ends")

    warm = since + S.HISTORY_HOURS if stored is not None else since
    # New hours of a basin, those after its own last stored one, see nothing older than the splice: both computations must agree there.
    again = feature_rows(quality_split(part)[0], chunk_len=CHUNK_HOURS)
    names = _stage_outputs(spark, root, stage, score, horizons, warm, lambda staged: _gate(staged, again, ends, since))
    _publish(spark, root, stage, names, {"series": since} | dict.fromkeys(names, warm))
    _pending(spark, root, None)
    if snapshot:
        log = published.read(spark, root, "log", S.LOG_TABLE, _day(warm))
        refresh_snapshot(spark, log.drop("day"), snapshot)
    return summary


def rebuild(
    spark: SparkSession,
    root: str,
    score: Callable[[DataFrame], DataFrame],
    cn: float | DataFrame = hydrology.DEFAULT_CN,
    horizons: tuple[int, ...] = S.HORIZONS,
    snapshot: str | None = None,
) -> None:
    """Build everything again from all stored readings, and publish it as one version.

    Readings that waited because they came late take effect; the datasets keep their split cuts.
    """
    stage = shared_folder(spark, "rebuild")
    readings = read(spark, f"{root}/readings", S.READINGS_TABLE)
    built = runoff_series(readings.select("basin", "station_id", "sensor_id", "ts", "mm"), cn, unique=True, chunk_len=CHUNK_HOURS)
    write_table(_by_day(built), f"{stage}/series")
    series = read(spark, f"{stage}/series", S.SERIES_TABLE).drop("day")
    write_table(series.groupBy("basin").agg(F.max("hour_idx").alias("hour_idx")), f"{stage}/ends")
    again = feature_rows(quality_split(series)[0], chunk_len=CHUNK_HOURS)
    names = _stage_outputs(spark, root, stage, score, horizons, None, lambda staged: require_parity(staged, again, [*KEYS, "hour_idx"]))
    _publish(spark, root, stage, names, {}, whole=True)
    _pending(spark, root, None)
    if snapshot:
        publish_snapshot(read(spark, f"{root}/log", S.LOG_TABLE).drop("day"), snapshot)


def _day(hour: int) -> date:
    return date(1970, 1, 1) + timedelta(days=hour // 24)


def _runs(spark: SparkSession, root: str) -> list:
    counts = read_or_none(spark, f"{root}/update_counts", COUNTS)
    return [] if counts is None else counts.select("run").distinct().collect()  # one row a run


def _note_run(spark: SparkSession, root: str, stage: str, run: int, until: Column, offered: DataFrame, due: DataFrame) -> None:
    """The numbers of a run, the rejected readings (both by run) and the readings that are offered again."""
    rejected, deferred = (spark.read.parquet(f"{stage}/{n}") for n in ("rejected", "deferred"))
    one = due.agg(F.count(F.lit(1)).alias("due"), F.count_if("in_slice").alias("recomputed"), F.count_if(~F.col("in_slice")).alias("waiting"))
    numbers = {"deferred": deferred.count(), "rejected": rejected.count(), "offered": offered.count(), "run": run}
    row = one.withColumns({n: F.lit(v).cast("long") for n, v in numbers.items()} | {"now": until})
    names = [c.split()[0] for c in COUNTS.split(", ")]
    write_table(row.select(*names), f"{root}/update_counts", ["run"])
    write_table(rejected, f"{root}/rejected", ["run"])
    write_table(deferred, f"{root}/deferred")


def _gate(staged: DataFrame, again: DataFrame, ends: DataFrame | None, since: int) -> None:
    keys = [*KEYS, "hour_idx"]
    if ends is not None:
        last = ends.select("basin", F.col("hour_idx").alias("_end"))
        unseen = F.col("hour_idx") > F.coalesce("_end", F.lit(since - 1))
        staged, again = (df.join(last, "basin", "left").filter(unseen).drop("_end") for df in (staged, again))
    require_parity(staged, again, keys)


def _stage_outputs(
    spark: SparkSession, root: str, stage: str, score: Callable[[DataFrame], DataFrame], horizons: tuple[int, ...],
    warm: int | None, check: Callable[[DataFrame], None],
) -> dict[str, str]:
    """Features, log and datasets of the staged series; returns the tables to publish beside the series, with their schemas."""
    series = read(spark, f"{stage}/series", S.SERIES_TABLE).drop("day")
    write_table(_by_day(feature_rows(quality_split(series)[0], horizons)), f"{stage}/features")
    targets = "".join(f", target_{h}h double" for h in horizons)
    staged = read(spark, f"{stage}/features", S.FEATURES_TABLE + targets).drop("day")
    check(staged)
    ready = staged if warm is None else staged.filter(F.col("hour_idx") >= warm)
    write_table(_by_day(prediction_log(score(complete(ready)), [*KEYS, "hour_idx"])), f"{stage}/log")
    names = {"log": S.LOG_TABLE}
    known = published.read(spark, root, "cuts", CUTS)
    known = spark.createDataFrame([], CUTS) if known is None else known
    cuts = known
    for h in horizons:
        name = f"dataset_{h}h"
        try:
            mine = known.filter(F.col("horizon") == h).select("basin", "cut_idx")
            rows = chronological_split(complete(ready, f"target_{h}h"), KEYS, previous_cut=mine)
            write_table(_by_day(rows.drop(*[f"target_{o}h" for o in horizons if o != h])), f"{stage}/{name}")
        except Exception as e:  # the first horizon is the one that warnings use
            if h == horizons[0]:
                raise
            warnings.warn(f"{name} is left as it was: {e}", stacklevel=2)
            continue
        names[name] = S.dataset_table(h)
        found = existing_cut(read(spark, f"{stage}/{name}", S.dataset_table(h)), KEYS).join(mine, "basin", "left_anti")
        cuts = cuts.unionByName(found.select("basin", F.lit(h).alias("horizon"), "cut_idx"))
    write_table(cuts, f"{stage}/cuts")
    return names


def _publish(
    spark: SparkSession, root: str, stage: str, names: dict[str, str], since: dict[str, int], whole: bool = False
) -> None:
    """Replace the hours from each table's ``since`` on, all tables in one step; the first day keeps its earlier hours."""
    version = published.latest(spark, root) + 1
    changed = {}
    for name, schema in {"series": S.SERIES_TABLE, **names}.items():
        new = read(spark, f"{stage}/{name}", schema)
        stored = None if whole else published.read(spark, root, name, schema, _day(since[name]))
        if stored is not None:
            kept = stored.filter((F.col("day") == F.lit(_day(since[name]))) & (F.col("hour_idx") < since[name]))
            new = new.unionByName(kept)
        published.stage(new, root, name, version)
        changed[name] = new
    for name, schema in {"ends": ENDS, "cuts": CUTS}.items():
        changed[name] = read(spark, f"{stage}/{name}", schema)
        published.stage(changed[name], root, name, version)
    published.publish(spark, root, version, changed, whole)
