"""Streaming hourly series: readings -> closed hours -> features -> scored log.

Row windows do not exist on streams, so the stream only closes hours (a watermarked
tumbling sum); each micro-batch then runs the batch feature function on the closed hours
plus the bounded history they can see. Batch and stream thus share one definition.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet import schema as S
from freshet.functions import hydrology
from freshet.functions.timegrid import day_date, day_index, hour_index
from freshet.operators.features import CHUNK_HOURS, complete, feature_rows
from freshet.operators.series import basin_hours, quality_split, with_runoff
from freshet.plans.reporting import prediction_log
from freshet.sources.tables import exists, read, read_or_none, write_table
from freshet.streaming.parity import require_parity

LATENESS = "48 hours"
KEYS = ["basin"]
READING_KEY = ["basin", "station_id", "sensor_id", "ts"]
FEATURES = f"{S.FEATURES_TABLE}, batch int"
LOG = f"{S.LOG_TABLE}, batch int"
LATE = "basin string, station_id string, sensor_id string, ts timestamp_ntz, mm double, day date, batch int"
SEEN = "ts timestamp_ntz, batch int"
HOURS = (
    "basin string, hour_idx bigint, P_basin double, n_estaciones_disponibles int, day date, batch int"
)


def event_time(readings: DataFrame) -> DataFrame:
    """Watermarks need an instant type; wall-clock times are taken in the session zone."""
    return readings.withColumn("ts", F.col("ts").cast("timestamp"))


def closed_station_hours(
    readings: DataFrame, lateness: str = LATENESS, arrival: str | None = None
) -> DataFrame:
    """Hourly station sums, emitted once an hour can no longer change.

    Identical readings count once. With an ``arrival`` column, a re-published reading
    replaces the earlier one instead (last arrival per station, sensor and time).
    """
    rows = event_time(readings).withWatermark("ts", lateness)
    if arrival is None:
        # Grouping on the whole row, unlike dropDuplicates, collapses copies before the shuffle.
        rows = rows.groupBy(*readings.columns).agg(F.count(F.lit(1)).alias("_copies"))
    else:
        last = F.max(F.struct(arrival, "mm")).alias("_last")
        rows = rows.groupBy(*READING_KEY).agg(last).withColumn("mm", F.col("_last.mm"))
    hours = rows.groupBy("basin", "station_id", F.window("ts", "1 hour").alias("_w")).agg(
        F.sum("mm").alias("mm")
    )
    start = F.col("_w.start").cast("timestamp_ntz")
    return hours.select("basin", "station_id", hour_index(start).alias("hour_idx"), "mm")


def _store(df: DataFrame, path: str, batch_id: int, salt_on: list[str] | None = None) -> None:
    """Write a batch under (day, batch): a replayed batch replaces exactly its own files."""
    tagged = df.withColumns({"day": day_date(day_index(F.col("hour_idx"))), "batch": F.lit(batch_id)})
    write_table(tagged, path, ["day", "batch"], salt_on=salt_on)


def recent(spark: SparkSession, path: str, since: int, until: int) -> DataFrame:
    """Stored hours from ``since`` to ``until``; only the days in between are listed and opened."""
    names = [f"{path}/day={date(1970, 1, 1) + timedelta(days=d)}" for d in range(since // 24, until // 24 + 1)]
    found = [n for n in names if exists(spark, n)]
    hours = spark.read.schema(HOURS).option("basePath", path).parquet(*found)
    return hours.filter(F.col("hour_idx").between(since, until))


def note_late(batch: DataFrame, number: int, root: str, lateness: str, session: SparkSession) -> None:
    """Store the readings that the closed-hour stream does not take any more, in the table ``late``.

    These are the rows at or before the watermark: the last reading of the micro-batches before this one, to the millisecond, less
    ``lateness``. Both streams read the same source in the same micro-batches. A replayed batch replaces its own rows.
    """
    ts = F.col("ts").cast("timestamp_ntz")
    rows = batch.select("basin", "station_id", "sensor_id", ts.alias("ts"), "mm")
    earlier = read_or_none(session, f"{root}/seen", SEEN)
    last = None if earlier is None else earlier.filter(F.col("batch") < number).agg(F.max("ts")).first()[0]
    if last is not None:
        mark = F.date_trunc("MILLISECOND", F.lit(last).cast("timestamp_ntz")).cast("timestamp_ntz") - F.expr(f"INTERVAL {lateness}")
        late = rows.filter(ts <= mark).withColumns({"day": ts.cast("date"), "batch": F.lit(number)})
        write_table(late, f"{root}/late", ["day", "batch"], salt_on=KEYS)
    write_table(rows.agg(F.max("ts").alias("ts")).withColumn("batch", F.lit(number)), f"{root}/seen", ["batch"])


def late_readings(spark: SparkSession, root: str) -> DataFrame:
    """Readings that came after their hours were closed; ``plans.update.live_update`` can take them."""
    found = read_or_none(spark, f"{root}/late", LATE)
    return spark.createDataFrame([], LATE) if found is None else found


def process_batch(
    closed: DataFrame,
    batch_id: int,
    root: str,
    score: Callable[[DataFrame], DataFrame],
    cn: float | DataFrame = hydrology.DEFAULT_CN,
    spark: SparkSession | None = None,
) -> None:
    """Store the closed hours, then compute and store features and log rows for them.

    All hours of a micro-batch close at the same watermark, so they are complete
    across stations and later than any hour stored before. Features are computed once more in halo chunks, and nothing is stored
    after a disagreement. The stream's own session has adaptive execution off; what follows the first write runs in ``spark``.
    """
    spark = spark or closed.sparkSession
    _store(basin_hours(closed), f"{root}/hours", batch_id, salt_on=KEYS)
    stored = read(spark, f"{root}/hours", HOURS).filter(F.col("batch") == batch_id)
    first, last = stored.agg(F.min("hour_idx"), F.max("hour_idx")).first()
    if first is None:
        return
    visible = recent(spark, f"{root}/hours", first - S.HISTORY_HOURS, last)
    series = with_runoff(visible.select(*KEYS, "hour_idx", "P_basin", "n_estaciones_disponibles"), cn)
    quality = quality_split(series)[0]
    rows = feature_rows(quality).filter(F.col("hour_idx") >= first)
    require_parity(rows, feature_rows(quality, chunk_len=CHUNK_HOURS), [*KEYS, "hour_idx"])
    _store(rows, f"{root}/features", batch_id)
    features = read(spark, f"{root}/features", FEATURES)
    ready = complete(features.filter(F.col("batch") == batch_id).drop("day", "batch"))
    log = prediction_log(score(ready), [*KEYS, "hour_idx"])
    _store(log, f"{root}/log", batch_id)


def start(
    readings: DataFrame,
    root: str,
    score: Callable[[DataFrame], DataFrame],
    lateness: str = LATENESS,
    arrival: str | None = None,
    cn: float | DataFrame = hydrology.DEFAULT_CN,
) -> StreamingQuery:
    """Run over everything available, then stop; the checkpoint under ``root`` resumes it.

    What comes too late for it is stored first (``late_readings``).
    """
    closed = closed_station_hours(readings, lateness, arrival)
    session = readings.sparkSession
    readings.writeStream.option("checkpointLocation", f"{root}/_late").trigger(availableNow=True).foreachBatch(
        lambda df, i: note_late(df, i, root, lateness, session)).start().awaitTermination()
    return (
        closed.writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, i: process_batch(df, i, root, score, cn, session))
        .start()
    )
