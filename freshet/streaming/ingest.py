"""Incremental ingest: new landing files into the readings table, without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet import schema as S
from freshet.sources.tables import on_days_of, read_or_none, write_table

KEY = ["basin", "station_id", "sensor_id", "ts"]


def merge_readings(batch: DataFrame, path: str) -> DataFrame:
    """Upsert a batch (``KEY``, mm, arrival) by reading key; only the days it touches are rewritten.

    Returns the affected days' readings with ``is_new`` (key not stored before) and
    ``touched`` (value from this batch). The batch wins over stored rows; inside it the
    largest ``arrival`` wins.
    """
    spark = batch.sparkSession
    new = batch.select(
        *KEY, F.col("arrival").cast("long").alias("arrival"), "mm",
        F.col("ts").cast("date").alias("day"), F.lit(1).alias("_origin"),
    )
    stored = read_or_none(spark, path, S.READINGS_TABLE)
    parts = new
    if stored is not None:
        old = on_days_of(stored, new).withColumn("_origin", F.lit(0))
        parts = old.unionByName(new)
    payload = F.struct("_origin", "arrival", "mm", "day")
    merged = parts.groupBy(*KEY).agg(F.max(payload).alias("_last"), F.min("_origin").alias("_first"))
    return merged.select(
        *KEY, "_last.arrival", "_last.mm", "_last.day",
        (F.col("_first") == 1).alias("is_new"), (F.col("_last._origin") == 1).alias("touched"),
    )


def upsert(batch: DataFrame, path: str) -> None:
    merged = merge_readings(batch, path).drop("is_new", "touched")
    write_table(merged, path, ["day"], salt_on=KEY)


def start_ingest(readings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert everything that landed since the checkpoint, then stop."""
    return (
        readings.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, i: upsert(df.withColumn("arrival", F.lit(i).cast("long")), path))
        .start()
    )
