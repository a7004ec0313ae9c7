"""Channel-node readings (level, turbidity, tips, sequence number) derived from the sample ``events``.

A basin has three nodes along its channel, N0 upstream. A flood wave passes every 60 hours, one hour later at each node
downstream; turbidity runs ahead of it. Packets also carry echoes (single high readings), readings below the bed, a node
that freezes on some days, and a sequence number that counts five-minute slots and wraps at 256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.timegrid import hour_index
from freshet.sources import gauges

NODES = ["N0", "N1", "N2"]
# What the installation of a node fixes: sensor height over the bed, and the next node upstream.
NODE_META = "node string, sensor_cm double, upstream string"
SLOT_SECONDS = 300
SEQUENCE = 256


def _wave(hour: Column, node: Column) -> Column:
    """0 to 8 within 16 of every 60 hours."""
    return F.greatest(F.lit(0), 8 - F.abs(F.pmod(hour - node, F.lit(60)) - 8)).cast("int")


def from_events(events: DataFrame, users_per_basin: int = gauges.USERS_PER_BASIN) -> DataFrame:
    """basin, node, reading_id, ts, seq, level_cm, turbidity, tips, battery_mv."""
    user, number = F.col("user_id"), (F.col("user_id") % 3).cast("int")
    k, hour = F.regexp_extract("props", r"(\d+)", 1).cast("int"), hour_index(F.col("ts"))
    frozen = (number == 1) & (F.dayofmonth("ts") % 7 == 5)
    level = 40 + k % 5 + 20 * _wave(hour, number)
    level = F.when(frozen, 55).when(k == 99, level + 90).when(k == 98, -3).otherwise(level)
    rainy = (F.dayofmonth("ts") % 6).isin(1, 2, 3)
    tips = F.floor(F.greatest(F.col("value") - 75, F.lit(0.0)) / 25).cast("int")
    return events.select(
        F.concat(F.lit("B"), F.floor(user / users_per_basin).cast("string")).alias("basin"),
        F.concat(F.lit("N"), number.cast("string")).alias("node"),
        F.col("event_id").alias("reading_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.pmod(F.floor(F.unix_timestamp("ts") / SLOT_SECONDS), F.lit(SEQUENCE)).cast("int").alias("seq"),
        level.cast("int").alias("level_cm"),
        (10 + k % 4 + 6 * _wave(hour + 1, number)).cast("int").alias("turbidity"),
        F.when(rainy, tips).otherwise(0).alias("tips"),
        (3400 + (k * 7) % 600).cast("int").alias("battery_mv"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(gauges.events(spark, sf_dir))


def node_meta(spark: SparkSession) -> DataFrame:
    rows = [(n, 300.0, NODES[i - 1] if i else None) for i, n in enumerate(NODES)]
    return spark.createDataFrame(rows, NODE_META)
