"""Scoring when a reading arrives: every micro-batch is one live update.

Readings are upserted, the hours they touch are recomputed with the history these can see, checked for parity and
published by (basin, hour), so the log holds an hour as soon as its first reading is there and corrects it with each
later one. Hours are not held back until a watermark has passed (``hours`` does that).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.plans.update import live_update
from freshet.session import shared_folder
from freshet.sources.tables import write_table


def start_updates(
    readings: DataFrame, root: str, score: Callable[[DataFrame], DataFrame], late_hours: int = 48, **options
) -> StreamingQuery:
    """Apply everything that landed since the checkpoint under ``root`` (basin, station_id, sensor_id, ts, mm), then stop.

    The batch number is the arrival, so a later micro-batch corrects an earlier one. A replayed batch upserts the
    same rows again, and what a failed one left half done is made up for by the next update. Readings more than ``late_hours``
    before their station's last one are stored and take effect at the next rebuild. ``options`` go to ``live_update``.
    """
    session = readings.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        # The stream's own session has adaptive execution off: what follows the first write runs in the caller's.
        path = shared_folder(session, "arrived")
        write_table(batch.withColumn("arrival", F.lit(number).cast("long")), path)
        arrived = session.read.parquet(path)
        live_update(session, arrived, root, score, late_hours=late_hours, **options)

    return (
        readings.writeStream.option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True).foreachBatch(apply).start()
    )
