"""Channel nodes as they report: silences, fusion and the two stateful rules, as streams.

Silences are session windows and fusion is one watermarked aggregation, both with the batch definitions. Jumps and hysteresis
need the row before: a keyed state machine holds one reading (one state) per node (basin), so results are the same for any
cut into micro-batches. Rows of a key are expected in time order from batch to batch, and are sorted inside one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from freshet.functions import rules
from freshet.plans import field
from freshet.session import STATE_STORE, ship
from freshet.streaming.hours import event_time

LATENESS = "30 minutes"
# A probability holds for an hour ahead of its time, so the fused slots of now close an hour later than the readings.
FUSION_LATENESS = "90 minutes"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that keyed state machines need (``build_session`` sets it for good)."""
    key, store = STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def silences(readings: DataFrame, gap_seconds: int = field.SILENT_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """basin, node, silent_from of every silence, as soon as the watermark has passed it.

    The watermark follows all nodes, so a node's silence shows without a further reading of that node. When nothing arrives from any node
    there is no micro-batch: ``silent_nodes`` asks the clock.
    """
    rows = event_time(readings).withWatermark("ts", lateness)
    # A reading exactly at the end of a session still belongs to it.
    span = F.session_window("ts", f"{gap_seconds} seconds 1 microsecond").alias("_s")
    found = rows.groupBy("basin", "node", span).agg(F.count(F.lit(1)).alias("n"))
    at = (F.col("_s.end") - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz")
    return found.select("basin", "node", at.alias("silent_from"))


def silent_nodes(last_readings: DataFrame, now: str, gap_seconds: int = field.SILENT_SECONDS) -> DataFrame:
    """Nodes whose last reading (basin, node, ts) is more than ``gap_seconds`` before ``now``."""
    begun = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds))
    return last_readings.select("basin", "node", begun.alias("silent_from")).filter(F.col("silent_from") < F.lit(now).cast("timestamp_ntz"))


def fused(signals: DataFrame, features: DataFrame, log: DataFrame, lateness: str = FUSION_LATENESS) -> DataFrame:
    """``field.fused`` of three streams. In append mode a slot comes once, closed; in update mode it comes as soon as anything is known
    about it and again when that changes (sinks then upsert by basin and slot)."""
    rows = field.fusion_inputs(signals, features, log)
    at = field.slot_time(F.col("slot")).cast("timestamp")
    timed = rows.withColumn("at", at).withWatermark("at", lateness)
    return field.fused(timed, ["basin", "slot", "at"]).drop("at")


# ---- jumps ----------------------------------------------------------------------------------------------------------

class JumpRule(StatefulProcessor):
    """Holds the last reading of a node and whether it came by a jump; the next reading decides what that was."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ts timestamp_ntz, reading_id bigint, level_cm int, fast boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get()
        for row in sorted(rows, key=lambda r: (r.ts, r.reading_id)):
            fast = False
            if held is not None:
                ts, reading_id, level, held_fast = held
                minutes = max((row.ts - ts) / timedelta(minutes=1), field.LEAST_MINUTES)
                fast = abs(row.level_cm - level) > field.MAX_RATE_CM_MIN * minutes
                jump = ("spike" if fast else "confirmed") if held_fast else None
                yield Row(basin=key[0], node=key[1], reading_id=reading_id, ts=ts, level_cm=level, jump=jump)
            held = (row.ts, row.reading_id, row.level_cm, fast)
        self.held.update(held)

    def close(self) -> None:
        pass


def jumps(readings: DataFrame) -> DataFrame:
    """basin, node, reading_id, ts, level_cm, jump of every reading within range, one reading late: the last one waits."""
    ship(readings.sparkSession)
    rows = readings.select("basin", "node", F.col("ts").cast("timestamp_ntz").alias("ts"), "reading_id", "level_cm")
    out = "basin string, node string, reading_id bigint, ts timestamp_ntz, level_cm int, jump string"
    return rows.groupBy("basin", "node").transformWithState(JumpRule(), T.StructType.fromDDL(out), "Append", "None")


# ---- hysteresis -----------------------------------------------------------------------------------------------------

class RedRule(StatefulProcessor):
    """Holds the last slot of a basin and whether it was red. A timer half an hour after the last slot lets go."""

    SLOT_MS = field.SLOT_SECONDS * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "slot bigint, red boolean")

    def _closing(self, basin: str, slot: int) -> Row:
        return Row(basin=basin, slot=slot + field.SIGNAL_SLOTS, estado=None, held=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, red = self.held.get() or (None, False)
        for row in sorted(rows, key=lambda r: r.slot):
            if last is not None and row.slot - last > field.SIGNAL_SLOTS:
                yield self._closing(key[0], last)
                red = False
            red = row.estado == rules.STATES[2] or (red and not row.leave)
            last = row.slot
            yield Row(basin=key[0], slot=row.slot, estado=row.estado, held=rules.STATES[2] if red else row.estado)
        self.held.update((last, red))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer((last + field.SIGNAL_SLOTS) * self.SLOT_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, _ = self.held.get()
        self.held.clear()
        yield self._closing(key[0], last)

    def close(self) -> None:
        pass


def with_hysteresis(fused_rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """basin, slot, estado, held of closed fused slots (``field.with_hysteresis`` as a stream)."""
    ship(fused_rows.sparkSession)
    leave = field.may_leave(F.col("sources"), F.col("p"), F.col("h_rel"), F.col("degraded"))
    at = field.slot_time(F.col("slot")).cast("timestamp").alias("at")
    rows = fused_rows.select("basin", "slot", "estado", leave.alias("leave"), at).withWatermark("at", lateness)
    out = T.StructType.fromDDL("basin string, slot bigint, estado string, held string")
    return rows.groupBy("basin").transformWithState(RedRule(), out, "Append", "EventTime")
