"""Field sensors: quality control of node readings, derived levels, signals, fusion with the forecast, and hysteresis.

Readings are (basin, node, reading_id, ts, seq, level_cm, turbidity, tips, battery_mv). After quality control they are rolled up to
five-minute slots (``slot``: whole five minutes since 1970), on which everything later works. Nothing here windows over a whole
node or basin: windows hold a day (``operators.runs``) or a halo chunk (``operators.frames``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import rules
from freshet.functions.timegrid import date_index, day_index, hour_index
from freshet.operators.frames import add_windowed, exactly, trailing
from freshet.operators.quantiles import with_sliding_quantiles
from freshet.operators.runs import running_max, runs, seconds_between, with_neighbours
from freshet.sources.tables import staged

NODE = ["basin", "node"]
ORDER = ["ts", "reading_id"]
SLOT_SECONDS, SLOTS_PER_HOUR, SLOTS_PER_DAY = 300, 12, 288

# Limits of the quality rules; all are set per site.
CLEARANCE_CM = 25.0
MAX_RATE_CM_MIN, LEAST_MINUTES = 2.0, 5.0
FROZEN_HOURS = 6
SILENT_SECONDS = 900
LOW_BATTERY_MV = 3450
SEQUENCE = 256
# Limits of the signals.
BASE_DAYS, BASE_SHARE = 7, 0.1
LEVEL_ALERT_CM, LEVEL_MARGIN_CM, RISE_ALERT_CM_H = 60.0, 15.0, 80.0
TURBIDITY_RATIO, LOCAL_RAIN_MM_H, MM_PER_TIP = 3.0, 6.0, 1.5
SIGNAL_SLOTS, VALID_SLOTS = 6, 3


def slot_of(ts: Column) -> Column:
    # Slots begin at whole seconds, so parts of a second do not matter.
    return F.floor(F.unix_timestamp(ts) / SLOT_SECONDS)


def slot_time(slot: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), (slot * 5).cast("int"))


# ---- quality control ------------------------------------------------------------------------------------------------

def out_of_range(readings: DataFrame, meta: DataFrame) -> DataFrame:
    """Add ``out_of_range``: under the bed, or nearer to the sensor than it can see. Unknown nodes are judged by the bed alone."""
    known = readings.join(meta.select("node", "sensor_cm"), "node", "left")
    high = F.coalesce(F.col("level_cm") > F.col("sensor_cm") - CLEARANCE_CM, F.lit(False))
    return known.withColumn("out_of_range", (F.col("level_cm") < 0) | high).drop("sensor_cm")


def too_fast(level_a: Column, ts_a: Column, level_b: Column, ts_b: Column) -> Column:
    step = F.abs(level_b - level_a)
    minutes = F.greatest(seconds_between(ts_a, ts_b) / 60, F.lit(LEAST_MINUTES))
    # Most steps are small enough for the shortest time; only the others need the time between.
    return F.when(step <= MAX_RATE_CM_MIN * LEAST_MINUTES, F.lit(False)).otherwise(step > MAX_RATE_CM_MIN * minutes)


def jumps(readings: DataFrame) -> DataFrame:
    """Add ``jump`` to readings within range: NULL, or for a step faster than the water can rise or fall what the next reading
    makes of it: ``confirmed`` (it stays there), ``spike`` (it leaves again as fast) or ``pending`` (none yet)."""
    rows = with_neighbours(readings, NODE, ORDER, ["level_cm"])
    at, to = too_fast(F.col("before.level_cm"), F.col("before.ts"), F.col("level_cm"), F.col("ts")), too_fast(
        F.col("level_cm"), F.col("ts"), F.col("after.level_cm"), F.col("after.ts"))
    verdict = (
        F.when(F.col("before").isNull() | ~at, F.lit(None).cast("string"))
        .when(F.col("after").isNull(), "pending").when(to, "spike").otherwise("confirmed")
    )
    return rows.withColumn("jump", verdict).drop("before", "after")


def frozen_runs(readings: DataFrame, rain: DataFrame) -> DataFrame:
    """Runs of one level over ``FROZEN_HOURS`` or more: basin, node, level_cm, start, end, n, rain_mm, frozen.

    ``rain`` (basin, hour_idx, P_basin) is summed over the hours that a run touches; runs meet it on the day. A run without rain is not
    held against the sensor.
    """
    lasted = F.col("end") - F.col("start") >= F.make_dt_interval(F.lit(0), F.lit(FROZEN_HOURS))
    long = staged(runs(readings, NODE, ORDER, ["level_cm"]).filter(lasted), "long_runs")
    first, last = hour_index(F.col("start")), hour_index(F.col("end"))
    spread = long.select("basin", "node", "start", first.alias("_lo"), last.alias("_hi"),
                         F.explode(F.sequence(day_index(first), day_index(last))).alias("_day"))
    hours = rain.select("basin", "hour_idx", "P_basin", day_index(F.col("hour_idx")).alias("_day"))
    fallen = spread.join(hours, ["basin", "_day"]).filter(F.col("hour_idx").between(F.col("_lo"), F.col("_hi")))
    fallen = fallen.groupBy("basin", "node", "start").agg(F.sum("P_basin").alias("rain_mm"))
    out = long.join(fallen, ["basin", "node", "start"], "left").withColumn("rain_mm", F.coalesce("rain_mm", F.lit(0.0)))
    return out.withColumn("frozen", F.col("rain_mm") > 0)


def quality_checked(readings: DataFrame, meta: DataFrame, rain: DataFrame) -> DataFrame:
    """Readings with ``out_of_range``, ``jump``, ``frozen``, ``low_battery`` and ``valid`` (counts as a signal)."""
    # Read by three branches: parsed and judged once.
    ranged = staged(out_of_range(readings, meta), "ranged")
    inside = jumps(ranged.filter("NOT out_of_range"))
    rows = inside.unionByName(ranged.filter("out_of_range").withColumn("jump", F.lit(None).cast("string")))
    held = frozen_runs(ranged, rain).filter("frozen")
    days = F.sequence(date_index(F.col("start")), date_index(F.col("end")))
    held = held.select(*NODE, F.explode(days).alias("_day"), F.struct("start", "end").alias("_run"))
    # A run lasts six hours or more, so a day of a node touches five at most.
    held = held.groupBy(*NODE, "_day").agg(F.collect_list("_run").alias("_held"))
    rows = rows.withColumn("_day", date_index(F.col("ts"))).join(held, [*NODE, "_day"], "left").drop("_day")
    inside_run = F.exists("_held", lambda run: F.col("ts").between(run["start"], run["end"]))
    rows = rows.withColumns({"frozen": F.coalesce(inside_run, F.lit(False)), "low_battery": F.col("battery_mv") < LOW_BATTERY_MV}).drop("_held")
    doubtful = F.coalesce(F.col("jump").isin("spike", "pending"), F.lit(False))
    return rows.withColumn("valid", ~F.col("out_of_range") & ~F.col("frozen") & ~doubtful)


def sessions(readings: DataFrame, gap_seconds: int = SILENT_SECONDS) -> DataFrame:
    """Stretches of a node's readings without a silence: basin, node, start, end, n."""
    return runs(readings, NODE, ORDER, [], gap_seconds)


def silences(readings: DataFrame, gap_seconds: int = SILENT_SECONDS) -> DataFrame:
    """basin, node, silent_from (``gap_seconds`` after the last packet), silent_until (the next one; NULL while silent).

    The last silence of a node is known once any node of the table has reported after it began.
    """
    found = sessions(readings, gap_seconds)
    after = with_neighbours(found.select(*NODE, "start", "end"), NODE, ["start"], [])
    begun = F.col("end") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds))
    now = readings.agg(F.max("ts")).scalar()
    rows = after.select(*NODE, begun.alias("silent_from"), F.col("after.start").alias("silent_until"))
    return rows.filter(F.col("silent_until").isNotNull() | (F.col("silent_from") < now))


def incoherent_rises(features: DataFrame, rain: DataFrame, meta: DataFrame, rise_cm: float = 20.0, lag_hours: int = 3) -> DataFrame:
    """Hours in which a node rises while nothing upstream of it does and it does not rain.

    ``features`` has basin, node, slot, h_rel. The channel (``meta``: node, upstream) is walked to every ancestor; a rise is
    explained by a rise of any ancestor in the same hour or the ``lag_hours`` before, or by rain of the basin in those hours.
    """
    hours = features.groupBy(*NODE, F.floor(F.col("slot") / SLOTS_PER_HOUR).alias("hour_idx")).agg(
        (F.max("h_rel") - F.min("h_rel")).alias("rise_cm"))
    risen = hours.filter(F.col("rise_cm") >= rise_cm)
    cover = F.explode(F.sequence(F.col("hour_idx"), F.col("hour_idx") + lag_hours)).alias("hour_idx")
    above = ancestors(meta)
    by_node = risen.select("basin", F.col("node").alias("ancestor"), cover).distinct()
    by_node = by_node.join(above, "ancestor").select("basin", "node", "hour_idx").distinct().withColumn("upstream_rise", F.lit(True))
    wet = rain.filter("P_basin > 0").select("basin", cover).distinct().withColumn("rain", F.lit(True))
    judged = risen.join(by_node, [*NODE, "hour_idx"], "left").join(wet, ["basin", "hour_idx"], "left")
    has_above = above.select("node").distinct().withColumn("_below", F.lit(True))
    return judged.join(has_above, "node").filter("upstream_rise IS NULL AND rain IS NULL").select(*NODE, "hour_idx", "rise_cm")


def ancestors(meta: DataFrame) -> DataFrame:
    """node, ancestor for every node upstream of it, any depth. The channel's topology is small; paths are doubled per round."""
    found = meta.filter("upstream IS NOT NULL").select("node", F.col("upstream").alias("ancestor")).distinct()
    size = found.count()
    while True:
        step = found.select(F.col("node").alias("_mid"), F.col("ancestor").alias("_far"))
        more = found.join(step, F.col("ancestor") == F.col("_mid")).select("node", F.col("_far").alias("ancestor"))
        found = found.unionByName(more).distinct()
        now = found.count()
        if now == size:
            return found
        size = now


# ---- two resolutions from one scan ----------------------------------------------------------------------------------

def slots(readings: DataFrame) -> DataFrame:
    """Five-minute slots of a node: highest level and turbidity, tips, number of readings."""
    rows = readings.withColumn("slot", slot_of(F.col("ts")))
    return rows.groupBy(*NODE, "slot").agg(
        F.max("level_cm").alias("level_cm"), F.max("turbidity").alias("turbidity"), F.sum("tips").alias("tips"),
        F.count(F.lit(1)).alias("n"), F.sum("level_cm").alias("level_sum"))


def node_hours(slotted: DataFrame) -> DataFrame:
    """Hours from slots: mean and highest level, highest turbidity, rain, readings, and how many slots had any."""
    hour = F.floor(F.col("slot") / SLOTS_PER_HOUR).alias("hour_idx")
    return slotted.groupBy(*NODE, hour).agg(
        (F.sum("level_sum") / F.sum("n")).alias("level_mean"), F.max("level_cm").alias("level_max"), F.max("turbidity").alias("turbidity"),
        (F.sum("tips") * MM_PER_TIP).alias("rain_mm"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("slots_with_data"))


def packet_counts(readings: DataFrame) -> DataFrame:
    """Per node and day: packets, resent ones (same number as the one before) and lost ones, by numbers that wrap around.

    Silences longer than a whole turn of the counter are told by the clock: the counter advances once a slot, so the turns that fit
    into the time between two packets are added. A gap counts for the day of the packet that ends it.
    """
    rows = with_neighbours(readings, NODE, ORDER, ["seq"])
    step = F.pmod(F.col("seq") - F.col("before.seq"), F.lit(SEQUENCE))
    passed = slot_of(F.col("ts")) - slot_of(F.col("before.ts"))
    turns = F.floor((passed - step + SEQUENCE / 2) / SEQUENCE)
    ahead = step + SEQUENCE * F.greatest(turns, F.lit(0))
    lost = F.when(F.col("before").isNull() | (ahead == 0), 0).otherwise(ahead - 1)
    resent = F.coalesce(ahead == 0, F.lit(False))
    return rows.groupBy(*NODE, F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(resent).alias("resent"), F.sum(lost).cast("long").alias("lost"))


# ---- derived values and signals -------------------------------------------------------------------------------------

def level_features(slotted: DataFrame) -> DataFrame:
    """Slots with h_base (10th percentile of seven days), h_rel, dh_15min and dh_1h (cm an hour), h_max_1h, turb_rel (over the
    median of 24 hours)."""
    rows = with_sliding_quantiles(slotted, NODE, "slot", SLOTS_PER_DAY, {
        "h_base": ("level_cm", BASE_DAYS, BASE_SHARE), "_turb_base": ("turbidity", 1, 0.5)})
    rows = rows.withColumns({"h_rel": F.col("level_cm") - F.col("h_base"), "turb_rel": F.try_divide(F.col("turbidity"), F.col("_turb_base"))})

    def columns(w):
        return {
            "dh_15min": (F.col("h_rel") - exactly(w, F.col("h_rel"), -3)) * 4,
            "dh_1h": F.col("h_rel") - exactly(w, F.col("h_rel"), -SLOTS_PER_HOUR),
            "h_max_1h": trailing(w, F.max("h_rel"), SLOTS_PER_HOUR),
            "rain_1h": trailing(w, F.sum("tips"), SLOTS_PER_HOUR) * MM_PER_TIP,
        }

    return add_windowed(rows, NODE, "slot", columns, back=SLOTS_PER_HOUR, chunk_len=SLOTS_PER_DAY).drop("_turb_base")


def signals(features: DataFrame, rain_node: str = "N0") -> DataFrame:
    """Critical signals: basin, slot, source. A level is critical in two readings running."""
    critical = (F.col("h_rel") >= LEVEL_ALERT_CM) | F.coalesce(F.col("dh_15min") >= RISE_ALERT_CM_H, F.lit(False))
    rows = features.select(*NODE, "slot", slot_time(F.col("slot")).alias("_at"), "turb_rel", "rain_1h", critical.alias("_critical"))
    rows = with_neighbours(rows, NODE, ["_at"], ["_critical"])
    twice = F.col("_critical") & F.coalesce(F.col("before._critical"), F.lit(False))
    names = F.array_compact(F.array(
        F.when(twice, F.concat(F.lit("nivel:"), F.col("node"))),
        F.when(F.col("turb_rel") >= TURBIDITY_RATIO, F.concat(F.lit("turbidez:"), F.col("node"))),
        F.when((F.col("node") == rain_node) & (F.col("rain_1h") >= LOCAL_RAIN_MM_H), F.lit("lluvia_local")),
    ))
    return rows.select("basin", "slot", F.explode(names).alias("source"))


def fusion_inputs(signal: DataFrame, features: DataFrame, log: DataFrame) -> DataFrame:
    """The three inputs on the slots for which they hold: basin, slot, source, h_rel, p.

    A signal holds for half an hour, a valid reading for a quarter, a probability for its hour. Sources meet by
    (basin, slot), so no stream is paired with another, and each input may be a stream.
    """
    def over(df: DataFrame, first: Column, number: int, **columns: Column) -> DataFrame:
        held = {"source": F.lit(None).cast("string"), "h_rel": F.lit(None).cast("double"), "p": F.lit(None).cast("double")} | columns
        at = F.explode(F.sequence(first, first + number - 1)).alias("slot")
        return df.select("basin", *[c.alias(n) for n, c in held.items()], at)

    return (
        over(signal, F.col("slot"), SIGNAL_SLOTS, source=F.col("source"))
        .unionByName(over(features, F.col("slot"), VALID_SLOTS, h_rel=F.col("h_rel")))
        .unionByName(over(log, hour_index(F.col("timestamp")) * SLOTS_PER_HOUR, SLOTS_PER_HOUR, p=F.col("proba_alerta")))
    )


def fused(inputs: DataFrame, by: list | None = None) -> DataFrame:
    """One row per basin and slot: sources (distinct, sorted), p, h_rel (highest valid), degraded, estado, forecast_only.

    ``by`` are the grouping columns (a stream groups on a watermarked time). The set of a group holds source names of one basin.
    A stream has one aggregation; a table has the numbers of all its rows in one that needs no objects and the sets of the few rows with a source
    in another, joined on the same partitioning.
    """
    by = by or ["basin", "slot"]
    names = F.sort_array(F.collect_set("source")).alias("sources")
    numbers = [F.max("p").alias("p"), F.max("h_rel").alias("h_rel"), (F.count("h_rel") == 0).alias("degraded")]
    if inputs.isStreaming:
        rows = inputs.groupBy(*by).agg(names, *numbers)
    else:
        said = inputs.filter("source IS NOT NULL").groupBy(*by).agg(names)
        rows = inputs.groupBy(*by).agg(*numbers).join(said, by, "left").select(
            *by, F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "p", "h_rel", "degraded")
    out = rows.withColumn("estado", rules.fused_state(F.col("p"), F.col("sources"), ~F.col("degraded")))
    forecast = F.coalesce((F.col("p") >= rules.ALERT_AT) & (F.col("estado") == rules.STATES[1]), F.lit(False))
    return out.withColumn("forecast_only", forecast)


# ---- hysteresis -----------------------------------------------------------------------------------------------------

def is_red(estado: Column) -> Column:
    return F.coalesce(estado == rules.STATES[2], F.lit(False))


def may_leave(sources: Column, p: Column, h_rel: Column, degraded: Column) -> Column:
    """No critical signal in the last half hour, and the water under the limit less the margin (unknown only in degraded mode)."""
    quiet = (F.size(sources) == 0) & ~F.coalesce(p >= rules.ALERT_AT, F.lit(False))
    return quiet & (degraded | F.coalesce(h_rel < LEVEL_ALERT_CM - LEVEL_MARGIN_CM, F.lit(False)))


def closing_rows(fused_rows: DataFrame) -> DataFrame:
    """A row half an hour after the last one before a pause: nothing critical, no node, no probability.

    What follows the last row of a basin is known once any basin has a row half an hour later.
    """
    at = slot_time(F.col("slot")).alias("_at")
    rows = with_neighbours(fused_rows.select("basin", "slot", at), ["basin"], ["_at"], ["slot"])
    pause = rows.filter((F.col("after.slot") - F.col("slot") > SIGNAL_SLOTS) | F.col("after").isNull())
    last = fused_rows.agg(F.max("slot")).scalar()
    due = pause.filter(F.col("after").isNotNull() | (F.col("slot") + SIGNAL_SLOTS <= last))
    return due.select(
        "basin", (F.col("slot") + SIGNAL_SLOTS).alias("slot"), F.array().cast("array<string>").alias("sources"), F.lit(None).cast("double").alias("p"),
        F.lit(None).cast("double").alias("h_rel"), F.lit(True).alias("degraded"), F.lit(None).cast("string").alias("estado"),
        F.lit(False).alias("forecast_only"))


def with_hysteresis(fused_rows: DataFrame) -> DataFrame:
    """Rows of ``fused`` and the closing ones with ``held``: the state that is shown. Red stays until ``may_leave``.

    A row is red if the last entry into red is later than the last row that let it go: two running maxima, no recursion.
    """
    rows = fused_rows.unionByName(closing_rows(fused_rows))
    leave = may_leave(F.col("sources"), F.col("p"), F.col("h_rel"), F.col("degraded"))
    marked = running_max(rows, ["basin"], "slot", SLOTS_PER_DAY, {
        "_in": F.when(is_red(F.col("estado")), F.col("slot")), "_out": F.when(leave, F.col("slot"))})
    red = F.coalesce(F.col("_in") > F.coalesce("_out", F.lit(-1)), F.lit(False))
    return marked.withColumn("held", F.when(red, rules.STATES[2]).otherwise(F.col("estado"))).drop("_in", "_out")


# ---- events ---------------------------------------------------------------------------------------------------------

def episodes(rows: DataFrame, gap_slots: int, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, slot) at most ``gap_slots`` apart as one episode: keys, start, end (slots)."""
    timed = rows.select(*(keys or ["basin"]), "slot", slot_time(F.col("slot")).alias("_at"))
    found = runs(timed, keys or ["basin"], ["_at"], [], gap_slots * SLOT_SECONDS)
    return found.select(*(keys or ["basin"]), slot_of(F.col("start")).alias("start"), slot_of(F.col("end")).alias("end"))


def matched_episodes(floods: DataFrame, warnings: DataFrame, lead_slots: int) -> DataFrame:
    """One-to-one pairs of floods and warnings (basin, start, end each): basin, flood, warning (starts), lead_minutes.

    A warning may announce a flood that begins while it lasts or up to ``lead_slots`` after its end. A flood takes the
    earliest such warning and a warning the earliest such flood; only mutual choices are pairs. Both meet on the days they touch.
    """
    def days(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / SLOTS_PER_DAY), F.floor(last / SLOTS_PER_DAY))).alias("_day")

    f = floods.select("basin", F.col("start").alias("flood"), F.floor(F.col("start") / SLOTS_PER_DAY).alias("_day"))
    reach = F.col("end") + lead_slots
    w = warnings.select("basin", F.col("start").alias("warning"), reach.alias("_reach"), days(F.col("start"), reach))
    near = f.join(w, ["basin", "_day"]).filter((F.col("warning") <= F.col("flood")) & (F.col("flood") <= F.col("_reach")))
    chosen = near.groupBy("basin", "flood").agg(F.min("warning").alias("warning"))
    back = near.groupBy("basin", "warning").agg(F.min("flood").alias("flood"))
    pairs = chosen.join(back, ["basin", "flood", "warning"])
    return pairs.withColumn("lead_minutes", (F.col("flood") - F.col("warning")) * (SLOT_SECONDS // 60))


def event_metrics(floods: DataFrame, yellow: DataFrame, red: DataFrame, lead_slots: int) -> DataFrame:
    """Per basin: floods, announced and missed ones and the median lead by yellow and by red, and red warnings without a flood
    per 30 days of the span between first and last episode."""
    def side(warnings: DataFrame, name: str) -> DataFrame:
        pairs = matched_episodes(floods, warnings, lead_slots)
        return pairs.groupBy("basin").agg(
            F.count(F.lit(1)).alias(f"{name}_detected"), F.percentile("lead_minutes", 0.5).alias(f"{name}_lead_minutes"))

    all_ = floods.select("basin", "start", "end").unionByName(red.select("basin", "start", "end")).unionByName(yellow.select("basin", "start", "end"))
    span = all_.groupBy("basin").agg(((F.max("end") - F.min("start") + 1) / SLOTS_PER_DAY).alias("_days"))
    count = floods.groupBy("basin").agg(F.count(F.lit(1)).alias("floods"))
    reds = red.groupBy("basin").agg(F.count(F.lit(1)).alias("red_warnings"))
    out = span.join(count, "basin", "left").join(reds, "basin", "left").join(side(yellow, "yellow"), "basin", "left").join(
        side(red, "red"), "basin", "left")
    out = out.fillna(0, ["floods", "red_warnings", "yellow_detected", "red_detected"])
    return out.withColumns({
        "yellow_missed": F.col("floods") - F.col("yellow_detected"), "red_missed": F.col("floods") - F.col("red_detected"),
        "false_reds_per_month": 30 * (F.col("red_warnings") - F.col("red_detected")) / F.col("_days"),
    }).drop("_days")


# ---- curve number from observed onsets ------------------------------------------------------------------------------

def onsets(features: DataFrame, rise_cm: float = 20.0, quiet_slots: int = 3 * SLOTS_PER_HOUR) -> DataFrame:
    """First slots of a rise after a quiet time: basin, node, slot. Risen slots at most ``quiet_slots`` apart are one rise."""
    risen = features.filter(F.col("h_rel") >= rise_cm).select(*NODE, "slot")
    return episodes(risen, quiet_slots, NODE).select(*NODE, F.col("start").alias("slot"))


def observed_curve_numbers(found: DataFrame, rain_24h: DataFrame, node: str = "N0") -> DataFrame:
    """basin, onsets, ia_mm (median rain of the 24 hours up to an onset), cn = 25400 / (254 + 5 ia).

    ``rain_24h`` is (basin, hour_idx, P_acc_24h); an onset takes the value of its hour. Onsets without rain do not count: a
    response without rain says nothing about the soil.
    """
    at = found.filter(F.col("node") == node).select("basin", F.floor(F.col("slot") / SLOTS_PER_HOUR).alias("hour_idx"))
    rows = at.join(rain_24h.select("basin", "hour_idx", "P_acc_24h"), ["basin", "hour_idx"]).filter("P_acc_24h > 0")
    out = rows.groupBy("basin").agg(F.count(F.lit(1)).alias("onsets"), F.percentile("P_acc_24h", 0.5).alias("ia_mm"))
    return out.withColumn("cn", 25400.0 / (254.0 + 5.0 * F.col("ia_mm")))
