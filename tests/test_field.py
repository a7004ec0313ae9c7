"""Channel nodes: operators against brute force, streams against batch, edge cases."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from freshet.functions import rules
from freshet.operators import runs as R
from freshet.operators.quantiles import sliding_quantile, with_sliding_quantiles
from freshet.plans import field
from freshet.queries import field as queries
from freshet.sources import nodes
from freshet.streaming import field as live

START = datetime(2024, 3, 1)
NODE_ROWS = "basin string, node string, reading_id bigint, ts timestamp_ntz, seq int, level_cm int, turbidity int, tips int, battery_mv int"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def node_rows(spark, rows, basin="B0"):
    """(node, minutes, level) rows."""
    made = [(basin, n, i, at(m), int(m // 5) % 256, lv, 10, 0, 4000) for i, (n, m, lv) in enumerate(rows)]
    return spark.createDataFrame(made, NODE_ROWS)


def as_stream(spark, df, path, cuts, order):
    """The rows landed in ``len(cuts) + 1`` pieces; yields after each landing."""
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(order) >= F.lit(lo))
        if hi is not None:
            part = part.filter(F.col(order) < F.lit(hi))
        part.coalesce(1).write.mode("append").parquet(path)
        yield spark.readStream.schema(df.schema).parquet(path)


def run_stream(out, checkpoint, mode="append"):
    got = []
    out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, i: got.extend(df.collect())).start().awaitTermination()
    return got


# ---- runs and neighbours --------------------------------------------------------------------------------------------

def test_neighbours_and_runs_cross_midnights(spark):
    rng = np.random.default_rng(2)
    rows, minute = [], 0.0
    for _ in range(600):
        minute += float(rng.choice([3, 20, 400, 2000], p=[0.6, 0.3, 0.08, 0.02]))
        rows.append(("N0", minute, int(rng.integers(0, 2))))
    rows += [("N1", 5.0 * i, 7) for i in range(1000)]  # one run over several days
    df = node_rows(spark, rows)
    got = {(r["node"], r["start"], r["end"], r["level_cm"], r["n"]) for r in R.runs(df, ["basin", "node"], ["ts", "reading_id"], ["level_cm"]).collect()}
    want = set()
    for node in ("N0", "N1"):
        own = [r for r in rows if r[0] == node]
        for level, part in itertools.groupby(own, lambda r: r[2]):
            part = list(part)
            want.add((node, at(part[0][1]), at(part[-1][1]), level, len(part)))
    assert got == want
    near = R.with_neighbours(df, ["basin", "node"], ["ts", "reading_id"], ["level_cm"]).collect()
    for node in ("N0", "N1"):
        own = sorted((r for r in near if r["node"] == node), key=lambda r: r["ts"])
        assert own[0]["before"] is None and own[-1]["after"] is None
        assert all(a["after"]["ts"] == b["ts"] and b["before"]["level_cm"] == a["level_cm"] for a, b in zip(own, own[1:]))
    ends = R.runs(df, ["basin", "node"], ["ts", "reading_id"], [], 900).filter("node = 'N0'").orderBy("start").collect()
    times = [r[1] for r in rows if r[0] == "N0"]
    breaks = sum(b - a > 15 for a, b in zip(times, times[1:]))
    assert len(ends) == breaks + 1 and sum(r["n"] for r in ends) == 600


def test_windows_hold_a_day_of_a_node(spark):
    df = node_rows(spark, [("N0", 5.0 * i, i % 3) for i in range(100)])
    plan = R.runs(df, ["basin", "node"], ["ts", "reading_id"], ["level_cm"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window ")]
    # A window over a whole node sees the days' first and last runs only: it stands above the aggregation of the readings.
    assert any("_day" in w for w in windows)


def test_running_max_crosses_days(spark):
    rng = np.random.default_rng(4)
    rows = [("B0", int(i), int(i) if rng.random() < 0.05 else None) for i in range(0, 2000, 3)]
    out = R.running_max(spark.createDataFrame(rows, "basin string, slot bigint, x bigint"), ["basin"], "slot", 288, {"m": F.col("x")}).orderBy("slot").collect()
    best = None
    for (_, slot, x), r in zip(rows, out):
        best = x if best is None else max(best, x or best)
        assert r["slot"] == slot and r["m"] == best


# ---- sliding quantiles ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("days,q", [(7, 0.1), (1, 0.5), (2, 0.9)])
def test_sliding_quantile_equals_the_sorted_frame(spark, days, q):
    rng = np.random.default_rng(days)
    slots = np.flatnonzero(rng.random(24 * 20) < 0.7)
    rows = [("B0", int(s), int(v)) for s, v in zip(slots, rng.integers(-5, 40, len(slots)))] + [("B1", 5, 3)]
    df = spark.createDataFrame(rows, "basin string, slot bigint, v int")
    got = {(r["basin"], r["slot"]): r["x"] for r in sliding_quantile(df, ["basin"], "slot", 24, "v", days, q, "x").collect()}
    assert len(got) == len(rows) and got["B1", 5] == 3
    for b, s, _ in rows[:-1]:
        frame = [v for c, t, v in rows if c == b and s - 24 * days < t <= s]
        assert got[b, s] == pytest.approx(np.quantile(frame, q), abs=1e-9)
    assert sliding_quantile(df.filter("false"), ["basin"], "slot", 24, "v", days, q, "x").collect() == []


def test_several_quantiles_come_from_one_shuffle_with_their_rows(spark):
    rng = np.random.default_rng(3)
    slots = np.flatnonzero(rng.random(24 * 40) < 0.6) - 200
    rows = [("B0", int(s), int(a), int(b)) for s, a, b in zip(slots, rng.integers(0, 9, len(slots)), rng.integers(0, 400, len(slots)))]
    df = spark.createDataFrame(rows, "basin string, slot bigint, a int, b int")
    out = with_sliding_quantiles(df, ["basin"], "slot", 24, {"x": ("a", 7, 0.1), "y": ("b", 1, 0.5)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r["slot"], r["a"], r["b"]): (r["x"], r["y"]) for r in out.collect()}
    assert len(got) == len(rows)
    for _, s, a, b in rows:
        week, day = ([(r[2], r[3]) for r in rows if s - n < r[1] <= s] for n in (168, 24))
        assert got[s, a, b] == pytest.approx((np.quantile([r[0] for r in week], 0.1), np.quantile([r[1] for r in day], 0.5)), abs=1e-9)


def test_readings_of_one_time_at_the_end_of_two_frozen_runs_come_once(spark):
    # Two frozen runs meet in one time stamp: both hold its readings, each of which is one row.
    rows = [("N0", 10 * i, 55) for i in range(61)] + [("N0", 600 + 10 * i, 60) for i in range(61)]
    hour = int((START - datetime(1970, 1, 1)).total_seconds() // 3600)
    rain = spark.createDataFrame([("B0", hour + h, 1.5) for h in range(24)], "basin string, hour_idx bigint, P_basin double")
    got = field.quality_checked(node_rows(spark, rows), nodes.node_meta(spark), rain).collect()
    assert len(got) == len(rows) and all(r["frozen"] for r in got)


# ---- quality rules --------------------------------------------------------------------------------------------------

def test_jump_needs_the_next_reading(spark):
    levels = [("N0", 0, 40), ("N0", 5, 140), ("N0", 10, 41), ("N0", 15, 42), ("N0", 20, 150), ("N0", 25, 151), ("N0", 30, 300)]
    got = {r["ts"]: r["jump"] for r in field.jumps(node_rows(spark, levels)).collect()}
    assert [got[at(m)] for _, m, _ in levels] == [None, "spike", "confirmed", None, "confirmed", None, "pending"]


def test_frozen_values_need_rain(spark):
    rows = [("N0", 10 * i, 55) for i in range(60)] + [("N1", 10 * i, 60) for i in range(60)] + [("N2", 10 * i, 40 + i % 2) for i in range(60)]
    df = node_rows(spark, rows)
    hour = int((START - datetime(1970, 1, 1)).total_seconds() // 3600)
    rain = spark.createDataFrame([("B0", hour + 9, 1.5), ("B0", hour + 30, 5.0)], "basin string, hour_idx bigint, P_basin double")
    got = {r["node"]: (r["rain_mm"], r["frozen"], r["n"]) for r in field.frozen_runs(df, rain).collect()}
    assert got == {"N0": (1.5, True, 60), "N1": (1.5, True, 60)}
    dry = field.frozen_runs(df, rain.filter("false")).collect()
    assert [r["frozen"] for r in dry] == [False, False]


def test_lost_packets_are_counted_over_wraps_and_days(spark):
    rows = [("N0", m, 40) for m in (0, 5, 10, 12, 30, 30 + 5 * 256, 30 + 5 * 600, 35 + 5 * 600)]
    got = field.packet_counts(node_rows(spark, rows)).agg(F.sum("packets"), F.sum("resent"), F.sum("lost")).first()
    assert tuple(got) == (8, 1, 3 + 255 + 343)


def test_ancestors_of_any_depth(spark):
    meta = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, "a"), ("c", 1.0, "b"), ("d", 1.0, "c"), ("e", 1.0, "a")], nodes.NODE_META)
    got = {(r["node"], r["ancestor"]) for r in field.ancestors(meta).collect()}
    assert got == {("b", "a"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c"), ("e", "a")}


def test_rises_without_cause_upstream(spark):
    meta = nodes.node_meta(spark)
    rows = [("B0", n, h * 12 + k, 0.0 if k == 0 else rise) for n, h, rise in (("N0", 10, 30.0), ("N2", 12, 30.0), ("N2", 20, 30.0), ("N1", 30, 30.0), ("N0", 40, 50.0)) for k in (0, 5)]
    features = spark.createDataFrame(rows, "basin string, node string, slot bigint, h_rel double")
    rain = spark.createDataFrame([("B0", 28, 2.0)], "basin string, hour_idx bigint, P_basin double")
    got = field.incoherent_rises(features, rain, meta).collect()
    assert [(r["node"], r["hour_idx"]) for r in got] == [("N2", 20)]  # 12 follows N0, 30 follows rain, N0 has nothing above


# ---- fusion ---------------------------------------------------------------------------------------------------------

TRUTH = [
    (0.1, [], True, "NORMAL"), (0.3, [], True, "PRECAUCIÓN"), (0.9, [], True, "PRECAUCIÓN"), (0.1, ["lluvia_local"], True, "PRECAUCIÓN"),
    (0.9, ["lluvia_local"], True, "PRECAUCIÓN"), (0.9, ["nivel:N0"], True, "ALERTA"), (0.1, ["nivel:N0", "nivel:N1"], True, "ALERTA"),
    (0.1, ["lluvia_local", "turbidez:N1"], True, "ALERTA"), (0.1, ["nivel:N0"], True, "PRECAUCIÓN"), (None, [], True, "NORMAL"),
    (None, ["nivel:N0", "lluvia_local"], True, "ALERTA"), (0.9, [], False, "ALERTA"), (0.4, ["nivel:N0", "nivel:N1"], False, "PRECAUCIÓN"),
    (None, ["nivel:N0", "nivel:N1"], False, None), (0.1, [], False, "NORMAL"),
]


def test_fusion_truth_table(spark):
    df = spark.createDataFrame([(i, p, s, v) for i, (p, s, v, _) in enumerate(TRUTH)], "i int, p double, s array<string>, v boolean")
    got = df.select("i", rules.fused_state(F.col("p"), F.col("s"), F.col("v")).alias("e")).orderBy("i").collect()
    assert [r["e"] for r in got] == [e for *_, e in TRUTH]


def held_by_hand(rows):
    """Row by row: (slot, estado, leave) of one basin, closing rows included."""
    red, out = False, []
    for slot, estado, leave in rows:
        red = estado == "ALERTA" or (red and not leave)
        out.append((slot, "ALERTA" if red else estado))
    return out


def fused_rows(spark, n=900):
    rng = np.random.default_rng(6)
    rows, slot = [], 5_700_000
    for _ in range(n):
        slot += int(rng.choice([1, 3, 6, 7, 40], p=[0.9, 0.05, 0.02, 0.02, 0.01]))
        sources = [s for s, p in (("nivel:N0", 0.1), ("nivel:N1", 0.1), ("lluvia_local", 0.05)) if rng.random() < p]
        degraded = bool(rng.random() < 0.1)
        rows.append(("B0", slot, sources, float(rng.random() * 0.8), None if degraded else float(rng.integers(20, 70)), degraded))
    rows += [("B1", r[1], ["nivel:N0", "nivel:N1"], 0.9, 90.0, False) for r in rows[:5]]
    df = spark.createDataFrame(rows, "basin string, slot bigint, sources array<string>, p double, h_rel double, degraded boolean")
    df = df.withColumn("estado", rules.fused_state(F.col("p"), F.col("sources"), ~F.col("degraded")))
    return df.withColumn("forecast_only", F.lit(False))


def test_numbers_of_a_slot_need_no_object_aggregate(spark):
    rows = [("B0", 1, "nivel:N0", None, None), ("B0", 1, None, 70.0, None), ("B0", 1, "nivel:N0", None, 0.8), ("B0", 1, "lluvia_local", 3.0, 0.1),
            ("B0", 2, None, None, 0.4), ("B1", 1, "turbidez:N1", None, None)]
    got = field.fused(spark.createDataFrame(rows, "basin string, slot bigint, source string, h_rel double, p double"))
    sizes = {(r["basin"], r["slot"]): (r["sources"], r["p"], r["h_rel"], r["degraded"], r["estado"]) for r in got.collect()}
    assert sizes == {("B0", 1): (["lluvia_local", "nivel:N0"], 0.8, 70.0, False, "ALERTA"), ("B0", 2): ([], 0.4, None, True, "PRECAUCIÓN"),
                     ("B1", 1): (["turbidez:N1"], None, None, True, None)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("max(p" not in line for line in plan.splitlines() if "ObjectHashAggregate" in line)


def test_hysteresis_equals_a_row_by_row_walk(spark):
    df = fused_rows(spark)
    got = field.with_hysteresis(df).withColumn("leave", field.may_leave(F.col("sources"), F.col("p"), F.col("h_rel"), F.col("degraded")))
    for basin in ("B0", "B1"):
        rows = got.filter(F.col("basin") == basin).orderBy("slot").collect()
        assert [(r["slot"], r["held"]) for r in rows] == held_by_hand([(r["slot"], r["estado"], r["leave"]) for r in rows])
    slots = [r["slot"] for r in got.filter("basin = 'B1'").orderBy("slot").collect()]
    assert slots[-1] - slots[-2] == 6 and len(slots) > 5  # the pause after its last row lets go


# ---- streams --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("cuts", [[], [100], [3, 60, 61, 400, 410]])
def test_streamed_jumps_do_not_depend_on_the_cut(spark, tmp_path, cuts):
    rng = np.random.default_rng(9)
    rows = sorted(((f"N{i % 2}", 5.0 * i + float(rng.random()), 40 + int(rng.choice([0, 1, 90], p=[0.6, 0.3, 0.1]))) for i in range(500)), key=lambda r: r[1])
    df = node_rows(spark, rows).withColumn("at", F.col("reading_id"))
    got = []
    for stream in as_stream(spark, df, f"{tmp_path}/in", cuts, "at"):
        got += run_stream(live.jumps(stream), f"{tmp_path}/check")
    want = {r["reading_id"]: r["jump"] for r in field.jumps(df).collect()}
    assert len(got) == len({r["reading_id"] for r in got}) == 498  # each node's last reading waits for the next
    assert all(want[r["reading_id"]] == r["jump"] for r in got)


def test_streamed_silences_speak_without_a_further_reading(spark, tmp_path):
    rows = [("N0", 10.0 * i, 40) for i in range(200)] + [("N1", m, 40) for m in (0, 10, 100, 115, 115.1, 131)] + [("N2", 50, 40)]
    df = node_rows(spark, rows)
    got = []
    for stream in as_stream(spark, df, f"{tmp_path}/in", [at(60), at(700)], "ts"):
        got += run_stream(live.silences(stream), f"{tmp_path}/check")
    found = {(r["node"], r["silent_from"]) for r in got}
    # N1's and N2's last silences are told although neither reports again.
    assert found == {("N1", at(25)), ("N1", at(130.1)), ("N1", at(146)), ("N2", at(65))} and len(got) == 4
    batch = {(r["node"], r["silent_from"]) for r in field.silences(df).collect()}
    assert found == batch
    last = df.groupBy("basin", "node").agg(F.max("ts").alias("ts"))
    silent = live.silent_nodes(last, str(at(2100))).collect()
    assert {r["node"] for r in silent} == {"N0", "N1", "N2"}


def test_streamed_fusion_equals_batch(spark, tmp_path):
    signal = spark.createDataFrame([("B0", 1000 + i, f"nivel:N{i % 2}") for i in range(0, 300, 7)], "basin string, slot bigint, source string")
    levels = spark.createDataFrame([("B0", 1000 + i, 20.0 + i % 50) for i in range(0, 300, 2)], "basin string, slot bigint, h_rel double")
    log = spark.createDataFrame([("B0", datetime(1970, 1, 1) + timedelta(hours=h), 0.02 * (h % 50)) for h in range(83, 110)], "basin string, timestamp timestamp_ntz, proba_alerta double")
    hours = log.withColumn("slot", (F.hour("timestamp") + 24 * F.datediff("timestamp", F.lit("1970-01-01"))) * 12)
    want = {(r["basin"], r["slot"]): r for r in field.fused(field.fusion_inputs(signal, levels, log)).collect()}
    got, cuts = [], [1100, 1200]
    parts = [as_stream(spark, df, f"{tmp_path}/{n}", cuts, "slot") for n, df in (("s", signal), ("l", levels), ("p", hours))]
    for s, lv, p in zip(*parts):
        got += run_stream(live.fused(s, lv, p), f"{tmp_path}/check")
    assert len(got) == len({r["slot"] for r in got}) > 200
    assert all(r == want["B0", r["slot"]] for r in got)
    # Update mode tells at once what append mode holds back.
    latest = {}
    for r in run_stream(live.fused(s, lv, p), f"{tmp_path}/other", "update"):
        latest[r["basin"], r["slot"]] = r
    assert latest == want


def test_streamed_hysteresis_equals_batch_over_several_runs(spark, tmp_path):
    df = fused_rows(spark)
    got = []
    for stream in as_stream(spark, df, f"{tmp_path}/in", [5_700_003, 5_700_200, 5_700_600], "slot"):
        got += run_stream(live.with_hysteresis(stream), f"{tmp_path}/check")
    found = {(r["basin"], r["slot"]): r["held"] for r in got}
    want = {(r["basin"], r["slot"]): r["held"] for r in field.with_hysteresis(df).collect()}
    assert len(got) == len(found) and found == want
    assert want["B1", max(s for b, s in want if b == "B1")] is None  # told by a timer


# ---- events ---------------------------------------------------------------------------------------------------------

def test_warnings_and_floods_are_matched_one_to_one(spark):
    schema = "basin string, start bigint, end bigint"
    floods = spark.createDataFrame([("B0", 100, 120), ("B0", 130, 140), ("B0", 900, 910), ("B1", 50, 60)], schema)
    # One warning before two floods; two warnings before one flood; one that is too early; one that starts later; a tie.
    warnings = spark.createDataFrame([("B0", 90, 95), ("B0", 125, 126), ("B0", 880, 885), ("B0", 890, 895), ("B0", 300, 310), ("B1", 50, 55), ("B1", 51, 52)], schema)
    got = {(r["basin"], r["flood"], r["warning"], r["lead_minutes"]) for r in field.matched_episodes(floods, warnings, 36).collect()}
    assert got == {("B0", 100, 90, 50), ("B0", 900, 880, 100), ("B1", 50, 50, 0)} | {x for x in got if x[1] == 130}
    assert len({x[2] for x in got if x[0] == "B0"}) == len([x for x in got if x[0] == "B0"])
    m = {r["basin"]: r for r in field.event_metrics(floods, warnings, warnings, 36).collect()}
    assert m["B1"]["floods"] == 1 and m["B1"]["red_detected"] == 1 and m["B1"]["red_missed"] == 0 and m["B1"]["red_lead_minutes"] == 0
    assert m["B0"]["floods"] == 3 and m["B0"]["red_warnings"] == 5


def test_onsets_after_quiet_times(spark):
    rows = [("B0", "N0", s, 30.0) for s in (*range(100, 110), *range(140, 150), 400)] + [("B0", "N0", 200, 5.0)]
    features = spark.createDataFrame(rows, "basin string, node string, slot bigint, h_rel double")
    assert sorted(r["slot"] for r in field.onsets(features).collect()) == [100, 400]
    rain = spark.createDataFrame([("B0", 100 // 12, 10.0), ("B0", 400 // 12, 14.0)], "basin string, hour_idx bigint, P_acc_24h double")
    got = field.observed_curve_numbers(field.onsets(features), rain).first()
    assert (got["onsets"], got["ia_mm"], got["cn"]) == (2, 12.0, pytest.approx(25400 / (254 + 60)))


def test_empty_tables(spark):
    df = node_rows(spark, [])
    rain = spark.createDataFrame([], "basin string, hour_idx bigint, P_basin double")
    checked = field.quality_checked(df, nodes.node_meta(spark), rain)
    levels = field.level_features(field.slots(checked))
    assert levels.collect() == [] and field.silences(df).collect() == []
    log = spark.createDataFrame([], "basin string, timestamp timestamp_ntz, proba_alerta double")
    assert field.with_hysteresis(field.fused(field.fusion_inputs(field.signals(levels), levels, log))).collect() == []


def test_plan_of_the_level_features_does_not_grow_with_the_frame(spark):
    plans = []
    slotted = queries._slots(spark, SMALL)
    for days in (7, 70):
        df = sliding_quantile(slotted, field.NODE, "slot", field.SLOTS_PER_DAY, "level_cm", days, 0.1, "x")
        plans.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]
