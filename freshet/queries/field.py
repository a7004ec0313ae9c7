"""Queries on the channel nodes: quality control, rollups, derived values, fusion, hysteresis, event metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import rules
from freshet.operators.series import basin_hours, complete_grid, station_hours, timestamped, with_runoff
from freshet.plans import field
from freshet.queries import query
from freshet.queries.base import r6, scored_rows
from freshet.queries.sql import r, stamp, with_ctes
from freshet.session import shared_folder
from freshet.sources import gauges, nodes
from freshet.sources.tables import read, staged
from freshet.streaming import field as live

LEAD_SLOTS = 6 * field.SLOTS_PER_HOUR
FLOOD_CM = 80.0
EPISODE_GAP = 2 * field.SLOTS_PER_HOUR

WAVE = "greatest(0, 8 - abs(((({0} - num) % 60) + 60) % 60 - 8))"
H = "(epoch_us(ts) // 3600000000)"
SLOT = "(epoch_us(ts) // 300000000)"
NW = "(PARTITION BY basin, node ORDER BY ts, reading_id)"


def _fast(a: str, b: str) -> str:
    return f"abs({b}.level_cm - {a}.level_cm) > 2.0::DOUBLE * greatest((epoch_us({b}.ts) - epoch_us({a}.ts)) / 60000000.0::DOUBLE, 5)"


def _islands(source: str, keys: str, order: str, new: str, columns: str) -> str:
    return f"""SELECT {keys}, {columns} FROM (SELECT *, count(*) FILTER (_new) OVER (PARTITION BY {keys} ORDER BY {order}) AS _run
        FROM (SELECT *, {new} AS _new FROM {source})) GROUP BY {keys}, _run"""


CTES = {
    "packets": f"""SELECT 'B' || CAST(user_id // 75 AS VARCHAR) AS basin, 'N' || CAST(num AS VARCHAR) AS node, event_id AS reading_id, ts,
          CAST({SLOT} % 256 AS INTEGER) AS seq,
          CAST(CASE WHEN num = 1 AND day(ts) % 7 = 5 THEN 55 WHEN k = 99 THEN 130 + k % 5 + 20 * {WAVE.format(H)} WHEN k = 98 THEN -3
            ELSE 40 + k % 5 + 20 * {WAVE.format(H)} END AS INTEGER) AS level_cm,
          CAST(10 + k % 4 + 6 * {WAVE.format('(' + H + ' + 1)')} AS INTEGER) AS turbidity,
          CASE WHEN day(ts) % 6 IN (1, 2, 3) THEN CAST(floor(greatest(value - 75, 0) / 25) AS INTEGER) ELSE 0 END AS tips,
          CAST(3400 + (k * 7) % 600 AS INTEGER) AS battery_mv
        FROM (SELECT *, user_id % 3 AS num, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)""",
    "inside": "SELECT * FROM packets WHERE NOT (level_cm < 0 OR level_cm > 275)",
    "beside": f"""SELECT *, lag({{'ts': ts, 'level_cm': level_cm}}) OVER {NW} AS b, lead({{'ts': ts, 'level_cm': level_cm}}) OVER {NW} AS a,
        {{'ts': ts, 'level_cm': level_cm}} AS o FROM inside""",
    "jumps": f"""SELECT basin, node, reading_id, ts, CASE WHEN b IS NULL OR NOT ({_fast('b', 'o')}) THEN NULL WHEN a IS NULL THEN 'pending'
        WHEN {_fast('o', 'a')} THEN 'spike' ELSE 'confirmed' END AS jump FROM beside""",
    "level_runs": _islands("packets", "basin, node", "ts, reading_id", f"level_cm IS DISTINCT FROM lag(level_cm) OVER {NW}",
                           'min(level_cm) AS level_cm, min(ts) AS start, max(ts) AS "end", count(*) AS n'),
    "long_runs": """SELECT l.basin, l.node, l.level_cm, l.start, l."end", l.n, coalesce(sum(P_basin), 0) AS rain_mm FROM level_runs l
        LEFT JOIN basin_hours h ON h.basin = l.basin AND h.hour_idx BETWEEN epoch_us(l.start) // 3600000000 AND epoch_us(l."end") // 3600000000
        WHERE epoch_us(l."end") - epoch_us(l.start) >= 6 * 3600000000 GROUP BY ALL""",
    "checked": """SELECT p.*, j.reading_id IS NULL AS out_of_range, j.jump, p.battery_mv < 3450 AS low_battery,
        EXISTS (SELECT 1 FROM long_runs f WHERE f.basin = p.basin AND f.node = p.node AND f.rain_mm > 0 AND p.ts BETWEEN f.start AND f."end") AS frozen
        FROM packets p LEFT JOIN jumps j ON p.reading_id = j.reading_id""",
    "valid": "SELECT * FROM checked WHERE NOT out_of_range AND NOT frozen AND (jump IS NULL OR jump = 'confirmed')",
    "slots": f"""SELECT basin, node, {SLOT} AS slot, max(level_cm) AS level_cm, max(turbidity) AS turbidity, sum(tips) AS tips, count(*) AS n,
        sum(level_cm) AS level_sum FROM valid GROUP BY ALL""",
    "based": """SELECT *, quantile_cont(level_cm, 0.1) OVER (PARTITION BY basin, node ORDER BY slot RANGE BETWEEN 2015 PRECEDING AND CURRENT ROW) AS h_base,
        quantile_cont(turbidity, 0.5) OVER (PARTITION BY basin, node ORDER BY slot RANGE BETWEEN 287 PRECEDING AND CURRENT ROW) AS turb_base FROM slots""",
    "relative": "SELECT *, level_cm - h_base AS h_rel, turbidity / turb_base AS turb_rel FROM based",
    "levels": """SELECT b.*, (b.h_rel - q.h_rel) * 4 AS dh_15min, b.h_rel - o.h_rel AS dh_1h,
        max(b.h_rel) OVER w AS h_max_1h, sum(b.tips) OVER w * 1.5::DOUBLE AS rain_1h FROM relative b
        LEFT JOIN relative q ON q.basin = b.basin AND q.node = b.node AND q.slot = b.slot - 3
        LEFT JOIN relative o ON o.basin = b.basin AND o.node = b.node AND o.slot = b.slot - 12
        WINDOW w AS (PARTITION BY b.basin, b.node ORDER BY b.slot RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "critical": "SELECT *, h_rel >= 60 OR coalesce(dh_15min >= 80, false) AS c FROM levels",
    "sent": """SELECT basin, slot, 'nivel:' || node AS source FROM (
          SELECT *, lag(c) OVER (PARTITION BY basin, node ORDER BY slot) AS before FROM critical) WHERE c AND before
        UNION ALL SELECT basin, slot, 'turbidez:' || node FROM critical WHERE turb_rel >= 3
        UNION ALL SELECT basin, slot, 'lluvia_local' FROM critical WHERE node = 'N0' AND rain_1h >= 6""",
    "held_inputs": """SELECT basin, slot + unnest(range(6)) AS slot, source, NULL::DOUBLE AS h_rel, NULL::DOUBLE AS p FROM sent
        UNION ALL SELECT basin, slot + unnest(range(3)), NULL, h_rel, NULL FROM levels
        UNION ALL SELECT basin, hour_idx * 12 + unnest(range(12)), NULL, NULL, proba_alerta FROM log""",
    "grouped": """SELECT basin, slot, list_sort(coalesce(list(DISTINCT source) FILTER (source IS NOT NULL), [])) AS sources, max(p) AS p, max(h_rel) AS h_rel,
        count(h_rel) = 0 AS degraded FROM held_inputs GROUP BY ALL""",
    "counted": """SELECT *, len(sources) + CASE WHEN coalesce(p >= 0.7, false) THEN 1 ELSE 0 END AS number,
        len(list_filter(sources, lambda s: s LIKE 'nivel:%' OR s LIKE 'turbidez%')) > 0 AS in_channel FROM grouped""",
    "fused": """SELECT basin, slot, sources, p, h_rel, degraded, CASE WHEN degraded THEN CASE WHEN p IS NULL THEN NULL WHEN p >= 0.7 THEN 'ALERTA'
            WHEN p >= 0.3 THEN 'PRECAUCIÓN' ELSE 'NORMAL' END
          WHEN number >= 2 AND in_channel THEN 'ALERTA' WHEN number >= 1 OR coalesce(p >= 0.3, false) THEN 'PRECAUCIÓN' ELSE 'NORMAL' END AS estado
        FROM counted""",
    "with_pauses": """SELECT basin, slot, sources, p, h_rel, degraded, estado FROM fused UNION ALL
        SELECT basin, slot + 6, [], NULL, NULL, true, NULL FROM (
          SELECT basin, slot, lead(slot) OVER (PARTITION BY basin ORDER BY slot) AS after, (SELECT max(slot) FROM fused) AS last FROM fused)
        WHERE after - slot > 6 OR (after IS NULL AND slot + 6 <= last)""",
    # In order: an entry into red, a row that lets go, neither; the last of the first two decides.
    "states": """SELECT *, CASE last_value(CASE WHEN estado = 'ALERTA' THEN 1
            WHEN len(sources) = 0 AND NOT coalesce(p >= 0.7, false) AND (degraded OR coalesce(h_rel < 45, false)) THEN 0 END IGNORE NULLS)
          OVER (PARTITION BY basin ORDER BY slot) WHEN 1 THEN 'ALERTA' ELSE estado END AS held FROM with_pauses""",
}
TIME = "TIMESTAMP '1970-01-01 00:00:00' + to_minutes(CAST({} * 5 AS INTEGER))"


def _sql(body: str, last: str, **extra: str) -> str:
    names = list(CTES)
    own = {n: CTES[n] for n in names[: names.index(last) + 1]}
    return with_ctes(body, "basin_hours", "log", **own, **extra)


def _rain(spark, sf_dir):
    return basin_hours(station_hours(gauges.readings(spark, sf_dir)))


def _checked(spark, sf_dir, rain=None):
    rain = staged(_rain(spark, sf_dir), "rain") if rain is None else rain
    return field.quality_checked(nodes.readings(spark, sf_dir), nodes.node_meta(spark), rain)


# The tables that a running system keeps: five-minute slots, derived levels, fused states. ``rain`` is given where a query needs it too.
def _slots(spark, sf_dir, rain=None):
    return staged(field.slots(_checked(spark, sf_dir, rain).filter("valid")), "slots")


def _levels(spark, sf_dir, rain=None):
    return staged(field.level_features(_slots(spark, sf_dir, rain)), "levels")


def _fusion(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    log = scored_rows(spark, sf_dir)
    signals = staged(field.signals(levels), "signals")  # few rows, read by both aggregations
    return levels, staged(field.fused(field.fusion_inputs(signals, levels, log)), "fused")


def _timed(df, *slots: str):
    return df.withColumns({s: field.slot_time(F.col(s)) for s in slots})


@query("node_reading_flags", "", _sql(
    "SELECT basin, node, reading_id, out_of_range, jump, frozen, low_battery, NOT out_of_range AND NOT frozen AND (jump IS NULL OR jump = 'confirmed') AS valid FROM checked",
    "checked"))
def node_reading_flags(spark, sf_dir):
    return _checked(spark, sf_dir).select("basin", "node", "reading_id", "out_of_range", "jump", "frozen", "low_battery", "valid")


@query("node_jumps", "", _sql("SELECT basin, node, ts, jump FROM jumps WHERE jump IS NOT NULL", "jumps"))
def node_jumps(spark, sf_dir):
    """Steps faster than the water, and what the next reading makes of them."""
    inside = field.out_of_range(nodes.readings(spark, sf_dir), nodes.node_meta(spark)).filter("NOT out_of_range")
    return field.jumps(inside).filter("jump IS NOT NULL").select("basin", "node", "ts", "jump")


@query("node_frozen_runs", "", _sql(
    f'SELECT basin, node, level_cm, start, "end", n, {r("rain_mm")} AS rain_mm, rain_mm > 0 AS frozen FROM long_runs', "long_runs"))
def node_frozen_runs(spark, sf_dir):
    return r6(field.frozen_runs(nodes.readings(spark, sf_dir), _rain(spark, sf_dir)))


SILENCE_SQL = with_ctes(
    """SELECT basin, node, ts + INTERVAL 15 MINUTE AS silent_from, next AS silent_until FROM (
         SELECT *, lead(ts) OVER (PARTITION BY basin, node ORDER BY ts) AS next, (SELECT max(ts) FROM packets) AS last FROM packets)
       WHERE next - ts > INTERVAL 15 MINUTE OR (next IS NULL AND ts + INTERVAL 15 MINUTE < last)""", packets=CTES["packets"])


@query("node_silences", "", SILENCE_SQL)
def node_silences(spark, sf_dir):
    return field.silences(nodes.readings(spark, sf_dir))


@query("node_packet_counts", "", with_ctes(
    f"""SELECT basin, node, CAST(ts AS DATE) AS day, count(*) AS packets, count(*) FILTER (ahead = 0) AS resent,
          CAST(sum(CASE WHEN ahead IS NULL OR ahead = 0 THEN 0 ELSE ahead - 1 END) AS BIGINT) AS lost
        FROM (SELECT *, {SLOT} - lag({SLOT}) OVER {NW} AS ahead FROM packets) GROUP BY ALL""", packets=CTES["packets"]))
def node_packet_counts(spark, sf_dir):
    """Lost packets from numbers of one byte; the SQL counts the slots themselves."""
    return field.packet_counts(nodes.readings(spark, sf_dir))


@query("node_slots", "", _sql(
    f"SELECT basin, node, {TIME.format('slot')} AS slot, level_cm, turbidity, CAST(tips AS BIGINT) AS tips, n FROM slots", "slots"))
def node_slots(spark, sf_dir):
    return _timed(_slots(spark, sf_dir).drop("level_sum"), "slot")


@query("node_hours", "", _sql(
    f"""SELECT basin, node, {stamp('hour_idx')} AS hour, {r('level_mean')} AS level_mean, level_max, turbidity, {r('rain_mm')} AS rain_mm, n, slots_with_data
        FROM (SELECT basin, node, {H} AS hour_idx, avg(level_cm) AS level_mean, max(level_cm) AS level_max, max(turbidity) AS turbidity,
          sum(tips) * 1.5::DOUBLE AS rain_mm, count(*) AS n, count(DISTINCT {SLOT}) AS slots_with_data FROM valid GROUP BY ALL)""", "valid"))
def node_hours(spark, sf_dir):
    """The hour made of five-minute partials, not of the readings again."""
    hours = field.node_hours(_slots(spark, sf_dir))
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.col("hour_idx").cast("int"))
    return r6(hours.withColumn("hour", at).drop("hour_idx"))


@query("node_level_features", "", _sql(
    f"""SELECT basin, node, {TIME.format('slot')} AS slot, {r('h_base')} AS h_base, {r('h_rel')} AS h_rel, {r('dh_15min')} AS dh_15min,
        {r('dh_1h')} AS dh_1h, {r('h_max_1h')} AS h_max_1h, {r('turb_rel')} AS turb_rel FROM levels""", "levels"))
def node_level_features(spark, sf_dir):
    """Level over the 10th percentile of seven days, its changes, turbidity over the median of a day."""
    cols = ["h_base", "h_rel", "dh_15min", "dh_1h", "h_max_1h", "turb_rel"]
    return r6(_timed(_levels(spark, sf_dir).select("basin", "node", "slot", *cols), "slot"))


@query("critical_signals", "", _sql(f"SELECT DISTINCT basin, {TIME.format('slot')} AS slot, source FROM sent", "sent"))
def critical_signals(spark, sf_dir):
    return _timed(field.signals(_levels(spark, sf_dir)).distinct(), "slot")


@query("incoherent_rises", "", _sql(
    f"""SELECT basin, node, {stamp('hour_idx')} AS hour, {r('rise_cm')} AS rise_cm FROM risen x WHERE node <> 'N0'
        AND NOT EXISTS (SELECT 1 FROM risen u WHERE u.basin = x.basin AND u.node < x.node AND u.hour_idx BETWEEN x.hour_idx - 3 AND x.hour_idx)
        AND NOT EXISTS (SELECT 1 FROM basin_hours h WHERE h.basin = x.basin AND h.P_basin > 0 AND h.hour_idx BETWEEN x.hour_idx - 3 AND x.hour_idx)""",
    "levels", risen="""SELECT basin, node, slot // 12 AS hour_idx, max(h_rel) - min(h_rel) AS rise_cm FROM levels GROUP BY ALL HAVING max(h_rel) - min(h_rel) >= 20"""))
def incoherent_rises(spark, sf_dir):
    """Nodes that rise while nothing upstream does and no rain falls (the channel is N0, N1, N2)."""
    rain = staged(_rain(spark, sf_dir), "rain")
    found = field.incoherent_rises(_levels(spark, sf_dir, rain), rain, nodes.node_meta(spark))
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.col("hour_idx").cast("int"))
    return r6(found.withColumn("hour", at).drop("hour_idx"))


@query("fused_states", "", _sql(
    f"""SELECT basin, {TIME.format('slot')} AS slot, array_to_string(sources, ',') AS sources, {r('p')} AS p, {r('h_rel')} AS h_rel, degraded, estado,
        coalesce(p >= 0.7 AND estado = 'PRECAUCIÓN', false) AS forecast_only FROM fused""", "fused"))
def fused_states(spark, sf_dir):
    """Forecast and critical signals of half an hour, from distinct sources, on five-minute slots."""
    rows = _fusion(spark, sf_dir)[1].withColumn("sources", F.array_join("sources", ","))
    return r6(_timed(rows, "slot"))


@query("held_states", "", _sql(f"SELECT basin, {TIME.format('slot')} AS slot, estado, held FROM states", "states"))
def held_states(spark, sf_dir):
    """The fused state with hysteresis: red stays until nothing is critical and the water is down."""
    rows = field.with_hysteresis(_fusion(spark, sf_dir)[1]).select("basin", "slot", "estado", "held")
    return _timed(rows, "slot")


def _episode_sql(source: str) -> str:
    new = f"coalesce(slot - lag(slot) OVER (PARTITION BY basin ORDER BY slot) > {EPISODE_GAP}, true)"
    return _islands(source, "basin", "slot", new, 'min(slot) AS start, max(slot) AS "end"')


def _pairs_sql(warnings: str) -> str:
    near = f'flood_episodes f JOIN {warnings} w ON f.basin = w.basin AND w.start <= f.start AND f.start <= w."end" + {LEAD_SLOTS}'
    return f"""SELECT a.basin, (a.flood - a.warning) * 5 AS lead FROM
        (SELECT f.basin, f.start AS flood, min(w.start) AS warning FROM {near} GROUP BY ALL) a JOIN
        (SELECT f.basin, min(f.start) AS flood, w.start AS warning FROM {near} GROUP BY f.basin, w.start) b USING (basin, flood, warning)"""


@query("flood_event_metrics", "", _sql(
    f"""SELECT s.basin, coalesce(floods, 0) AS floods, coalesce(red_warnings, 0) AS red_warnings, coalesce(y.n, 0) AS yellow_detected,
          y.lead AS yellow_lead_minutes, coalesce(x.n, 0) AS red_detected, x.lead AS red_lead_minutes,
          coalesce(floods, 0) - coalesce(y.n, 0) AS yellow_missed, coalesce(floods, 0) - coalesce(x.n, 0) AS red_missed,
          {r('30.0::DOUBLE * (coalesce(red_warnings, 0) - coalesce(x.n, 0)) / days')} AS false_reds_per_month
        FROM (SELECT basin, (max("end") - min(start) + 1) / 288.0::DOUBLE AS days FROM (SELECT * FROM flood_episodes UNION ALL SELECT * FROM reds
          UNION ALL SELECT * FROM yellows) GROUP BY basin) s
        LEFT JOIN (SELECT basin, count(*) AS floods FROM flood_episodes GROUP BY basin) f USING (basin)
        LEFT JOIN (SELECT basin, count(*) AS red_warnings FROM reds GROUP BY basin) w USING (basin)
        LEFT JOIN (SELECT basin, count(*) AS n, quantile_cont(lead, 0.5) AS lead FROM yellow_pairs GROUP BY basin) y USING (basin)
        LEFT JOIN (SELECT basin, count(*) AS n, quantile_cont(lead, 0.5) AS lead FROM red_pairs GROUP BY basin) x USING (basin)""",
    "states", flood_slots=f"SELECT DISTINCT basin, slot FROM levels WHERE h_rel >= {FLOOD_CM}", flood_episodes=_episode_sql("flood_slots"),
    red_slots="SELECT basin, slot FROM states WHERE held = 'ALERTA'", reds=_episode_sql("red_slots"),
    yellow_slots="SELECT basin, slot FROM states WHERE held IN ('ALERTA', 'PRECAUCIÓN')", yellows=_episode_sql("yellow_slots"),
    yellow_pairs=_pairs_sql("yellows"), red_pairs=_pairs_sql("reds")))
def flood_event_metrics(spark, sf_dir):
    """Floods (water over the limit) against warnings, one to one."""
    features, fused = _fusion(spark, sf_dir)
    held = staged(field.with_hysteresis(fused), "held")
    floods = staged(field.episodes(features.filter(F.col("h_rel") >= FLOOD_CM).select("basin", "slot").distinct(), EPISODE_GAP), "floods")
    red = staged(field.episodes(held.filter(F.col("held") == rules.STATES[2]), EPISODE_GAP), "reds")
    yellow = staged(field.episodes(held.filter(F.col("held").isin(rules.STATES[1:])), EPISODE_GAP), "yellows")
    return r6(field.event_metrics(floods, yellow, red, LEAD_SLOTS))


ONSET_SQL = """SELECT basin, node, min(slot) AS slot FROM (SELECT *, count(*) FILTER (_new) OVER (PARTITION BY basin, node ORDER BY slot) AS _run FROM (
    SELECT basin, node, slot, coalesce(slot - lag(slot) OVER (PARTITION BY basin, node ORDER BY slot) > 36, true) AS _new FROM levels WHERE h_rel >= 20))
    GROUP BY basin, node, _run"""
OBSERVED_SQL = """SELECT o.basin, count(*) AS onsets, median(P_acc_24h) AS ia_mm, 25400.0::DOUBLE / (254.0::DOUBLE + 5.0::DOUBLE * median(P_acc_24h)) AS cn
    FROM onsets o JOIN proxy p ON p.basin = o.basin AND p.hour_idx = o.slot // 12 WHERE o.node = 'N0' AND P_acc_24h > 0 GROUP BY o.basin"""


def _observed_sql(body: str) -> str:
    names = list(CTES)
    own = {n: CTES[n] for n in names[: names.index("levels") + 1]}
    return with_ctes(body, "basin_hours", "proxy", **own, onsets=ONSET_SQL, observed=OBSERVED_SQL)


def _observed(spark, sf_dir, rain):
    """Numbers from the onsets and the same rain that the readings are checked against."""
    fallen = with_runoff(complete_grid(rain))
    return staged(field.observed_curve_numbers(field.onsets(_levels(spark, sf_dir, rain)), fallen), "observed")


@query("observed_curve_numbers", "", _observed_sql(f"SELECT basin, onsets, {r('ia_mm')} AS ia_mm, {r('cn')} AS cn FROM observed"))
def observed_curve_numbers(spark, sf_dir):
    """Curve number per basin from the rain that had fallen when the level began to respond."""
    return r6(_observed(spark, sf_dir, staged(_rain(spark, sf_dir), "rain")))


@query("runoff_by_observed_curve_number", "", _observed_sql(
    f"""SELECT basin, timestamp, {r('P_acc_24h')} AS P_acc_24h, {r("CASE WHEN P_acc_24h IS NULL THEN NULL WHEN P_acc_24h <= 0.2::DOUBLE * s THEN 0.0::DOUBLE "
      "ELSE (P_acc_24h - 0.2::DOUBLE * s) ** 2 / (P_acc_24h - 0.2::DOUBLE * s + s) END")} AS Q_scs_proxy
      FROM (SELECT p.*, 25400.0::DOUBLE / coalesce(cn, 81.1::DOUBLE) - 254.0::DOUBLE AS s FROM proxy p LEFT JOIN observed USING (basin))"""))
def runoff_by_observed_curve_number(spark, sf_dir):
    """The runoff series rebuilt with the observed numbers (basins without an onset keep the default)."""
    rain = staged(_rain(spark, sf_dir), "rain")  # readings to hours once, for the checks, the onsets and the series
    numbers = _observed(spark, sf_dir, rain).select("basin", "cn")
    built = timestamped(with_runoff(complete_grid(rain), numbers))
    return r6(built.select("basin", "timestamp", "P_acc_24h", "Q_scs_proxy"))


def _packet_stream(spark, sf_dir):
    """The events table as a file stream of packets."""
    raw = spark.readStream.schema(gauges.events(spark, sf_dir).schema).parquet(f"{sf_dir}/event[s].parquet")
    return nodes.from_events(raw)


def _drained(spark, out, schema: str):
    """What a stream gives over everything available, from the table its micro-batches are written to."""
    root = shared_folder(spark, "field")
    with live.keyed_state(spark):
        out.writeStream.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out/batch={i}")).start().awaitTermination()
    return read(spark, f"{root}/out", f"{schema}, batch int").drop("batch")


@query("streamed_node_silences", "", with_ctes(
    """SELECT basin, node, ts + INTERVAL 15 MINUTE AS silent_from FROM (
         SELECT *, lead(ts) OVER (PARTITION BY basin, node ORDER BY ts) AS next, (SELECT max(ts) FROM packets) AS last FROM packets)
       WHERE (next IS NULL OR next - ts > INTERVAL 15 MINUTE) AND epoch_us(ts) + 900000001 <= (epoch_ms(last) - 1800000) * 1000""",
    packets=CTES["packets"]))
def streamed_node_silences(spark, sf_dir):
    """Session windows: a silence is told by the watermark, without a further reading of the node."""
    return _drained(spark, live.silences(_packet_stream(spark, sf_dir)), "basin string, node string, silent_from timestamp_ntz")


@query("streamed_node_jumps", "", _sql(
    """SELECT basin, node, ts, jump FROM (SELECT *, lead(ts) OVER (PARTITION BY basin, node ORDER BY ts, reading_id) AS next FROM jumps)
       WHERE next IS NOT NULL AND jump IS NOT NULL""", "jumps"))
def streamed_node_jumps(spark, sf_dir):
    """Keyed state: the last reading of a node waits for the next one."""
    inside = field.out_of_range(_packet_stream(spark, sf_dir), nodes.node_meta(spark)).filter("NOT out_of_range")
    schema = "basin string, node string, reading_id bigint, ts timestamp_ntz, level_cm int, jump string"
    return _drained(spark, live.jumps(inside), schema).filter("jump IS NOT NULL").select("basin", "node", "ts", "jump")


def _streamed_states_sql() -> str:
    own = dict(CTES)
    # The timer of a basin's last slot fires once the watermark, half an hour behind the last slot of all, has passed it.
    own["with_pauses"] = own["with_pauses"].replace("slot + 6 <= last", "slot + 12 <= last")
    return with_ctes(f"SELECT basin, {TIME.format('slot')} AS slot, estado, held FROM states", "basin_hours", "log", **own)


@query("streamed_held_states", "", _streamed_states_sql())
def streamed_held_states(spark, sf_dir):
    """Hysteresis as a keyed state machine with event-time timers over the fused slots."""
    path = shared_folder(spark, "fused_slots")
    fused = _fusion(spark, sf_dir)[1]
    fused.write.parquet(path)
    out = live.with_hysteresis(spark.readStream.schema(fused.schema).parquet(path))
    return _timed(_drained(spark, out, "basin string, slot bigint, estado string, held string"), "slot")
