import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.functions import rules
from freshet.plans import diagnostics, evaluation, events, reporting, scenarios, spatial
from freshet.sources import catalogue


def log_of(spark, rows):
    return spark.createDataFrame(rows, "basin string, t string, estado string, proba_alerta double").withColumn(
        "timestamp", F.col("t").cast("timestamp_ntz")
    )


def test_calendar_shows_missing_days_and_the_worst_state(spark):
    log = log_of(spark, [
        ("b", "2026-10-01 10:00:00", "NORMAL", 0.1), ("b", "2026-10-03 10:00:00", "ALERTA", 0.9),
        ("b", "2026-10-03 11:00:00", "NORMAL", 0.1),
    ])
    rows = {str(r.dia): r.etiqueta for r in reporting.calendar(log, days=3).collect()}
    assert rows == {"2026-10-01": "Sin alerta", "2026-10-02": "Sin datos", "2026-10-03": "Alerta roja"}
    assert [str(r.dia) for r in reporting.missing_days(log, 3).collect()] == ["2026-10-02"]
    assert reporting.missing_days(log, 90).count() == 88


def test_trailing_totals_grow_and_include_both_ends(spark):
    series = spark.range(24 * 40).select(
        F.lit("b").alias("basin"), F.col("id").alias("hour_idx"), F.lit(1.0).alias("P_basin"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("timestamp"),
    )
    r = reporting.trailing_rain(series).first()
    assert (r.ult_24h, r.ult_7d, r.ult_30d) == (25.0, 169.0, 721.0)
    assert 0 <= r.ult_24h <= r.ult_7d <= r.ult_30d and str(r.ref_fecha) == "2024-02-09"


def test_display_names(spark):
    log = log_of(spark, [("b", "2026-10-01 10:00:00", "PRECAUCIÓN", 0.345)]).drop("t")
    shown = reporting.display_names(reporting.recent_log(log))
    assert "Estado de alerta" in shown.columns
    row = shown.first()
    assert row["Estado de alerta"] == "Precaución" and row["Probabilidad de riesgo"] in (0.34, 0.35)


def scenario(spark, *values):
    df = spark.createDataFrame([tuple(float(v) for v in values)], ", ".join(f"{c} double" for c in scenarios.INPUTS))
    return scenarios.scenario_features(df, F.lit(14), F.lit(10)).first()


def scs(p):
    s = 25400 / 81.1 - 254
    x = p - 0.2 * s
    return 0.0 if x <= 0 else x * x / (x + s)


def test_scenario_features(spark):
    x = scenario(spark, 2, 6, 12, 18, 30, 54)
    assert not x.ajustado and [c for c in x.asDict() if c in S.FEATURES] == list(S.FEATURES)
    assert x.roll_sum_24h == 30 and x.P_basin == 2
    assert x.lag_1h == pytest.approx(2) and x.lag_24h == pytest.approx(1)
    assert x.Q_actual == pytest.approx(scs(30))
    assert x.Q_lag_3h == pytest.approx(scs(30 - 6 + 24 * 3 / 24))
    assert (x.hora_dia, x.mes) == (14, 10)


def test_scenario_accumulations_are_adjusted(spark):
    x = scenario(spark, 10, 5, 5, 5, 5, 5)
    assert x.ajustado
    assert {x.roll_sum_3h, x.roll_sum_6h, x.roll_sum_12h, x.roll_sum_24h, x.roll_sum_48h} == {10.0}
    y = scenario(spark, 5, 5, 30, 10, 10, 10)
    assert y.ajustado and y.roll_sum_12h == 30 and y.roll_sum_48h == 30


def test_dry_scenarios_never_warn(spark):
    df = spark.createDataFrame([tuple([0.0] * 6)], ", ".join(f"{c} double" for c in scenarios.INPUTS))
    year = scenarios.over_the_year(df)
    assert year.count() == 288
    features = scenarios.scenario_features(year, F.col("hora_dia"), F.col("mes"))
    out = scenarios.scored_scenarios(features, lambda d: d.withColumn("proba_modelo", F.lit(0.8)))
    r = out.agg(F.max("proba_alerta").alias("p"), F.count_if("regla_cambia").alias("n")).first()
    assert r.p == rules.DRY_PROBABILITY_CAP and r.n == 288


ANCHORS = [(6.2804, -75.5027), (6.2694, -75.5648), (6.2781, -75.5670)]


def test_route_points(spark):
    pts = spark.createDataFrame([("r", i, *p) for i, p in enumerate(ANCHORS)], "route string, ord int, lat double, lon double")
    nodes = spatial.route_points(pts, 5).orderBy("node").collect()
    assert [n.node for n in nodes] == [1, 2, 3, 4, 5]
    assert (nodes[0].lat, nodes[0].lon) == ANCHORS[0]
    assert (nodes[-1].lat, nodes[-1].lon) == pytest.approx(ANCHORS[-1])
    steps = {round(b.pos - a.pos, 9) for a, b in zip(nodes, nodes[1:])}
    assert len(steps) == 1


def test_route_with_repeated_points(spark):
    pts = spark.createDataFrame([("r", 0, 6.0, -75.0), ("r", 1, 6.0, -75.0)], "route string, ord int, lat double, lon double")
    assert [(n.lat, n.lon) for n in spatial.route_points(pts, 3).collect()] == [(6.0, -75.0)] * 3


def test_event_verdicts_and_ties(spark):
    series = spark.range(200).select(
        F.lit("b").alias("basin"), (F.col("id") + 480_000).alias("hour_idx"), F.lit(0.0).alias("P_basin"),
        F.lit(None).cast("double").alias("P_acc_24h"),
        F.when(F.col("id") >= 5, F.col("id").cast("double")).alias("Q_scs_proxy"),
    )
    from freshet.operators.series import timestamped

    series = timestamped(series)
    base = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 480000"
    ev = spark.sql(f"""SELECT 'b' basin, 'tie' event_id, {base} + 100, 30) event_ts
        UNION ALL SELECT 'b', 'high', {base} + 199) UNION ALL SELECT 'b', 'unknown', {base} + 2)
        UNION ALL SELECT 'b', 'outside', {base} + 900) UNION ALL SELECT 'c', 'no basin', {base})""")
    out = {r.event_id: r for r in events.verdicts(series, ev, ["basin"]).collect()}
    assert out["tie"].hour_idx == 480_100
    assert out["tie"].percentile == pytest.approx(100 * 96 / 195) and out["tie"].red_flag
    assert out["high"].percentile == 100 and out["high"].red_flag is False
    assert out["unknown"].percentile is None and out["unknown"].red_flag
    assert out["outside"].red_flag is None and out["no basin"].timestamp is None
    win = events.windows(series, ev.filter("event_id = 'tie'"), ["basin"])
    assert win.agg(F.min("hour_idx"), F.max("hour_idx")).first() == (480_053, 480_148)


def test_percentile_of_a_value(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "q double")
    def at(v):
        return df.agg(events.percentile_of(F.col("q"), F.lit(v).cast("double"))).first()[0]
    assert at(2.0) == pytest.approx(200 / 3) and at(None) is None
    assert df.filter("q > 9").agg(events.percentile_of(F.col("q"), F.lit(1.0))).first()[0] is None


def scored(spark, rows):
    return spark.createDataFrame(rows, "basin string, label int, p double")


def test_thresholds_are_reached_at_their_value_and_zero_divisions_are_zero(spark):
    df = scored(spark, [("b", 1, 0.5), ("b", 0, 0.3), ("b", 1, 0.05)])
    t = {r.umbral: r for r in evaluation.threshold_table(df, [0.5, 0.3, 0.9], ["p"], ["basin"]).collect()}
    assert (t[0.5].tp, t[0.5].fp, t[0.5].fn) == (1, 0, 1)
    assert (t[0.3].tp, t[0.3].fp) == (1, 1)
    assert (t[0.9].recall, t[0.9].precision, t[0.9].f1) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("rows, want, reaches", [
    ([(0.5, 0.9), (0.2, 0.95), (0.1, 0.95)], 0.1, True),
    ([(0.5, 0.2), (0.2, 0.8), (0.1, 0.8)], 0.1, False),
])
def test_recommended_threshold(spark, rows, want, reaches):
    t = spark.createDataFrame([("b", *r) for r in rows], "basin string, umbral double, recall double")
    r = evaluation.recommended_threshold(t, ["basin"]).first()
    assert (r.umbral, r.reaches_target) == (want, reaches)


def test_regression_metrics_edge_cases(spark):
    rows = [("b", "test", y, y, 0.0, 10.0) for y in (0.0, 0.0, 0.0)] + [("c", "test", 1.0, 1.0, 2.0, 10.0)]
    df = spark.createDataFrame(rows, "basin string, split string, y double, model double, base double, p75_train double")
    out = {(r.basin, r.subset): r for r in evaluation.regression_report(df, "y", "base", "model", ["basin"]).collect()}
    assert out["b", "all"].model_r2 == 1.0          # constant target, perfect
    assert out["b", "target > 0"].n == 0 and out["b", "target > 0"].model_mae is None
    assert out["b", "target > 0"].beats is None
    assert out["c", "all"].model_r2 is None         # one row
    worse = df.filter("basin = 'b'").withColumn("model", F.lit(1.0))
    assert evaluation.regression_report(worse, "y", "base", "model", ["basin"]).filter("subset = 'all'").first().model_r2 == 0.0


def test_persistence_must_cover_every_row(spark):
    ds = spark.createDataFrame([("b", 1), ("b", 2)], "basin string, hour_idx bigint")
    series = spark.createDataFrame([("b", 1, 0.5), ("b", 2, None)], "basin string, hour_idx bigint, Q_scs_proxy double")
    with pytest.raises(Exception, match="persistence baseline"):
        evaluation.with_persistence(ds, series, ["basin"]).collect()


def test_split_sides_need_rows(spark):
    with pytest.raises(ValueError):
        evaluation.split_sides(spark.createDataFrame([("train",)], "split string"))


def test_label_uses_the_train_quantile_strictly(spark):
    rows = [("b", "train", float(i)) for i in range(11)] + [("b", "test", 9.0), ("b", "test", 9.5)]
    df = spark.createDataFrame(rows, "basin string, split string, y double")
    out = evaluation.with_label(df, "y", ["basin"]).filter("split = 'test'").collect()
    assert [r.train_quantile for r in out] == [9.0, 9.0] and sorted(r.label for r in out) == [0, 1]


def test_weights(spark):
    rows = [("b", "train", 0.0, 0.0), ("b", "train", 2.0, 0.5), ("c", "train", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "basin string, split string, y double, Q_actual double")
    out = {(r.basin, r.y): r for r in evaluation.with_sample_weights(df, "y", ["basin"]).collect()}
    assert out["b", 0.0].sample_weight == 1 and out["b", 2.0].sample_weight == 21 and out["b", 2.0].delta == 1.5
    assert out["c", 0.0].sample_weight is None


def steps_of(spark, micros):
    return spark.createDataFrame([("s", m, "240", 1.5) for m in micros], "station_id string, m bigint, sensor_id string, mm double").withColumn(
        "ts", F.timestamp_micros("m").cast("timestamp_ntz")
    ).drop("m")


def test_steps_across_days_and_copies(spark):
    """Brute force over one sorted list, with a third of all readings at one time."""
    import random
    from collections import Counter
    from statistics import median

    rng = random.Random(5)
    times = [rng.randrange(5 * 86_400) * 1_000_000 for _ in range(300)] + [200_000 * 1_000_000] * 150
    s = sorted(times)
    diffs = [(b - a) / 1e6 for a, b in zip(s, s[1:])]
    df = steps_of(spark, times)
    got = {r.step_s: r.n for r in diagnostics.step_counts(df, ["station_id"]).collect()}
    assert got == dict(Counter(diffs))
    profile = diagnostics.raw_profile(df, ["station_id"]).first()
    assert profile.median_step_s == pytest.approx(median(diffs)) and profile.n_rows == 450
    top = diagnostics.commonest_steps(diagnostics.step_counts(df, ["station_id"]), ["station_id"], 3).orderBy("rank").collect()
    want = sorted(Counter(diffs).items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [(r.step_s, r.n) for r in top] == want


def test_sensor_breakdown_counts_unknown_as_a_sensor(spark):
    df = spark.createDataFrame([("a", "240"), ("a", None), ("b", "240")], "station_id string, sensor_id string")
    assert {(r.station_id, r.sensor_id, r.n) for r in diagnostics.sensor_breakdown(df, ["station_id"]).collect()} == {
        ("a", "240", 1), ("a", None, 1)
    }


def test_catalogue_locations_and_missing_coordinates(spark):
    rows = spark.sql("""SELECT '1' codigo, ' Medellín ' municipio, '6.2' latitud, '-75.5' longitud,
          named_struct('latitude', '9', 'longitude', '9') ubicaci_n
        UNION ALL SELECT '2', 'BELLO', NULL, NULL, named_struct('latitude', '6.3', 'longitude', '-75.6')
        UNION ALL SELECT '3', 'Bello', NULL, NULL, NULL UNION ALL SELECT '4', 'Cali', '3.4', '-76.5', NULL""")
    from freshet.functions.text import VALLEY_MUNICIPALITIES

    near = catalogue.nearest(rows, 6.271, -75.564, VALLEY_MUNICIPALITIES).collect()
    assert [r.codigo for r in near] == ["2", "1"]
    assert (near[1].lat, near[1].lon) == (6.2, -75.5) and "nombre" not in near[0].asDict()
    la, lo, r = math.radians(6.3), math.radians(-75.6), 6371.0
    a = math.sin((la - math.radians(6.271)) / 2) ** 2 + math.cos(la) * math.cos(math.radians(6.271)) * math.sin((lo - math.radians(-75.564)) / 2) ** 2
    assert near[0].distancia_km == pytest.approx(2 * r * math.asin(math.sqrt(a)))


def test_catalogue_scan_filters_at_the_source(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"codigo":"1","departamento":"Antioquia","ubicaci_n":{"latitude":"6.2","longitude":"-75.5"}}\n'
        '{"codigo":"2","departamento":"Huila"}\n'
    )
    df = catalogue.scan(spark, str(tmp_path), "Antioquia")
    assert [r.codigo for r in df.collect()] == ["1"]
    assert "PushedFilters: [IsNotNull(departamento), EqualTo(departamento,Antioquia)]" in df._jdf.queryExecution().executedPlan().toString()
    assert catalogue.located(df).first().lat == 6.2


def test_unexplained_months(spark):
    days = ("2019-01-01", "2019-02-01", "2019-07-01", "2019-08-01", "2020-04-01")
    months = spark.createDataFrame([(b, date.fromisoformat(m), 5, 0) for b in "AB" for m in days], "basin string, month date, n0 bigint, n1 bigint")
    columns = "basin string, start timestamp_ntz, end timestamp_ntz"
    outages = [("A", datetime(2019, 2, 18, 16), datetime(2019, 7, 26, 11)), ("A", datetime(2020, 3, 29), None), ("C", datetime(2000, 1, 1), None),
               ("B", datetime(2030, 1, 1), None), ("B", datetime(1990, 1, 1), datetime(1999, 1, 1))]
    left = diagnostics.unexplained_months(months, spark.createDataFrame(outages, columns), ["basin"])
    assert sorted(str(r.month) for r in left.filter("basin = 'A'").collect()) == ["2019-01-01", "2019-08-01"]
    assert left.filter("basin = 'B'").count() == 5
    # A thousand rows: the same plan, no nested loop.
    many = outages * 200
    plans = [diagnostics.unexplained_months(months, spark.createDataFrame(x, columns), ["basin"])._jdf.queryExecution() for x in (outages, many)]
    sizes = {len(q.optimizedPlan().toString().splitlines()) for q in plans}
    assert len(sizes) == 1 and "NestedLoop" not in plans[1].executedPlan().toString()


def test_last_days_of_a_stored_table_open_only_their_partitions(spark, tmp_path):
    """One basin: the key is a constant, and the join must still be one on the day."""
    hours = spark.range(24 * 200).select(
        F.lit("b").alias("basin"), (F.col("id") + 473_000).alias("hour_idx"), F.lit(1.0).alias("P_basin"),
        F.when(F.col("id") % 50 == 0, "ALERTA").otherwise("NORMAL").alias("estado"))
    hours = hours.withColumns({"timestamp": F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, cast(hour_idx as int))")})
    hours.withColumn("day", F.col("timestamp").cast("date")).write.partitionBy("day").parquet(path := str(tmp_path / "s"))
    stored = spark.read.parquet(path)
    last = spark.createDataFrame([("b", 473_000 + 24 * 200 - 1)], "basin string, hour_idx bigint")
    for report in (reporting.trailing_rain(stored, last=last), reporting.alert_days(stored, last=last)):
        report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "PartitionFilters: [day" in plan.replace("[isnotnull(day", "[day").replace("[cast(day", "[day")
        assert sum(m for m in [len(report.inputFiles())]) <= 31 * 8
    r = reporting.trailing_rain(stored, last=last).first()
    assert (r.ult_24h, r.ult_7d, r.ult_30d) == (25.0, 169.0, 721.0)
    assert reporting.trailing_rain(hours).first() == r


def test_pairs_need_complete_days(spark):
    rows = [("b", s, h, 1.5) for s in ("A", "C") for h in range(48) if not (s == "A" and h == 30)]
    st = spark.createDataFrame(rows, "basin string, station_id string, hour_idx bigint, mm double")
    pairs = spark.createDataFrame([("b", "A", "C")], "basin string, station_a string, station_b string")
    r = spatial.compare_pairs(st, pairs).first()
    assert (r.dias_lluvia_ambas, r.dias_supera_alguna, r.dias_supera_una_sola) == (1, 1, 0)
    assert r.correlacion_diaria is None and r.share_single == 0.0
