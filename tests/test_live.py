import pytest
from pyspark.sql import functions as F
from tests.conftest import MEDIUM

from freshet import schema as S
from freshet.operators import features, series
from freshet.functions import rules
from freshet.plans import evaluation, reporting, scenarios, training, update
from freshet.queries import base, models
from freshet.session import shared_folder
from freshet.sources import gauges, tables
from freshet.streaming import arrivals, hours, ingest, parity

KEYS = ["basin", "hour_idx"]


@pytest.fixture(scope="module")
def rows(spark):
    return gauges.readings(spark, MEDIUM).drop("tips").cache()


def expected_features(rows):
    return features.feature_rows(series.quality_split(series.runoff_series(rows))[0])


def test_stream_in_several_runs_equals_batch(spark, rows):
    """Three landings, one run each: state and checkpoint carry over, nothing is lost or doubled."""
    root = shared_folder(spark, "several")
    cuts = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    for lo, hi in zip(cuts, cuts[1:]):
        part = rows.filter(f"ts >= timestamp_ntz'{lo} 00:00:00' AND ts < timestamp_ntz'{hi} 00:00:00'")
        part.unionByName(part).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landing")
        hours.start(stream, root, base.score).awaitTermination()
    got = tables.read(spark, f"{root}/features", hours.FEATURES)
    last = rows.agg(F.max("ts")).first()[0]
    closed = F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 48 HOURS")
    want = expected_features(rows).filter(F.col("timestamp") + F.expr("INTERVAL 1 HOUR") <= closed)
    assert got.count() == want.count() == got.select(*KEYS).distinct().count()
    parity.require_parity(want, got, KEYS)
    # A replayed batch replaces its own rows.
    batch = got.agg(F.max("batch")).first()[0]
    before = tables.read(spark, f"{root}/log", hours.LOG).count()
    stations = series.station_hours(rows).join(
        tables.read(spark, f"{root}/hours", hours.HOURS).filter(F.col("batch") == batch).select(*KEYS), KEYS, "left_semi"
    )
    hours.process_batch(stations, batch, root, base.score)
    assert tables.read(spark, f"{root}/log", hours.LOG).count() == before


def test_stream_correction_replaces_the_reading(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("""SELECT 'b' basin, 'S0' station_id, '240' sensor_id, ts, mm, arrival FROM VALUES
        (timestamp_ntz'2024-01-01 00:10:00', 1.5D, 0), (timestamp_ntz'2024-01-01 00:10:00', 6.0D, 1),
        (timestamp_ntz'2024-01-01 00:20:00', 3.0D, 0), (timestamp_ntz'2024-01-09 00:00:00', 0.0D, 0)
        t(ts, mm, arrival)""").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = []
    q = hours.closed_station_hours(stream, arrival="arrival").writeStream.outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
        lambda df, i: out.extend(r.mm for r in df.collect())).start()
    q.awaitTermination()
    assert out == [9.0]


def test_parity_reports_each_kind(spark):
    base_df = spark.createDataFrame([("b", 1, 1.0, None), ("b", 2, 2.0, 2.0), ("b", 3, None, None)], "basin string, hour_idx int, x double, y double")
    other = spark.createDataFrame([("b", 1, 1.0 + 5e-7, None), ("b", 2, 2.1, None)], "basin string, hour_idx int, x double, y double")
    found = {(r.hour_idx, r.feature) for r in parity.mismatches(base_df, other, KEYS, ["x", "y"]).collect()}
    assert found == {(2, "x"), (2, "y"), (3, "missing")}


def test_seeded_sample_repeats(spark, rows):
    feats = expected_features(rows)
    a = {tuple(r) for r in parity.seeded_sample(feats, 50).select(*KEYS).collect()}
    b = {tuple(r) for r in parity.seeded_sample(feats.repartition(7), 50).select(*KEYS).collect()}
    assert a == b and len(a) == 50


def as_batch(rows):
    return rows.withColumn("arrival", F.lit(0).cast("long"))


def logs(spark, root):
    return tables.read(spark, f"{root}/log", S.LOG_TABLE).select("basin", *S.LOG_COLUMNS)


def test_live_update_by_slices_equals_one_build(spark, rows):
    root = shared_folder(spark, "slices")
    for end in ("2024-01-20 00:00:00", "2024-01-26 07:00:00", "2024-02-01 00:00:00"):
        summary = update.live_update(spark, as_batch(rows), root, base.score, end)
    assert summary.agg(F.sum("new_rows")).first()[0] > 0
    want = reporting.prediction_log(base.score(features.complete(expected_features(rows))))
    got = logs(spark, root)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    stored = tables.read(spark, f"{root}/series", S.SERIES_TABLE).select("basin", "hour_idx", "Q_scs_proxy")
    full = series.runoff_series(rows).select("basin", "hour_idx", "Q_scs_proxy")
    assert stored.exceptAll(full).count() == 0 and stored.count() == full.count()
    again = update.live_update(spark, as_batch(rows), root, base.score, "2024-02-01 00:00:00")
    assert again.agg(F.sum("new_rows")).first()[0] == 0


def test_curve_number_per_basin_in_build_update_and_stream(spark, rows):
    some = rows.filter("ts < timestamp_ntz'2024-01-12 00:00:00'").cache()
    basins = sorted(r[0] for r in some.select("basin").distinct().collect())
    numbers = dict(zip(basins, (60.0, 92.0)))  # the others have the default
    table = spark.createDataFrame(list(numbers.items()), "basin string, cn double")
    want = series.runoff_series(some, table).cache()
    for b in basins[:3]:
        alone = series.runoff_series(some.filter(F.col("basin") == b), numbers.get(b, 81.1))
        assert alone.exceptAll(want.select(alone.columns)).isEmpty()
    assert want.columns == series.runoff_series(some).columns

    root = shared_folder(spark, "numbers")
    cut = "timestamp_ntz'2024-01-09 00:00:00'"
    for part, now in ((f"ts < {cut}", "2024-01-09 00:00:00"), (f"ts >= {cut}", "2024-01-12 00:00:00")):
        update.live_update(spark, some.filter(part).withColumn("arrival", F.lit(0).cast("long")), root, base.score, now, cn=table)
    got = tables.read(spark, f"{root}/series", S.SERIES_TABLE)
    near = [c if t == "string" or c == "hour_idx" else F.round(c, 9).alias(c) for c, t in want.select(*KEYS, "P_acc_24h", "Q_scs_proxy").dtypes]
    assert got.count() == want.count() and got.select(near).exceptAll(want.select(near)).isEmpty()

    some.write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(some.schema).parquet(f"{root}/landing")
    hours.start(stream, f"{root}/stream", base.score, cn=table).awaitTermination()
    streamed = tables.read(spark, f"{root}/stream/features", hours.FEATURES)
    batch = features.feature_rows(series.quality_split(want)[0]).join(streamed.select(*KEYS), KEYS, "left_semi")
    assert streamed.count() > 0
    parity.require_parity(batch, streamed, KEYS)


def test_failed_parity_keeps_the_published_log(spark, rows, monkeypatch):
    root = shared_folder(spark, "gate")
    update.live_update(spark, as_batch(rows), root, base.score, "2024-01-20 00:00:00")
    before = {tuple(r) for r in logs(spark, root).collect()}

    def refuse(*_):
        raise parity.ParityError("forced")

    monkeypatch.setattr(update, "require_parity", refuse)
    with pytest.raises(parity.ParityError):
        update.live_update(spark, as_batch(rows), root, base.score, "2024-01-25 00:00:00")
    assert {tuple(r) for r in logs(spark, root).collect()} == before


def test_ingest_stream_is_idempotent(spark, rows):
    root = shared_folder(spark, "ing")
    small = rows.filter("ts < timestamp_ntz'2024-01-04 00:00:00'")
    for _ in range(2):
        small.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        ingest.start_ingest(stream, f"{root}/readings", f"{root}/cp").awaitTermination()
    assert tables.read(spark, f"{root}/readings", S.READINGS_TABLE).count() == small.select(*ingest.KEY).distinct().count()


def test_snapshot_is_seeded_once_and_replaced(spark, tmp_path):
    log = spark.sql("SELECT timestamp_ntz'2024-01-01 05:00:00' timestamp, 1 v")
    path = str(tmp_path / "snap")
    assert tables.seed_snapshot(spark, log, "snap_test", path) is True
    assert tables.seed_snapshot(spark, log, "snap_test", path) is False
    tables.publish_snapshot(log.withColumn("v", F.lit(2)), "snap_test", path)
    assert [r.v for r in spark.table("snap_test").collect()] == [2]


def test_forests_learn_and_round_trip(spark):
    """Metric bounds: better than chance on held-out rows, probabilities survive saving."""
    data = models._stored_dataset(spark, MEDIUM)
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    model = training.fit_classifier(evaluation.with_class_weights(train, []), numTrees=20, maxDepth=6)
    path = shared_folder(spark, "m")
    training.save(model, path)
    scored = training.score(training.load(path), test)
    r = scored.agg(
        F.avg(F.when(F.col("label") == 1, F.col("proba_modelo"))).alias("pos"),
        F.avg(F.when(F.col("label") == 0, F.col("proba_modelo"))).alias("neg"),
        F.min("proba_modelo").alias("lo"), F.max("proba_modelo").alias("hi"),
    ).first()
    assert 0 <= r.lo <= r.hi <= 1 and (r.pos is None or r.pos > r.neg)
    same = training.score(model, test).select(*KEYS, "proba_modelo")
    assert scored.select(*KEYS, "proba_modelo").exceptAll(same).count() == 0
    dry = spark.createDataFrame([tuple([0.0] * 6)], ", ".join(f"{c} double" for c in scenarios.INPUTS))
    year = scenarios.scenario_features(scenarios.over_the_year(dry), F.col("hora_dia"), F.col("mes"))
    worst = scenarios.scored_scenarios(year, lambda d: training.score(model, d)).agg(F.max("proba_alerta")).first()[0]
    assert worst <= rules.DRY_PROBABILITY_CAP
    imp = training.importances(spark, model)
    assert imp.count() == len(S.FEATURES) and imp.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    reg = training.fit_regressor(train, "delta", numTrees=10, maxDepth=5)
    out = training.predict_delta(reg, test, "p").agg(F.avg(F.abs(F.col("p") - F.col("target_6h"))).alias("mae"),
                                                    F.avg(F.col("target_6h")).alias("mean")).first()
    assert out.mae < out.mean + 1


def hours_of(spark, root):
    rows = tables.read(spark, f"{root}/series", S.SERIES_TABLE).select(*KEYS, F.round("P_basin", 6))
    return {tuple(r) for r in rows.collect()}


def built(spark, rows, now):
    root = shared_folder(spark, "whole")
    update.live_update(spark, as_batch(rows), root, base.score, now)
    return hours_of(spark, root), {tuple(r) for r in logs(spark, root).collect()}


def test_update_makes_up_for_a_failed_run(spark, rows, monkeypatch):
    root = shared_folder(spark, "retry")
    update.live_update(spark, as_batch(rows), root, base.score, "2024-01-10 00:00:00")

    def refuse(*_):
        raise parity.ParityError("forced")

    with monkeypatch.context() as m:
        m.setattr(update, "require_parity", refuse)
        with pytest.raises(parity.ParityError):
            update.live_update(spark, as_batch(rows), root, base.score, "2024-01-28 00:00:00")
    update.live_update(spark, as_batch(rows), root, base.score, "2024-01-28 00:00:00")
    assert (hours_of(spark, root), {tuple(r) for r in logs(spark, root).collect()}) == built(spark, rows, "2024-01-28 00:00:00")


def test_update_fills_a_long_silence(spark, rows):
    some = rows.filter("ts < timestamp_ntz'2024-01-04 00:00:00' OR ts >= timestamp_ntz'2024-01-12 00:00:00'")
    root = shared_folder(spark, "silence")
    for now in ("2024-01-04 00:00:00", "2024-01-13 00:00:00"):
        update.live_update(spark, as_batch(some), root, base.score, now)
    assert hours_of(spark, root) == built(spark, some, "2024-01-13 00:00:00")[0]


def test_update_stores_readings_older_than_the_slice(spark, rows):
    late = "ts >= timestamp_ntz'2024-01-06 00:00:00' AND ts < timestamp_ntz'2024-01-06 12:00:00'"
    root = shared_folder(spark, "late")
    update.live_update(spark, as_batch(rows.filter(f"NOT ({late})")), root, base.score, "2024-01-10 00:00:00")
    update.live_update(spark, as_batch(rows), root, base.score, "2024-01-10 06:00:00")
    kept = tables.read(spark, f"{root}/readings", S.READINGS_TABLE).filter(late)
    assert kept.count() == rows.filter(late).select(*ingest.KEY).distinct().count() > 0


def test_arrivals_are_scored_at_once_and_corrected_later(spark, rows):
    """The second micro-batch corrects values of the first; the log is that of the corrected readings, up to the last hour."""
    root = shared_folder(spark, "arrive")
    some = rows.filter("ts < timestamp_ntz'2024-01-08 00:00:00'")
    wrong = "ts >= timestamp_ntz'2024-01-06 20:00:00' AND ts < timestamp_ntz'2024-01-07 00:00:00'"
    first = some.filter("ts < timestamp_ntz'2024-01-07 00:00:00'").withColumn("mm", F.expr(f"CASE WHEN {wrong} THEN mm + 4.5D ELSE mm END"))
    for part, last_hour in ((first, "2024-01-06 23:00:00"), (some.filter(f"{wrong} OR ts >= timestamp_ntz'2024-01-07 00:00:00'"), "2024-01-07 23:00:00")):
        part.write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landing")
        arrivals.start_updates(stream, root, base.score).awaitTermination()
        assert str(logs(spark, root).agg(F.max("timestamp")).first()[0]) == last_hour
    want = reporting.prediction_log(base.score(features.complete(expected_features(some))))
    got = logs(spark, root)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_summary_lists_silent_stations_and_state_follows_the_tables(spark, rows):
    root = shared_folder(spark, "quiet")
    early = rows.filter("ts < timestamp_ntz'2024-01-05 00:00:00'")
    update.live_update(spark, as_batch(early), root, base.score, "2024-01-05 00:00:00")
    one = early.select("basin", "station_id").orderBy("basin", "station_id").first()
    news = rows.filter((F.col("basin") == one.basin) & (F.col("station_id") == one.station_id) & (F.col("ts") < F.lit("2024-01-06").cast("timestamp_ntz")))
    summary = update.live_update(spark, as_batch(news), root, base.score, "2024-01-06 00:00:00").collect()
    assert len(summary) == early.select("basin", "station_id").distinct().count() > 1
    assert all((r.new_rows > 0) == ((r.basin, r.station_id) == tuple(one)) and r.last_reading for r in summary)
    readings = tables.read(spark, f"{root}/readings", S.READINGS_TABLE)
    marks = tables.read(spark, f"{root}/marks", update.MARKS)
    assert marks.exceptAll(readings.groupBy("basin", "station_id").agg(F.max("ts"))).count() == 0
    stored = tables.read(spark, f"{root}/series", S.SERIES_TABLE)
    ends = tables.read(spark, f"{root}/ends", update.ENDS)
    assert ends.exceptAll(stored.groupBy("basin").agg(F.max("hour_idx"))).count() == 0


def test_forest_does_not_depend_on_the_layout(spark):
    from freshet.plans import training

    rng = F.rand(3)
    df = spark.range(400).select(
        F.lit("b").alias("basin"), F.col("id").alias("hour_idx"), *[F.round(rng * (i + 1), 3).alias(f) for i, f in enumerate(S.FEATURES)],
        (F.col("id") % 3 == 0).cast("double").alias("label"), F.lit(1.0).alias("class_weight"))
    df.write.parquet(path := shared_folder(spark, "layout"))
    stored = spark.read.parquet(path)
    means = {round(training.score(training.fit_classifier(stored.repartition(n), numTrees=5), stored).agg(F.avg("proba_modelo")).first()[0], 12) for n in (3, 16)}
    assert len(means) == 1


def test_stored_readings_are_not_made_distinct_again(spark, rows, monkeypatch):
    root, asked = shared_folder(spark, "live"), []
    built = update.runoff_series
    monkeypatch.setattr(update, "runoff_series", lambda readings, *a, **k: (asked.append((readings, k.get("unique"))), built(readings, *a, **k))[1])
    twice = rows.filter("ts < timestamp_ntz'2024-01-05 00:00:00'")
    update.live_update(spark, as_batch(twice.unionByName(twice)), root, base.score, "2024-01-05 00:00:00", horizons=(6,))
    (readings, unique), = asked
    assert unique and readings.count() == readings.select(*ingest.KEY).distinct().count() > 0
