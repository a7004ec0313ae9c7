import random

import pytest
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.operators import dedup, features, frames, series
from freshet.sources import columns, landing, readings, tables
from freshet.functions import text


def batch(spark, start_hour, sensors=("240", "257")):
    rows = [
        (f"2026-10-01 {start_hour:02d}:{10 * i:02d}:00", "0027015330", s, 0.2)
        for i in range(6) for s in sensors
    ]
    return spark.createDataFrame(
        rows, "fechaobservacion string, codigoestacion string, codigosensor string, valorobservado double"
    )


def new_rows(df):
    return df.filter("is_new").count()


def test_append_keeps_both_sensors(spark):
    first = dedup.append_readings(None, batch(spark, 0))
    assert new_rows(first) == 12
    stored = first.drop("is_new")
    second = dedup.append_readings(stored, batch(spark, 1))
    assert new_rows(second) == 12
    again = dedup.append_readings(second.drop("is_new"), batch(spark, 1))
    assert new_rows(again) == 0
    counts = {r.codigosensor: r["count"] for r in again.groupBy("codigosensor").count().collect()}
    assert counts == {"240": 12, "257": 12}


def test_append_collapses_spellings(spark):
    lot = spark.createDataFrame(
        [("2026-10-07T23:50:00.000", "0027015310", "0240", "0"),
         ("2026-10-07 23:50:00", "27015310", "240", "0.0")],
        "fechaobservacion string, codigoestacion string, codigosensor string, valorobservado string",
    )
    first = dedup.append_readings(None, lot)
    assert first.count() == new_rows(first) == 1
    assert new_rows(dedup.append_readings(first.drop("is_new"), lot)) == 0


def test_append_without_any_key_is_a_plain_union(spark):
    a = spark.createDataFrame([(1.0,)], "valorobservado double")
    assert dedup.append_readings(a, a).count() == 2


def test_append_new_value_wins(spark):
    old = batch(spark, 0, ("240",))
    new = old.withColumn("valorobservado", F.lit(9.0))
    merged = dedup.append_readings(old, new)
    assert {r.valorobservado for r in merged.collect()} == {9.0}


def test_keep_last_on_a_hot_key(spark):
    """A third of all rows are copies of one key; they collapse before the shuffle."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("arrival"),
        (F.col("id") * 2).alias("v"),
    )
    out = dedup.keep_last(df, ["k"], ["arrival"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
    got = {r.k: r.v for r in out.collect()}
    assert len(got) == 20_001 and got[0] == 2 * 29_997


def test_keep_last_if_keyed_passes_other_schemas(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, arrival int")
    assert dedup.keep_last_if_keyed(df, ["a", "missing"], ["arrival"]).count() == 2


@pytest.mark.parametrize("old, new, want", [
    ((0, 100), (50, 150), "cut 74"),       # new.min + 24
    ((0, 200), (50, 250), "cut 152"),      # old.max - 48
    (None, (5, 8), "new"),
    ((5, 8), None, "old"),
])
def test_splice(spark, old, new, want):
    def make(r, tag):
        hours = range(r[0], r[1] + 1) if r else []
        return spark.createDataFrame([("b", h, tag) for h in hours], "basin string, hour_idx bigint, tag string")

    rows = {r.hour_idx: r.tag for r in dedup.splice(make(old, "old"), make(new, "new"), ["basin"]).collect()}
    if want.startswith("cut"):
        cut = int(want.split()[1])
        assert all(t == ("old" if h < cut else "new") for h, t in rows.items())
        assert min(rows) == old[0] and max(rows) == new[1]
    else:
        assert set(rows.values()) == {want}


def random_series(spark, n=2000, seed=3):
    rng = random.Random(seed)
    rows, hour = [], 400_000
    for _ in range(n):
        hour += rng.choice([1, 1, 1, 1, 2, 3, 30])
        rows.append(("b", hour, rng.choice([0.0, 0.0, 1.5, 3.0]) if rng.random() > 0.05 else None, rng.choice([1, 2, 3])))
    return spark.createDataFrame(rows, "basin string, hour_idx bigint, P_basin double, n_estaciones_disponibles int"), rows


def test_chunked_frames_equal_whole_series(spark):
    df, _ = random_series(spark)
    full = series.complete_grid(df)
    whole = series.with_runoff(full)
    chunked = series.with_runoff(full, chunk_len=100)
    cols = ["basin", "hour_idx", "P_acc_24h", "Q_scs_proxy"]
    assert whole.select(*cols).exceptAll(chunked.select(*cols)).count() == 0
    assert whole.count() == chunked.count()
    q = series.quality_split(whole)[0]
    a = features.feature_rows(q, (6, 24))
    b = features.feature_rows(q, (6, 24), chunk_len=72)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_halo_needs_room(spark):
    with pytest.raises(ValueError):
        frames.with_halo(spark.range(3), "id", 10, back=11, ahead=0)


def test_series_and_features_against_pandas(spark):
    """The documented missing-value rules, checked against rolling windows on a full grid."""
    df, rows = random_series(spark, n=600)
    pd = pytest.importorskip("pandas")
    base = pd.DataFrame(rows, columns=["basin", "h", "p", "n"]).set_index("h").reindex(range(rows[0][1], rows[-1][1] + 1))
    acc = base.p.rolling(24, min_periods=1).sum().mask(base.p.notna().rolling(24, min_periods=1).sum() < 12)
    cn = 81.1
    s = 25400 / cn - 254
    ex = acc - 0.2 * s
    q = (ex ** 2 / (ex + s)).where(ex > 0, 0.0).where(acc.notna())
    got = series.with_runoff(series.complete_grid(df)).toPandas().set_index("hour_idx").sort_index()
    assert list(got.index) == list(base.index)
    pd.testing.assert_series_equal(got.Q_scs_proxy, q, check_names=False, check_index_type=False)

    ok = base.n >= 2
    good = pd.DataFrame({"p": base.p.where(ok), "q": q.where(ok)})
    want = pd.DataFrame({
        "lag_3h": good.p.shift(3), "Q_lag_6h": good.q.shift(6),
        "roll_sum_48h": good.p.rolling(48, min_periods=1).sum(),
        "roll_max_6h": good.p.rolling(6, min_periods=1).max(),
        "target_12h": good.q.shift(-12),
    })[ok]
    feats = features.feature_rows(series.quality_split(series.with_runoff(series.complete_grid(df)))[0], (12,))
    feats = feats.toPandas().set_index("hour_idx").sort_index()
    first, last = want.index.min(), want.index.max()
    assert (feats.index.min(), feats.index.max()) == (first, last)
    pd.testing.assert_frame_equal(
        feats[list(want)].astype(float), want.astype(float), check_index_type=False, check_names=False
    )


def test_all_bad_values_stay_unknown(spark):
    df = spark.sql("""SELECT 'b' basin, 'S0' station_id, timestamp_ntz'2024-01-01 00:10:00' ts, CAST(NULL AS DOUBLE) mm
                      UNION ALL SELECT 'b', 'S0', timestamp_ntz'2024-01-01 02:10:00', 1.5
                      UNION ALL SELECT 'b', 'S1', timestamp_ntz'2024-01-01 02:20:00', CAST(NULL AS DOUBLE)""")
    rows = {r.hour_idx % 24: (r.P_basin, r.n_estaciones_disponibles) for r in series.runoff_series(df).collect()}
    assert rows == {0: (None, 0), 1: (None, 0), 2: (1.5, 1)}


def test_identical_readings_count_once_and_copies_differ(spark):
    df = spark.sql("""SELECT 'b' basin, 'S0' station_id, timestamp_ntz'2024-01-01 00:10:00' ts, v mm
                      FROM VALUES (1.5D), (1.5D), (3.0D) t(v)""")
    assert series.station_hours(df).first().mm == 4.5


@pytest.mark.parametrize("n, train", [(1, 1), (2, 1), (3, 2), (50, 41), (100, 82)])
def test_fresh_split(spark, n, train):
    df = spark.range(n).select(F.lit("b").alias("basin"), F.col("id").alias("hour_idx"))
    rows = features.chronological_split(df).orderBy("hour_idx").collect()
    assert [r.split for r in rows] == ["train"] * train + ["test"] * (n - train)


def test_split_reuses_an_earlier_cut(spark):
    df = spark.range(10).select(F.lit("b").alias("basin"), F.col("id").alias("hour_idx"))
    earlier = df.withColumn("split", F.when(F.col("hour_idx") >= 4, "test").otherwise("train"))
    again = features.chronological_split(df, previous_cut=features.existing_cut(earlier))
    assert again.filter("split = 'test'").agg(F.min("hour_idx")).first()[0] == 4
    assert features.existing_cut(df) is None
    only_train = earlier.withColumn("split", F.lit("train"))
    fresh = features.chronological_split(df, previous_cut=features.existing_cut(only_train))
    assert fresh.filter("split = 'test'").count() == 2


def test_fill_gaps_before_the_first_row(spark):
    df = spark.createDataFrame([("b", 5, 1), ("b", 8, 2)], "k string, i bigint, v int")
    rows = frames.fill_gaps(df, ["k"], "i", ["v"], first_at=F.lit(3).cast("bigint")).orderBy("i").collect()
    assert [(r.i, r.v, r.filled) for r in rows] == [
        (3, None, True), (4, None, True), (5, 1, False), (6, None, True), (7, None, True), (8, 2, False)
    ]


def test_every_kth(spark):
    df = spark.range(1000).select(F.lit("b").alias("basin"), F.col("id").alias("t"))
    kept = sorted(r.t for r in series.every_kth(df, ["basin"], "t", at_most=200).collect())
    assert kept == list(range(0, 1000, 5))
    assert series.every_kth(df.filter("t < 150"), ["basin"], "t").count() == 150


def test_column_resolution_orders_differ():
    cols = ["Timestamp ", "fechaobservacion", "estacion", "codigoestacion"]
    assert columns.first_in_table(cols, S.TIME_NAMES) == "Timestamp "
    assert columns.first_candidate(cols, S.DATE_NAMES) == "fechaobservacion"
    assert columns.first_candidate(cols, S.STATION_NAMES) == "codigoestacion"
    assert columns.first_candidate(["x"], S.STATION_NAMES) is None


def test_missing_columns_fail(spark):
    with pytest.raises(ValueError, match="value"):
        readings.typed(spark.createDataFrame([("a", "b")], "codigosensor string, fecha_observacion string"))


def test_no_readings_fail_and_are_not_written(spark, tmp_path):
    empty = spark.createDataFrame([], S.READINGS_TEXT)
    with pytest.raises(FileNotFoundError):
        readings.require_any(empty)
    assert tables.write_non_empty(empty, str(tmp_path / "out")) is False
    assert not tables.exists(spark, str(tmp_path / "out"))


def test_code_variants_and_fragments(spark):
    df = spark.createDataFrame(
        [(" 0027015310 ", "Aeropuerto O - la mesa - AEROPUERTO O [27015310]"), ("240", None), ("123456789012", "abc")],
        "c string, n string",
    )
    rows = df.select(text.code_variants(F.col("c")).alias("v"), text.name_fragments(F.col("n")).alias("f")).collect()
    assert rows[0].v == ["0027015310", "27015310"] and rows[0].f == ["AEROPUERTO O", "LA MESA"]
    assert rows[1].v == ["240", "0000000240"] and rows[1].f == []
    assert rows[2].v == ["123456789012"] and rows[2].f == []


def test_year_slices_are_pruned(spark, tmp_path):
    rows = spark.sql("""SELECT 'S' || id % 3 station_id, timestamp_ntz'2019-12-30 00:00:00' + make_dt_interval(0, CAST(id AS INT)) ts, 1.0D mm
                        FROM range(100)""")
    path = str(tmp_path / "years")
    landing.write_year_slices(rows, path, files=2)
    part = landing.read_range(spark, path, "2020-01-01 00:00:00", "2020-01-01 05:00:00")
    assert part.count() == 6
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_partition_overwrite_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string"), path, ["day"])
    tables.write_table(spark.createDataFrame([(9, "b")], "v int, day string"), path, ["day"])
    assert {(r.v, r.day) for r in spark.read.parquet(path).collect()} == {(1, "a"), (9, "b")}


def test_gap_ledger_is_cleared_when_complete(spark, tmp_path):
    stations = spark.createDataFrame([("S0",)], "station_id string")
    rows = spark.sql("SELECT 'S0' station_id, timestamp_ntz'2024-01-09 03:00:00' ts")
    path = str(tmp_path / "gaps")
    landing.record_gaps(landing.gap_ledger(stations, rows, "2024-01-01", "2024-01-20"), path)
    assert sorted(r.rango for r in spark.read.parquet(path).collect()) == [
        "2024-01-01 a 2024-01-07", "2024-01-15 a 2024-01-20"
    ]
    landing.record_gaps(landing.gap_ledger(stations, rows, "2024-01-08", "2024-01-12"), path)
    assert spark.read.parquet(path).count() == 0


def test_update_start_falls_back(spark):
    stations = spark.createDataFrame([("b", "S0"), ("b", "S1"), ("x", "S0")], "basin string, station_id string")
    rows = spark.sql("SELECT 'b' basin, 'S0' station_id, timestamp_ntz'2024-01-09 03:10:00' ts")
    ends = spark.createDataFrame([("b", 24 * 10)], "basin string, hour_idx bigint")
    got = {(r.basin, r.station_id): str(r.since) for r in landing.high_water_marks(stations, rows, ends).collect()}
    assert got == {("b", "S0"): "2024-01-09 03:10:00", ("b", "S1"): "1970-01-08 00:00:00",
                   ("x", "S0"): "2026-09-30 18:00:00"}


def test_basin_window_groups_are_hours_not_readings(spark):
    """One shuffle per level: readings by row, then station hours, basin hours, and basins."""
    from tests.conftest import SMALL
    from freshet.queries import base

    plan = features.dataset(base.series(spark, SMALL), 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


def test_hot_station_hour_of_copies(spark):
    """A third of the readings are copies of one row and another third share one hour."""
    df = spark.range(9_000).select(
        F.lit("b").alias("basin"), F.lit("S0").alias("station_id"), F.lit("240").alias("sensor_id"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(
            F.lit(0), F.when(F.col("id") % 3 == 2, (F.col("id") % 48).cast("int")).otherwise(5), F.lit(0),
            F.when(F.col("id") % 3 == 1, (F.col("id") / 3).cast("int") % 3000).otherwise(0).cast("decimal(18,6)"),
        )).alias("ts"),
        F.lit(1.5).alias("mm"),
    )
    want = {}
    for r in {tuple(x) for x in df.collect()}:
        hour = r[3].replace(minute=0, second=0, microsecond=0)
        want[hour] = want.get(hour, 0.0) + r[4]
    got = {r.timestamp: r.P_basin for r in series.runoff_series(df).collect() if r.P_basin is not None}
    assert got == want
    plan = series.station_hours(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < plan.rindex("Exchange")
