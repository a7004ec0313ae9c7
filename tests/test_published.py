"""One-step publication, rebuilds, readings that must not vanish."""

import warnings
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.plans import update
from freshet.queries import base
from freshet.session import shared_folder
from freshet.sources import published, tables
from freshet.streaming import hours, ingest, parity

START = datetime(2024, 1, 1)
ROWS = "basin string, station_id string, sensor_id string, ts timestamp_ntz, mm double, arrival bigint"
KEYS = ["basin", "hour_idx"]
TABLES = {"series": S.SERIES_TABLE, "log": S.LOG_TABLE, "dataset_6h": S.dataset_table(6)}


def readings(spark, basins=("A", "B"), days=6.0, first=0.0):
    rows = [(b, s, "240", START + timedelta(hours=h, minutes=7), 1.5 * ((h * (3 + i)) % 5 == 0), 0)
            for i, b in enumerate(basins) for s in ("S0", "S1") for h in range(int(first * 24), int(days * 24))]
    return spark.createDataFrame(rows, ROWS)


def at(days: float) -> str:
    return str(START + timedelta(days=days))


def run(spark, df, root, days, **options):
    return update.live_update(spark, df, root, base.score, at(days), horizons=options.pop("horizons", (6,)), **options)


def contents(spark, root):
    out = {}
    for name, schema in TABLES.items():
        df = tables.read(spark, f"{root}/{name}", schema)
        out[name] = {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()}
    return out


def counts(spark, root):
    return [r.asDict() for r in tables.read(spark, f"{root}/update_counts", update.COUNTS).orderBy("run").collect()]


def test_versions_show_all_tables_or_none(spark, tmp_path):
    root = str(tmp_path)
    old = spark.sql("SELECT DATE'2024-01-01' day, 1L x UNION ALL SELECT DATE'2024-01-02', 2L")
    assert published.read(spark, root, "t", "x bigint, day date") is None and published.latest(spark, root) == 0
    published.stage(old, root, "t", 1)
    assert published.read(spark, root, "t", "x bigint, day date") is None
    published.publish(spark, root, 1, {"t": old})
    new = spark.sql("SELECT DATE'2024-01-02' day, 7L x")
    state = spark.sql("SELECT 'a' k")
    published.stage(new, root, "t", 2)
    published.stage(state, root, "s", 2)
    read = lambda **k: sorted(r.x for r in published.read(spark, root, "t", "x bigint, day date", **k).collect())
    assert read() == [1, 2]
    published.publish(spark, root, 2, {"t": new, "s": state})
    assert read() == [1, 7] and read(version=1) == [1, 2] and read(since=datetime(2024, 1, 2).date()) == [7]
    assert [r.k for r in tables.read(spark, f"{root}/s", "k string").collect()] == ["a"]
    published.stage(new.withColumn("x", F.lit(9).cast("long")), root, "t", 3)  # a run that died
    assert read() == [1, 7]
    assert published.remove_unlisted(spark, root) == 2 and read() == [1, 7]
    assert published.latest(spark, root) == 2


def test_a_crash_at_any_table_leaves_the_old_version(spark, monkeypatch):
    root = shared_folder(spark, "crash")
    run(spark, readings(spark), root, 4)
    before = contents(spark, root)
    stage, publish = published.stage, published.publish
    for crash in (0, 1, 2, 3, 4, "list"):  # series, log, dataset, ends, cuts, the list of parts
        calls = [0]

        def dying_stage(*a):
            calls[0] += 1
            if calls[0] - 1 == crash:
                raise OSError("gone")
            stage(*a)

        def dying_publish(*a):
            raise OSError("gone") if crash == "list" else publish(*a)

        with monkeypatch.context() as m:
            m.setattr(published, "stage", dying_stage)
            m.setattr(published, "publish", dying_publish)
            with pytest.raises(OSError):
                run(spark, readings(spark), root, 5)
        assert contents(spark, root) == before
    run(spark, readings(spark).filter("false"), root, 5)  # what was stored is made up for
    whole = shared_folder(spark, "whole")
    run(spark, readings(spark), whole, 5)
    assert contents(spark, root)["series"] == contents(spark, whole)["series"] and contents(spark, root)["log"] == contents(spark, whole)["log"]


def test_no_reading_vanishes(spark):
    root = shared_folder(spark, "counts")
    bad = [(None, "S0", "240", START, 1.0, 0), ("A", None, "240", START, 1.0, 0), ("A", "S0", "240", None, 1.0, 0),
           ("A", "S0", "240", datetime(1970, 1, 1), 1.0, 0), ("A", "S0", "240", datetime(9999, 1, 1), 1.0, 0)]
    run(spark, readings(spark, days=5).unionByName(spark.createDataFrame(bad, ROWS)), root, 4)
    first = counts(spark, root)[0]
    n = readings(spark, days=4).count()
    assert (first["due"], first["deferred"], first["rejected"], first["waiting"]) == (n, readings(spark, days=5).count() - n, 5, 0)
    reasons = {r["reason"]: r["count"] for r in tables.read(spark, f"{root}/rejected", update.REJECTED).groupBy("reason").count().collect()}
    assert reasons == {"no key": 3, "implausible time": 2}
    # Nothing new comes, but what was ahead is due a day later.
    run(spark, readings(spark).filter("false"), root, 5)
    stored = tables.read(spark, f"{root}/readings", S.READINGS_TABLE)
    assert stored.count() == readings(spark, days=5).count() and counts(spark, root)[1]["deferred"] == 0
    whole = shared_folder(spark, "whole")
    run(spark, readings(spark, days=5), whole, 5)
    assert contents(spark, root)["log"] == contents(spark, whole)["log"]


def test_rebuild_takes_what_waited(spark):
    late = F.col("ts").between(START + timedelta(days=1), START + timedelta(days=1.5)) & (F.col("station_id") == "S1")
    root = shared_folder(spark, "late")
    run(spark, readings(spark).filter(~late), root, 5)
    run(spark, readings(spark), root, 5.5)
    waited = counts(spark, root)[1]
    assert waited["waiting"] > 0 and waited["waiting"] + waited["recomputed"] == waited["due"]
    whole = shared_folder(spark, "whole")
    run(spark, readings(spark), whole, 5.5)
    assert contents(spark, root)["series"] != contents(spark, whole)["series"]
    update.rebuild(spark, root, base.score, horizons=(6,))
    assert contents(spark, root)["series"] == contents(spark, whole)["series"] and contents(spark, root)["log"] == contents(spark, whole)["log"]


def test_gate_covers_a_lagging_basin(spark, monkeypatch):
    """B's new hours lie before A's last one: they are compared all the same."""
    root = shared_folder(spark, "lag")
    run(spark, readings(spark, ("A",), 5).unionByName(readings(spark, ("A", "B"), 3).filter("basin = 'B'")), root, 5)
    seen = []
    real = parity.require_parity
    monkeypatch.setattr(update, "require_parity", lambda a, b, k: (seen.append({(r.basin, r.hour_idx) for r in a.select(*KEYS).collect()}), real(a, b, k)))
    run(spark, readings(spark, ("A", "B"), 4).filter("basin = 'B'"), root, 5)
    first = int((START - datetime(1970, 1, 1)).total_seconds() // 3600)
    assert {h for b, h in seen[0] if b == "B"} == set(range(first + 72, first + 96)) and not any(b == "A" for b, _ in seen[0])


def test_a_later_horizon_only_warns_and_the_snapshot_follows(spark, monkeypatch, tmp_path):
    root, name = shared_folder(spark, "warn"), "snap_live"
    split = update.chronological_split

    def refuses(df, *a, **k):
        if "target_12h" in df.columns and k.get("previous_cut") is not None and refuses.on:
            refuses.n += 1
            if refuses.n % 2 == 0:
                raise ValueError("too few rows")
        return split(df, *a, **k)

    refuses.on, refuses.n = True, 0
    monkeypatch.setattr(update, "chronological_split", refuses)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        run(spark, readings(spark), root, 4, horizons=(6, 12), snapshot=name)
    assert any("dataset_12h is left as it was" in str(w.message) for w in told)
    assert tables.read(spark, f"{root}/dataset_6h", S.dataset_table(6)).count() > 0
    assert published.read(spark, root, "dataset_12h", S.dataset_table(12)) is None
    assert spark.table(name).count() == tables.read(spark, f"{root}/log", S.LOG_TABLE).count() > 0
    refuses.on = False
    run(spark, readings(spark), root, 5, horizons=(6, 12), snapshot=name)
    log = tables.read(spark, f"{root}/log", S.LOG_TABLE).select("basin", "timestamp", "estado")
    assert spark.table(name).select("basin", "timestamp", "estado").exceptAll(log).isEmpty() and spark.table(name).count() == log.count()
    spark.sql(f"DROP TABLE {name}")


def test_readings_beyond_the_watermark_are_stored_and_counted(spark):
    root = shared_folder(spark, "sixty")
    df = readings(spark, ("A",), 8).drop("arrival")
    last = START + timedelta(days=7)
    late = F.col("ts").between(last - timedelta(hours=60), last - timedelta(hours=55))
    near = F.col("ts").between(last - timedelta(hours=20), last - timedelta(hours=15))
    first = (F.col("ts") < last) & ~late & ~near
    for part in (first, ~first):
        df.filter(part).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(df.schema).parquet(f"{root}/landing")
        hours.start(stream, f"{root}/out", base.score).awaitTermination()
    got = hours.late_readings(spark, f"{root}/out")
    assert {tuple(r) for r in got.select("station_id", "ts").collect()} == {tuple(r) for r in df.filter(late).select("station_id", "ts").collect()}
    # The stream took all others: with the late ones, every reading is accounted for.
    closed = tables.read(spark, f"{root}/out/hours", hours.HOURS)
    assert closed.filter("n_estaciones_disponibles = 2").count() == closed.count() > 0
    live = shared_folder(spark, "hand")
    run(spark, df.filter(first).withColumn("arrival", F.lit(0).cast("long")), live, 8)
    run(spark, got.select("basin", "station_id", "sensor_id", "ts", "mm", F.lit(1).cast("long").alias("arrival")), live, 8, late_hours=72)
    assert tables.read(spark, f"{live}/readings", S.READINGS_TABLE).count() == df.filter(first | late).count()


def test_more_days_than_listed_are_joined(spark, monkeypatch):
    root = shared_folder(spark, "days")
    df = readings(spark)
    tables.write_table(ingest.merge_readings(df, f"{root}/r").drop("is_new", "touched"), f"{root}/r", ["day"])
    listed = ingest.merge_readings(df, f"{root}/r").groupBy("is_new", "touched").count().collect()
    monkeypatch.setattr(tables, "MAX_LISTED_DAYS", 0)
    joined = ingest.merge_readings(df, f"{root}/r").groupBy("is_new", "touched").count().collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, joined)) == [(False, True, df.count())]
