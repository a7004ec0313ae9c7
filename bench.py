"""Headline timings: prints one JSON line.

Each query runs to completion into a no-op sink on the multi-basin readings (one basin
per three users), after one warm-up of the session. Stored inputs (series, dataset, model)
are built once, outside the timed sections that only read them.
"""

from __future__ import annotations

import json
import os
import time

from freshet import schema as S
from freshet.functions import rules
from freshet.operators import features as feats
from freshet.operators import series as ops
from freshet.operators.dedup import append_readings, splice
from freshet.plans import diagnostics, events, evaluation, reporting, spatial, training
from freshet.queries.base import KEYS, score
from freshet.queries.events import known_events
from freshet.session import build_session, shared_folder
from freshet.sources import gauges
from freshet.sources.tables import write_table
from freshet.streaming import hours, parity

USERS_PER_BASIN = 3
GATEWAY_USERS = 40


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
        # Small stored tables should still be read by every core.
        spark__sql__files__openCostInBytes=str(256 * 1024),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def run(name, df):
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - t0, 3)
        return out

    rows = gauges.readings(spark, sf_dir, USERS_PER_BASIN)
    rows.groupBy("basin").count().write.format("noop").mode("overwrite").save()

    root = shared_folder(spark, "bench")

    def stored(name, df):
        timed(name, lambda: write_table(df, f"{root}/{name}"))
        return spark.read.parquet(f"{root}/{name}")

    # Stages of the main line, each written as a table.
    stations = stored("station_hours", ops.station_hours(rows))
    series = stored("hourly_series", ops.timestamped(ops.with_runoff(ops.complete_grid(ops.basin_hours(stations)))))
    dense = stored("dense_series", ops.runoff_series(gauges.readings(spark, sf_dir)))
    dataset = stored("dataset_6h", feats.dataset(dense, 6))
    long_rows = gauges.long_readings(spark, sf_dir)
    long = stored("long_series", ops.runoff_series(long_rows))

    labelled = evaluation.with_label(rules.with_rules(score(dataset)), "target_6h", KEYS)
    train = evaluation.with_class_weights(labelled.filter("split = 'train'"), [])
    write_table(train, f"{root}/train")
    model = timed("train_classifier_200_trees", lambda: training.fit_classifier(spark.read.parquet(f"{root}/train")))

    # The gateway run over at least as many series rows as the published one: features,
    # parity of every row, forest scoring, rules, log.
    write_table(ops.runoff_series(gauges.readings(spark, sf_dir, GATEWAY_USERS)).unionByName(long), f"{root}/gateway_series")
    gateway_series = spark.read.parquet(f"{root}/gateway_series")

    def gateway():
        quality = ops.quality_split(gateway_series)[0]
        write_table(feats.feature_rows(quality, chunk_len=feats.CHUNK_HOURS), f"{root}/features")
        rows = spark.read.parquet(f"{root}/features")
        parity.require_parity(feats.feature_rows(quality), rows, [*KEYS, "hour_idx"])
        write_table(reporting.prediction_log(training.score(model, feats.complete(rows))), f"{root}/log")

    timed("gateway_run", gateway)
    log = spark.read.parquet(f"{root}/log")

    run("readings_to_series", ops.runoff_series(rows))
    run("features_all_basins", feats.feature_rows(ops.quality_split(series)[0], S.HORIZONS))
    run("features_long_chunked", feats.feature_rows(ops.quality_split(long)[0], S.HORIZONS, chunk_len=feats.CHUNK_HOURS))
    run("availability", diagnostics.availability_by_month(series, KEYS))
    run("raw_profile", diagnostics.raw_profile(rows, ["basin", "station_id"]))
    run("event_verdicts", events.verdicts(dense, known_events(spark, sf_dir), KEYS))
    pairs = stations.filter("station_id <> 'S2'").selectExpr("basin", "station_id station_a", "'S2' station_b").distinct()
    run("station_pairs", spatial.compare_pairs(stations, pairs, min_hours=4))
    cut = 473_800
    run("splice", splice(series.filter(f"hour_idx < {cut}"), series.filter(f"hour_idx >= {cut - 72}"), KEYS))
    arriving = gauges.as_text(rows)
    run("append_readings", append_readings(arriving.filter("fechaobservacion < '2024-01-16'"), arriving))
    run("threshold_sweep", evaluation.threshold_table(
        labelled.filter("split = 'test'"), evaluation.SWEEP, ["proba_modelo", "proba_alerta"], KEYS))
    run("alert_calendar", reporting.calendar(log))
    run("states_by_year", reporting.state_by_year(log))
    run("trailing_rain", reporting.trailing_rain(series))

    run("score_forest", rules.with_rules(training.score(model, feats.complete(dataset))))

    raw = spark.readStream.schema(gauges.events(spark, sf_dir).schema).parquet(f"{sf_dir}/event[s].parquet")
    stream = gauges.from_events(raw).filter("sensor_id = '240'").drop("tips")
    timed("stream_to_log", lambda: hours.start(stream, f"{root}/stream", score).awaitTermination())

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rows": {"series": series.count(), "gateway_series": gateway_series.count(), "log": log.count()},
    }))


if __name__ == "__main__":
    main()
