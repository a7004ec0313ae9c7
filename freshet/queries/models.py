"""Forest queries. Metrics of a forest depend on the learner and have no SQL equivalent; the ``_checked`` queries return
what does not depend on it (rows, events, baseline) beside the properties that any forest must have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.functions import rules
from freshet.operators import features as feats
from freshet.plans import evaluation as ev
from freshet.plans import training
from freshet.queries import query
from freshet.queries.base import KEYS, r6, series
from freshet.queries.sql import FEATURES, r, with_ctes
from freshet.session import shared_folder
from freshet.sources.tables import staged, write_table

# Properties hold for forests of any size, so small ones are enough where only these are returned.
SMALL = {"numTrees": 20, "maxDepth": 6}
SLACK = 1e-6


def _stored_dataset(spark, sf_dir):
    """Dataset with label, weights and baseline, written once: training reads it many times."""
    path = shared_folder(spark, "training")
    hours = staged(series(spark, sf_dir), "series")  # read by the features and by the baseline
    rows = ev.with_persistence(feats.dataset(hours, 6), hours, KEYS)
    p75 = ev.train_quantile("target_6h", 0.75).over(Window.partitionBy(*KEYS))
    rows = staged(ev.with_label(rows, "target_6h", KEYS).withColumn("p75_train", p75), "labelled")
    # The weights need the largest target first: a second look at the rows, not a second computation.
    write_table(ev.with_sample_weights(rows, "target_6h", []), path)
    return spark.read.parquet(path)


@query("forest_regressors_report", "J1 J2 J3 J4 J7 D17 D18 D19 D20")
def forest_regressors_report(spark, sf_dir):
    rows = _stored_dataset(spark, sf_dir)
    train, test = ev.split_sides(rows)
    absolute, weighted, change = training.fit_side_by_side(spark, [
        lambda: training.fit_regressor(train, "target_6h"), lambda: training.fit_regressor(train, "target_6h", "sample_weight"),
        lambda: training.fit_regressor(train, "delta")], training.at_once(train))
    test = training.predict(weighted, training.predict(absolute, test, "absolute"), "weighted")
    test = staged(training.predict_delta(change, test, "rebuilt"), "predicted")  # three reports, one prediction
    reports = [
        ev.regression_report(test, "target_6h", "persistence", m, KEYS).withColumn("model", F.lit(m))
        for m in ("absolute", "weighted", "rebuilt")
    ]
    return r6(reports[0].unionByName(reports[1]).unionByName(reports[2]))


@query("forest_classifier_sweep", "J5 J6 J7 A18 D24 D26 D40")
def forest_classifier_sweep(spark, sf_dir):
    rows = _stored_dataset(spark, sf_dir)
    train, test = ev.split_sides(rows)
    path = shared_folder(spark, "model")
    training.save(training.fit_classifier(ev.with_class_weights(train, [])), path)
    scored = rules.with_rules(training.score(training.load(path), test))
    return r6(ev.threshold_table(scored, ev.SWEEP + [0.7], ["proba_modelo", "proba_alerta"], KEYS))


@query("forest_importance", "F5 D37 J5")
def forest_importance(spark, sf_dir):
    train, _ = ev.split_sides(_stored_dataset(spark, sf_dir))
    ranked = training.importances(spark, training.fit_classifier(ev.with_class_weights(train, [])))
    total = ev.importance_by_family(ranked).first().asDict()  # one row of three values
    return r6(ranked.select("*", *[F.lit(v).alias(c) for c, v in total.items()]))


def _within(value, low, high):
    return value.between(F.lit(low) - SLACK, F.lit(high) + SLACK)


@query(
    "forest_regressors_checked", "J1 J2 J3 J4 J7 D17 D18 D19",
    with_ctes(
        f"""SELECT basin, n_test, {r('p75')} AS p75_train, {r('mae')} AS base_mae, {r('sqrt(mse)')} AS base_rmse,
              {r("CASE WHEN n_test < 2 THEN NULL WHEN spread > 0 THEN 1 - mse / spread WHEN mse = 0 THEN 1.0 ELSE 0.0 END::DOUBLE")} AS base_r2,
              true AS within_train_range
            FROM (SELECT basin, count(*) AS n_test, any_value(p75) AS p75, avg(abs(target_6h - Q_actual)) AS mae,
                    avg((target_6h - Q_actual) * (target_6h - Q_actual)) AS mse, var_pop(target_6h) AS spread
                  FROM held_out GROUP BY basin)""", "held_out"),
)
def forest_regressors_checked(spark, sf_dir):
    """Persistence on the test rows; every prediction is an average of train targets, so it lies in their range."""
    train, test = ev.split_sides(_stored_dataset(spark, sf_dir))
    low, high, least, most = train.agg(F.min("target_6h"), F.max("target_6h"), F.min("delta"), F.max("delta")).first()
    test = training.predict(training.fit_regressor(train, "target_6h", **SMALL), test, "absolute")
    test = training.predict(training.fit_regressor(train, "target_6h", "sample_weight", **SMALL), test, "weighted")
    test = training.predict_delta(training.fit_regressor(train, "delta", **SMALL), test, "rebuilt")
    inside = (
        _within(F.col("absolute"), low, high) & _within(F.col("weighted"), low, high)
        & _within(F.col("rebuilt") - F.col("Q_actual"), least, most)
    )
    facts = test.groupBy(*KEYS).agg(F.first("p75_train").alias("p75_train"), F.bool_and(inside).alias("within_train_range"))
    report = ev.regression_report(test, "target_6h", "persistence", "absolute", KEYS).filter("subset = 'all'")
    base = report.select(*KEYS, F.col("n").alias("n_test"), "base_mae", "base_rmse", "base_r2")
    return r6(base.join(facts, KEYS))


@query(
    "forest_classifier_checked", "J5 J6 J7 A18 D24 D40",
    with_ctes(
        """SELECT basin, count(*) AS n_test, CAST(coalesce(sum(label), 0) AS BIGINT) AS positives, true AS probabilities,
             true AS same_when_reloaded, true AS hits_fall_with_threshold, true AS events_score_higher FROM held_out GROUP BY basin""", "held_out"),
)
def forest_classifier_checked(spark, sf_dir):
    """A saved forest gives the same probabilities; its train events score higher on average than its other train rows."""
    train, test = ev.split_sides(_stored_dataset(spark, sf_dir))
    model, path = training.fit_classifier(ev.with_class_weights(train, []), **SMALL), shared_folder(spark, "model")
    training.save(model, path)
    again = training.load(path)
    scored = training.score(again, training.score(model, test, "first_time"))
    mean = lambda label: F.avg(F.when(F.col("label") == label, F.col("proba_modelo")))
    events, others = training.score(model, train).agg(mean(1), mean(0)).first()
    table = ev.threshold_table(scored, ev.SWEEP, ["proba_modelo"], KEYS)
    out = scored.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("label") == 1).alias("positives"),
        F.bool_and(F.col("proba_modelo").between(0, 1)).alias("probabilities"),
        F.bool_and(F.col("proba_modelo") == F.col("first_time")).alias("same_when_reloaded"),
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("umbral", "tp"))), lambda x: x["tp"])
    falls = table.groupBy(*KEYS).agg(in_order.alias("_tp")).select(
        *KEYS, (F.col("_tp") == F.sort_array("_tp", asc=False)).alias("hits_fall_with_threshold"))
    return out.join(falls, KEYS).withColumn("events_score_higher", F.lit(events > others))


@query(
    "forest_importance_checked", "F5 D37 J5",
    with_ctes(
        f"""SELECT feature, CAST((SELECT count(*) FROM ds6 WHERE split = 'train') AS BIGINT) AS n_train, true AS adds_up,
              true AS in_order FROM (SELECT unnest({FEATURES}) AS feature)""", "ds6"),
)
def forest_importance_checked(spark, sf_dir):
    """Every feature is ranked once, none below zero, highest first, and the importances sum to 1."""
    train, _ = ev.split_sides(_stored_dataset(spark, sf_dir))
    ranked = training.importances(spark, training.fit_classifier(ev.with_class_weights(train, []), **SMALL))
    rows = ranked.orderBy("rank").collect()  # one row a feature
    values = [row["importance"] for row in rows]
    adds_up = abs(sum(values) - 1) < SLACK and min(values) >= 0
    return ranked.select("feature", F.lit(train.count()).cast("long").alias("n_train"), F.lit(adds_up).alias("adds_up"),
                         F.lit(values == sorted(values, reverse=True)).alias("in_order"))
