"""Label, threshold and metric queries over the surrogate probability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.plans import evaluation as ev
from freshet.queries import query
from freshet.queries.base import KEYS, dataset, held_out, labelled, r6, series
from freshet.queries.sql import r, with_ctes

HELD = "FROM held_out GROUP BY basin"


def _call():
    return (F.col("proba_alerta") >= 0.3).cast("int")


SQL_CALL = "CAST(proba_alerta >= 0.3 AS INTEGER)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


@query(
    "label_counts", "H10 D42 J7",
    with_ctes("SELECT basin, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM labelled GROUP BY ALL", "labelled"),
)
def label_counts(spark, sf_dir):
    return ev.label_stats(labelled(spark, sf_dir), KEYS)


@query(
    "balanced_class_weights", "D40",
    with_ctes(
        f"""SELECT basin, label, count(*) AS n, {r('any_value(n) / (2.0 * count(*))')} AS class_weight
            FROM (SELECT *, count(*) OVER (PARTITION BY basin) AS n FROM labelled WHERE split = 'train')
            GROUP BY basin, label""", "labelled"),
)
def balanced_class_weights(spark, sf_dir):
    train = labelled(spark, sf_dir).filter("split = 'train'")
    weighted = ev.with_class_weights(train, KEYS)
    return r6(weighted.groupBy("basin", "label").agg(
        F.count(F.lit(1)).alias("n"), F.max("class_weight").alias("class_weight")
    ))


def _sweep_sql(variants: list[str], thresholds: list[float]) -> dict[str, str]:
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    parts = " UNION ALL ".join(f"SELECT basin, label, '{v}' AS variant, {v} AS p FROM held_out" for v in variants)
    return {
        "variants": parts,
        "counts": f"""SELECT basin, variant, umbral, count(*) FILTER (p >= umbral AND label = 1) AS tp,
            count(*) FILTER (p >= umbral AND label = 0) AS fp, count(*) FILTER (p < umbral AND label = 1) AS fn
          FROM variants CROSS JOIN (VALUES {values}) t(umbral) GROUP BY ALL""",
        "rates": f"SELECT *, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('tp', 'tp + fp')} AS precision FROM counts",
        "sweep": "SELECT *, CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rates",
    }


SWEEP_COLS = f"basin, variant, umbral, tp, fp, fn, {r('recall')} AS recall, {r('precision')} AS precision, {r('f1')} AS f1"


@query(
    "threshold_sweep", "D24 H16",
    with_ctes(f"SELECT {SWEEP_COLS} FROM sweep", "held_out", **_sweep_sql(["proba_modelo"], ev.SWEEP)),
)
def threshold_sweep(spark, sf_dir):
    return r6(ev.threshold_table(held_out(spark, sf_dir), ev.SWEEP, ["proba_modelo"], KEYS))


@query(
    "recommended_threshold", "D25",
    with_ctes(
        f"""SELECT {SWEEP_COLS}, recall >= 0.85 AS reaches_target FROM sweep
            QUALIFY row_number() OVER (PARTITION BY basin ORDER BY CASE WHEN recall >= 0.85 THEN 0 ELSE 1 END,
              CASE WHEN recall >= 0.85 THEN 0 ELSE -recall END, umbral) = 1""",
        "held_out", **_sweep_sql(["proba_modelo"], ev.SWEEP)),
)
def recommended_threshold(spark, sf_dir):
    table = ev.threshold_table(held_out(spark, sf_dir), ev.SWEEP, ["proba_modelo"], KEYS)
    return r6(ev.recommended_threshold(table, KEYS))


@query(
    "raw_and_adjusted_metrics", "D26",
    with_ctes(f"SELECT {SWEEP_COLS} FROM sweep", "held_out",
              **_sweep_sql(["proba_modelo", "proba_alerta"], ev.REPORTED)),
)
def raw_and_adjusted_metrics(spark, sf_dir):
    rows = held_out(spark, sf_dir)
    return r6(ev.threshold_table(rows, ev.REPORTED, ["proba_modelo", "proba_alerta"], KEYS))


EXPECTED = {"recall": 1.0, "precision": 0.38}


@query(
    "metric_drift", "D28",
    with_ctes(
        f"""SELECT {SWEEP_COLS}, {r('abs(recall - 1.0)')} AS recall_diff, {r('abs(precision - 0.38)')} AS precision_diff,
              greatest(abs(recall - 1.0), abs(precision - 0.38)) <= 0.01 AS ok FROM sweep WHERE umbral = 0.2::DOUBLE""",
        "held_out", **_sweep_sql(["proba_modelo"], ev.REPORTED)),
)
def metric_drift(spark, sf_dir):
    table = ev.threshold_table(held_out(spark, sf_dir), ev.REPORTED, ["proba_modelo"], KEYS)
    return r6(ev.drift(table, EXPECTED))


@query(
    "suppressed_warnings", "D27 H4",
    with_ctes(
        """SELECT basin, count(*) FILTER (proba_modelo >= 0.3 AND proba_alerta < 0.3) AS suppressed
           FROM log GROUP BY basin""", "log"),
)
def suppressed_warnings(spark, sf_dir):
    from freshet.queries.base import scored_rows

    return ev.suppressed(scored_rows(spark, sf_dir), KEYS)


CONFUSION = f"""SELECT basin, count(*) FILTER (label = 0 AND {SQL_CALL} = 0) AS tn, count(*) FILTER (label = 0 AND {SQL_CALL} = 1) AS fp,
  count(*) FILTER (label = 1 AND {SQL_CALL} = 0) AS fn, count(*) FILTER (label = 1 AND {SQL_CALL} = 1) AS tp {HELD}"""


@query("confusion_matrix", "D21", with_ctes(CONFUSION, "held_out"))
def confusion_matrix(spark, sf_dir):
    return ev.confusion(held_out(spark, sf_dir), _call(), KEYS)


@query(
    "always_negative_baseline", "D23",
    with_ctes(
        f"""SELECT basin, tn, fp, fn, tp, {r('(tp + tn) / (tn + fp + fn + tp)')} AS accuracy,
              {r(_ratio('tp', 'tp + fp'))} AS precision, {r(_ratio('tp', 'tp + fn'))} AS recall,
              {r('(tn + fp) / (tn + fp + fn + tp)')} AS base_accuracy, 0.0::DOUBLE AS base_precision,
              0.0::DOUBLE AS base_recall, {r(_ratio('tp', 'tp + fn'))} AS recall_gain FROM c""",
        "held_out", c=CONFUSION),
)
def always_negative_baseline(spark, sf_dir):
    return r6(ev.against_always_negative(held_out(spark, sf_dir), _call(), KEYS))


@query(
    "classification_report", "D22",
    with_ctes(
        f"""SELECT basin, {r('(tp + tn) / (n0 + n1)')} AS accuracy, class, {r('p')} AS precision, {r('rec')} AS recall, {r('f')} AS f1, support FROM (
              SELECT *, '0' AS class, p0 AS p, r0 AS rec, f0 AS f, n0 AS support FROM m
              UNION ALL SELECT *, '1', p1, r1, f1, n1 FROM m
              UNION ALL SELECT *, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM m
              UNION ALL SELECT *, 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
                (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM m)""",
        "held_out", c=CONFUSION,
        pr=f"""SELECT *, tn + fp AS n0, tp + fn AS n1, {_ratio('tp', 'tp + fp')} AS p1, {_ratio('tp', 'tp + fn')} AS r1,
                 {_ratio('tn', 'tn + fn')} AS p0, {_ratio('tn', 'tn + fp')} AS r0 FROM c""",
        m=f"SELECT *, {_ratio('2 * p0 * r0', 'p0 + r0')} AS f0, {_ratio('2 * p1 * r1', 'p1 + r1')} AS f1 FROM pr"),
)
def classification_report(spark, sf_dir):
    return r6(ev.classification_report(held_out(spark, sf_dir), _call(), KEYS))


@query(
    "dry_hour_base_rate", "D29",
    with_ctes(
        f"""SELECT basin, count(*) FILTER (split = 'train' AND roll_sum_24h <= 0) AS dry_hours,
              count(*) FILTER (split = 'train' AND roll_sum_24h <= 0 AND label = 1) AS dry_positives,
              {r("count(*) FILTER (split = 'train' AND roll_sum_24h <= 0 AND label = 1) / nullif(count(*) FILTER (split = 'train' AND roll_sum_24h <= 0), 0)")} AS base_rate
            FROM labelled GROUP BY basin""", "labelled"),
)
def dry_hour_base_rate(spark, sf_dir):
    return r6(ev.dry_base_rate(labelled(spark, sf_dir), KEYS))


def _metrics_sql(pred: str, side: str) -> str:
    return f"""avg(abs(y - {pred})) AS {side}_mae, sqrt(avg((y - {pred}) * (y - {pred}))) AS {side}_rmse,
      CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) > 0 THEN 1 - sum((y - {pred}) * (y - {pred})) / (var_pop(y) * count(*))
           WHEN sum((y - {pred}) * (y - {pred})) = 0 THEN 1.0 ELSE 0.0 END AS {side}_r2"""


REGRESSION_SQL = with_ctes(
    f"""SELECT basin, subset, n, {', '.join(f'{r(f"{s}_{m}")} AS {s}_{m}' for s in ('base', 'model') for m in ('mae', 'rmse', 'r2'))},
          {r('base_mae - model_mae')} AS gain_mae, {r('base_rmse - model_rmse')} AS gain_rmse, {r('model_r2 - base_r2')} AS gain_r2,
          base_mae > model_mae AND base_rmse > model_rmse AND model_r2 > base_r2 AS beats
        FROM b LEFT JOIN m USING (basin, subset)""",
    "held_out", "proxy",
    t="""SELECT h.basin, h.target_6h AS y, h.p75, q.Q_scs_proxy AS base, 0.8::DOUBLE * h.Q_actual + 0.02::DOUBLE * h.roll_sum_24h AS model
         FROM held_out h JOIN proxy q USING (basin, hour_idx)""",
    s="""SELECT *, 'all' AS subset FROM t UNION ALL SELECT *, 'target > 0' FROM t WHERE y > 0
         UNION ALL SELECT *, 'target > p75' FROM t WHERE y > p75""",
    m=f"SELECT basin, subset, {_metrics_sql('base', 'base')}, {_metrics_sql('model', 'model')} FROM s GROUP BY basin, subset",
    b="""SELECT d.basin, u.subset, count(s.y) AS n FROM (SELECT DISTINCT basin FROM t) d
         CROSS JOIN (VALUES ('all'), ('target > 0'), ('target > p75')) u(subset)
         LEFT JOIN s ON s.basin = d.basin AND s.subset = u.subset GROUP BY ALL""",
)


@query("regression_against_persistence", "C3 J4 D17 D18 D19 D20", REGRESSION_SQL)
def regression_against_persistence(spark, sf_dir):
    rows = ev.with_persistence(dataset(spark, sf_dir), series(spark, sf_dir), KEYS)
    p75 = ev.train_quantile("target_6h", 0.75).over(Window.partitionBy(*KEYS))
    model = F.col("Q_actual") * 0.8 + F.col("roll_sum_24h") * 0.02
    rows = rows.withColumns({"p75_train": p75, "model": model})
    return r6(ev.regression_report(rows, "target_6h", "persistence", "model", KEYS))


_STATS = ", ".join(
    f"{r(f'{fn}({c})')} AS {c}_{n}" for c in ("sample_weight", "delta") for fn, n in (("min", "min"), ("max", "max"), ("avg", "mean"))
)


@query(
    "sample_weight_and_delta_stats", "H11 D42",
    with_ctes(
        f"SELECT basin, split, count(*) AS n, {_STATS} FROM w GROUP BY ALL", "ds6",
        w="""SELECT basin, split, target_6h - Q_actual AS delta, CASE WHEN top > 0 THEN 1 + target_6h / top * 20 END AS sample_weight
             FROM ds6 JOIN (SELECT basin, max(target_6h) FILTER (split = 'train') AS top FROM ds6 GROUP BY basin) USING (basin)"""),
)
def sample_weight_and_delta_stats(spark, sf_dir):
    rows = ev.with_sample_weights(dataset(spark, sf_dir), "target_6h", KEYS)
    return r6(ev.weight_delta_stats(rows, KEYS))
