"""Labels, thresholds and metrics.

Every metric is one aggregation with conditional terms: several thresholds, subsets or
variants are computed side by side in the same pass instead of multiplying the rows.
Per-series quantiles are window columns, so the dataset is read once; a series has at
most one row per hour. Aggregations take empty ``keys`` for one result over everything;
window columns do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import rules

# Fixed values of the evaluation protocol.
SWEEP = [0.5, 0.4, 0.3, 0.2, 0.15, 0.1]
REPORTED = [0.20, 0.30, 0.70]
TARGET_RECALL = 0.85
DRIFT_TOLERANCE = 0.01
EVENT_WEIGHT = 20.0


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def until(df: DataFrame, cutoff: str, ts: str = "timestamp") -> DataFrame:
    """Rows inside the frozen evaluation window, its last hour included."""
    return df.filter(F.col(ts) <= F.lit(cutoff).cast("timestamp_ntz"))


def split_sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test; fails when either is empty."""
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    if train.isEmpty() or test.isEmpty():
        raise ValueError("invalid split: train or test is empty")
    return train, test


def train_quantile(target: str, p: float) -> Column:
    """Exact quantile with linear interpolation, of the train rows only."""
    return F.percentile(F.when(F.col("split") == "train", F.col(target)), p)


def _group(keys: list[str]):
    if not keys:
        raise ValueError("window columns are per series: keys must not be empty")
    return Window.partitionBy(*keys)


def with_label(df: DataFrame, target: str, keys: list[str], p: float = 0.90) -> DataFrame:
    """Add the train quantile and ``label`` = target strictly above it."""
    q = train_quantile(target, p).over(_group(keys))
    out = df.withColumn("train_quantile", q)
    return out.withColumn("label", (F.col(target) > F.col("train_quantile")).cast("int"))


def quantiles(df: DataFrame, target: str, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        train_quantile(target, 0.90).alias("p90_train"),
        train_quantile(target, 0.75).alias("p75_train"),
        F.percentile(value, 0.95).alias("p95_all"),
    )


def with_class_weights(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Balanced weights n / (2 * class size), per series or (no keys) over all given rows.

    Without keys the two class sizes are counted first, so no window spans all rows.
    """
    if not keys:
        n, ones = df.agg(F.count(label), F.count_if(F.col(label) == 1)).first()
        size = F.when(F.col(label) == 1, F.lit(ones)).otherwise(F.lit(n - ones))
        return df.withColumn("class_weight", F.lit(n) / (2 * size))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, label))
    return df.withColumn("class_weight", n / (2 * same))


def with_sample_weights(df: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Weights 1 + 20 y / max(y) of the train rows, and the change from the current value.

    Per series, those whose largest train target is not positive have no weights (NULL). Without keys the
    largest train target of all rows counts, every row has a weight, and a largest target that is not
    positive is an error.
    """
    if not keys:
        largest = df.filter("split = 'train'").agg(F.max(target)).first()[0]
        if largest is None or largest <= 0:
            raise ValueError(f"no positive {target} among the train rows")
        weight = 1 + F.col(target) / F.lit(largest) * EVENT_WEIGHT
        return df.withColumns({"sample_weight": weight, "delta": F.col(target) - F.col("Q_actual")})
    top = F.max(F.when(F.col("split") == "train", F.col(target))).over(_group(keys))
    weight = F.when(top > 0, 1 + F.col(target) / top * EVENT_WEIGHT)
    return df.withColumns({"sample_weight": weight, "delta": F.col(target) - F.col("Q_actual")})


def weight_delta_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """min / max / mean of weights and deltas per split."""
    aggs = []
    for c in ("sample_weight", "delta"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean")]
    return df.groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("n"), *aggs)


def label_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")
    )


def threshold_table(
    df: DataFrame,
    thresholds: list[float],
    probabilities: list[str],
    keys: list[str],
    label: str = "label",
) -> DataFrame:
    """Recall, precision, F1 and counts at each threshold, per probability column."""
    y = F.col(label)
    aggs = [F.count_if(y == 1).alias("_pos")]
    for i, p in enumerate(probabilities):
        for j, t in enumerate(thresholds):
            hit = F.col(p) >= t
            aggs.append(F.count_if(hit & (y == 1)).alias(f"_tp_{i}_{j}"))
            aggs.append(F.count_if(hit & (y == 0)).alias(f"_fp_{i}_{j}"))
    counts = df.groupBy(*keys).agg(*aggs)
    rows = [
        F.struct(
            F.lit(p).alias("variant"),
            F.lit(float(t)).alias("umbral"),
            F.col(f"_tp_{i}_{j}").alias("tp"),
            F.col(f"_fp_{i}_{j}").alias("fp"),
            (F.col("_pos") - F.col(f"_tp_{i}_{j}")).alias("fn"),
        )
        for i, p in enumerate(probabilities)
        for j, t in enumerate(thresholds)
    ]
    long = counts.select(*keys, F.inline(F.array(*rows)))
    scored = long.withColumns(
        {
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        }
    )
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def recommended_threshold(table: DataFrame, keys: list[str], recall: float = TARGET_RECALL) -> DataFrame:
    """Lowest threshold that reaches the recall; otherwise the best recall, lowest threshold."""
    reaches = F.col("recall") >= recall
    rest = [c for c in table.columns if c not in keys]
    rank = F.struct(
        F.when(reaches, 0).otherwise(1).alias("_short"),
        F.when(reaches, 0.0).otherwise(-F.col("recall")).alias("_loss"),
        F.col("umbral").alias("_umbral"),
        *rest,
    )
    best = table.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return best.select(
        *keys,
        *[F.col("_best").getField(c).alias(c) for c in rest],
        (F.col("_best").getField("_short") == 0).alias("reaches_target"),
    )


def confusion(df: DataFrame, predicted: Column, keys: list[str], label: str = "label") -> DataFrame:
    """Counts of the four outcomes, all present even when zero."""
    y = F.col(label)
    return df.groupBy(*keys).agg(
        F.count_if((y == 0) & (predicted == 0)).alias("tn"),
        F.count_if((y == 0) & (predicted == 1)).alias("fp"),
        F.count_if((y == 1) & (predicted == 0)).alias("fn"),
        F.count_if((y == 1) & (predicted == 1)).alias("tp"),
    )


def summary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision and recall of the positive class from confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
        }
    )


def against_always_negative(df: DataFrame, predicted: Column, keys: list[str]) -> DataFrame:
    """Model metrics next to those of never predicting an event."""
    model = summary_metrics(confusion(df, predicted, keys))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    base = model.withColumns(
        {
            "base_accuracy": ratio(F.col("tn") + F.col("fp"), n),
            "base_precision": F.lit(0.0),
            "base_recall": F.lit(0.0),
        }
    )
    return base.withColumn("recall_gain", F.col("recall") - F.col("base_recall"))


def classification_report(df: DataFrame, predicted: Column, keys: list[str]) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support; undefined ratios count 0."""
    c = confusion(df, predicted, keys)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = ratio(tp, tp + fp), ratio(tp, tp + fn)
    p0, r0 = ratio(tn, tn + fn), ratio(tn, tn + fp)
    n0, n1 = tn + fp, tp + fn
    per_class = {"0": (p0, r0, f1(p0, r0), n0), "1": (p1, r1, f1(p1, r1), n1)}
    pairs = list(zip(per_class["0"][:3], per_class["1"][:3]))
    per_class["macro avg"] = (*[(a + b) / 2 for a, b in pairs], n0 + n1)
    per_class["weighted avg"] = (*[ratio(a * n0 + b * n1, n0 + n1) for a, b in pairs], n0 + n1)
    rows = [
        F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
            f.alias("f1"), n.alias("support"),
        )
        for name, (p, r, f, n) in per_class.items()
    ]
    accuracy = ratio(tp + tn, n0 + n1).alias("accuracy")
    return c.select(*keys, accuracy, F.inline(F.array(*rows)))


def suppressed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings of the raw probability that the dry rule withdrew."""
    gone = (F.col("proba_modelo") >= rules.CAUTION_AT) & (F.col("proba_alerta") < rules.CAUTION_AT)
    return df.groupBy(*keys).agg(F.count_if(gone).alias("suppressed"))


def drift(table: DataFrame, expected: dict[str, float], at: float = 0.20) -> DataFrame:
    """Distance of recall and precision at one threshold from expected values."""
    row = table.filter(F.col("umbral") == at)
    return row.withColumns(
        {
            "recall_diff": F.abs(F.col("recall") - expected["recall"]),
            "precision_diff": F.abs(F.col("precision") - expected["precision"]),
        }
    ).withColumn(
        "ok", F.greatest("recall_diff", "precision_diff") <= DRIFT_TOLERANCE
    )


def dry_base_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of train hours without rain in 24 h that were followed by an event."""
    dry = (F.col("split") == "train") & (F.col("roll_sum_24h") <= rules.DRY_RAIN_MM)
    return df.groupBy(*keys).agg(
        F.count_if(dry).alias("dry_hours"),
        F.count_if(dry & (F.col("label") == 1)).alias("dry_positives"),
    ).withColumn("base_rate", F.try_divide(F.col("dry_positives").cast("double"), "dry_hours"))


def _regression(y: Column, pred: Column, keep: Column, prefix: str) -> list[Column]:
    """MAE, RMSE and R2 aggregates over the rows in ``keep``."""
    def on(c):
        return F.when(keep, c)

    residual = F.sum(on((y - pred) * (y - pred)))
    n = F.count(on(y))
    total = F.var_pop(on(y)) * n
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(total > 0, 1 - F.try_divide(residual, total))
        .when(residual == 0, 1.0)
        .otherwise(0.0)
    )
    return [
        F.avg(on(F.abs(y - pred))).alias(f"{prefix}_mae"),
        F.sqrt(F.avg(on((y - pred) * (y - pred)))).alias(f"{prefix}_rmse"),
        r2.alias(f"{prefix}_r2"),
    ]


def regression_report(
    df: DataFrame, target: str, baseline: str, model: str, keys: list[str]
) -> DataFrame:
    """Metrics of model and baseline on the test rows: all, events, and strong events.

    Needs ``p75_train`` on the rows (a window of ``train_quantile(target, 0.75)``).
    Gains are positive when the model is better; ``beats`` wants all three. Subsets
    without rows have NULL metrics.
    """
    y = F.col(target)
    subsets = {"all": F.lit(True), "target > 0": y > 0, "target > p75": y > F.col("p75_train")}
    aggs = []
    for i, keep in enumerate(subsets.values()):
        aggs.append(F.count(F.when(keep, y)).alias(f"_{i}_n"))
        aggs += _regression(y, F.col(baseline), keep, f"_{i}_base")
        aggs += _regression(y, F.col(model), keep, f"_{i}_model")
    wide = df.filter("split = 'test'").groupBy(*keys).agg(*aggs)
    metrics = ("mae", "rmse", "r2")
    rows = [
        F.struct(
            F.lit(name).alias("subset"),
            F.col(f"_{i}_n").alias("n"),
            *[F.col(f"_{i}_{side}_{m}").alias(f"{side}_{m}") for side in ("base", "model") for m in metrics],
        )
        for i, name in enumerate(subsets)
    ]
    long = wide.select(*keys, F.inline(F.array(*rows)))
    gains = {
        "gain_mae": F.col("base_mae") - F.col("model_mae"),
        "gain_rmse": F.col("base_rmse") - F.col("model_rmse"),
        "gain_r2": F.col("model_r2") - F.col("base_r2"),
    }
    better = (F.col("gain_mae") > 0) & (F.col("gain_rmse") > 0) & (F.col("gain_r2") > 0)
    return long.withColumns(gains).withColumn("beats", better)


def with_persistence(df: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the series' runoff at the same hour as baseline; fails in flight if absent."""
    q = series.select(*keys, "hour_idx", F.col("Q_scs_proxy").alias("persistence"))
    joined = df.join(q, [*keys, "hour_idx"], "left")
    present = F.when(F.col("persistence").isNotNull(), F.col("persistence")).otherwise(
        F.raise_error(F.lit("persistence baseline has no runoff for some test hour")).cast("double")
    )
    return joined.withColumn("persistence", present)


def importance_by_family(importances: DataFrame) -> DataFrame:
    """Weight of rain dynamics and of the calendar, and which dominates."""
    calendar = F.col("feature").isin("hora_dia", "mes")
    return importances.groupBy().agg(
        F.sum(F.when(~calendar, F.col("importance")).otherwise(0.0)).alias("rain"),
        F.sum(F.when(calendar, F.col("importance")).otherwise(0.0)).alias("calendar"),
    ).withColumn("calendar_dominates", F.col("calendar") > F.col("rain"))
