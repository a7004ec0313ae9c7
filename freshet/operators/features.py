"""Past-only features, future targets and the chronological split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.functions.timegrid import hour_of_day
from freshet.operators.frames import add_windowed, exactly, trailing
from freshet.operators.series import quality_split, timestamped

# A month of hours: the group size when a long series is cut into halo chunks.
CHUNK_HOURS = 31 * 24


def feature_rows(
    quality: DataFrame,
    horizons: tuple[int, ...] = (),
    keys: list[str] | None = None,
    chunk_len: int | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """The 18 features (and ``target_{h}h`` columns) at every hour of good quality.

    ``quality`` holds only hours with enough stations; an hour that was set aside is
    absent from every frame, exactly like an hour that never reported. Hours whose
    values were masked to NULL count the same way. ``carry`` keeps further columns.
    """
    carry = carry or []
    keys = keys or ["basin"]

    def columns(w):
        rain, q = F.col("P_basin"), F.col("Q_scs_proxy")
        out = {f"lag_{h}h": exactly(w, rain, -h) for h in S.RAIN_LAGS}
        out |= {f"Q_lag_{h}h": exactly(w, q, -h) for h in S.RUNOFF_LAGS}
        out |= {f"roll_sum_{h}h": trailing(w, F.sum(rain), h) for h in S.RAIN_SUMS}
        out[f"roll_max_{S.PEAK_HOURS}h"] = trailing(w, F.max(rain), S.PEAK_HOURS)
        out |= {f"target_{h}h": exactly(w, q, h) for h in horizons}
        return out

    base = quality.select(*keys, "hour_idx", "P_basin", "Q_scs_proxy", *carry)
    wide = add_windowed(
        base, keys, "hour_idx", columns,
        back=S.LOOK_BACK_HOURS, ahead=max(horizons, default=0), chunk_len=chunk_len,
    )
    stamped = timestamped(wide).withColumns(
        {
            "Q_actual": F.col("Q_scs_proxy"),
            "hora_dia": hour_of_day(F.col("hour_idx")),
            "mes": F.month("timestamp"),
        }
    )
    return stamped.select(
        *keys, "hour_idx", "timestamp", *S.FEATURES, *[f"target_{h}h" for h in horizons], *carry
    )


def complete(df: DataFrame, *extra: str) -> DataFrame:
    """Rows with every feature (and the named columns) present."""
    return df.dropna(subset=[*S.FEATURES, *extra])


def feature_columns(df: DataFrame, target: str, keys: tuple[str, ...] = ("basin", "hour_idx")) -> list[str]:
    """Every column that is not a key, the time, the target or the split."""
    return [c for c in df.columns if c not in {*keys, "timestamp", target, "split"}]


def chronological_split(
    df: DataFrame,
    keys: list[str] | None = None,
    idx: str = "hour_idx",
    fraction: float = S.TRAIN_FRACTION,
    previous_cut: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: the earliest share is train, the rest test.

    At least one row stays on each side when there are two or more. A series listed
    in ``previous_cut`` (keys, ``cut_idx``) keeps that cut instead.
    """
    keys = keys or ["basin"]
    group = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(group)
    size = F.floor(n * F.lit(fraction))
    size = F.when(n > 1, F.greatest(F.lit(1), F.least(size, n - 1))).otherwise(F.lit(1))
    fresh = F.when(F.row_number().over(group.orderBy(idx)) <= size, "train").otherwise("test")
    out = df.withColumn("split", fresh)
    if previous_cut is None:
        return out
    kept = F.when(F.col(idx) >= F.col("cut_idx"), "test").otherwise("train")
    joined = out.join(previous_cut.select(*keys, "cut_idx"), keys, "left")
    return joined.withColumn(
        "split", F.when(F.col("cut_idx").isNotNull(), kept).otherwise(F.col("split"))
    ).drop("cut_idx")


def existing_cut(
    dataset: DataFrame | None, keys: list[str] | None = None, idx: str = "hour_idx"
) -> DataFrame | None:
    """First test row of an earlier dataset; None when it has no usable split."""
    keys = keys or ["basin"]
    if dataset is None or not {idx, "split", *keys} <= set(dataset.columns):
        return None
    return dataset.filter("split = 'test'").groupBy(*keys).agg(F.min(idx).alias("cut_idx"))


def dataset(
    series: DataFrame,
    horizon: int,
    keys: list[str] | None = None,
    chunk_len: int | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Complete feature rows with target and split, from an hourly basin series."""
    quality, _ = quality_split(series)
    rows = feature_rows(quality, (horizon,), keys, chunk_len)
    rows = complete(rows, f"target_{horizon}h")
    return chronological_split(rows, keys, previous_cut=existing_cut(previous, keys))
