"""Keep-last, append and splice.

Keep-last is a maximum over (arrival, payload) rather than a ranking window: copies
collapse before the shuffle, so a key with very many copies costs one row per map
task instead of one sorted group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.text import bare_code

READING_KEY = ["fechaobservacion", "codigoestacion", "codigosensor"]


def keep_last(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """One row per key: the latest by ``arrival``; equal arrivals resolve by value."""
    rest = [c for c in df.columns if c not in keys and c not in arrival]
    payload = F.struct(*[F.col(c) for c in arrival + rest])
    latest = df.groupBy(*keys).agg(F.max(payload).alias("_last"))
    return latest.select(
        *[F.col(c) if c in keys else F.col("_last").getField(c).alias(c) for c in df.columns]
    )


def keep_last_if_keyed(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Keep-last only when every key column exists; otherwise the rows pass unchanged."""
    return keep_last(df, keys, arrival) if set(keys) <= set(df.columns) else df


def normalise_codes(df: DataFrame) -> DataFrame:
    """Codes without leading zeros and ISO times as timestamps, where those columns exist."""
    fixes = {c: bare_code(F.col(c)) for c in ("codigoestacion", "codigosensor") if c in df.columns}
    if "fechaobservacion" in df.columns:
        text = F.col("fechaobservacion").cast("string")
        fixes["fechaobservacion"] = text.try_cast("timestamp_ntz")
    return df.withColumns(fixes) if fixes else df


def append_readings(
    existing: DataFrame | None, batch: DataFrame, arrival: str = "arrival"
) -> DataFrame:
    """Union of old and new readings, last arrival per key, plus ``is_new``.

    The key shrinks to the columns present on both sides; without any the batch is
    simply appended. Rows of ``existing`` always arrived before the batch.
    """
    new = normalise_codes(batch)
    if arrival not in new.columns:
        new = new.withColumn(arrival, F.lit(0))
    parts = new.withColumn("_origin", F.lit(1))
    keys = [k for k in READING_KEY if k in new.columns]
    if existing is not None:
        old = normalise_codes(existing)
        if arrival not in old.columns:
            old = old.withColumn(arrival, F.lit(0))
        keys = [k for k in keys if k in old.columns]
        parts = old.withColumn("_origin", F.lit(0)).unionByName(parts, allowMissingColumns=True)
    if not keys:
        return parts.withColumn("is_new", F.col("_origin") == 1).drop("_origin")
    rest = [c for c in parts.columns if c not in keys and c not in ("_origin", arrival)]
    payload = F.struct("_origin", arrival, *rest)
    merged = parts.groupBy(*keys).agg(
        F.max(payload).alias("_last"), (F.min("_origin") == 1).alias("is_new")
    )
    return merged.select(
        *keys, *[F.col("_last").getField(c).alias(c) for c in [arrival, *rest]], "is_new"
    )


def new_row_counts(appended: DataFrame, keys: list[str]) -> DataFrame:
    """Keys added by the batch, per group; groups without new rows count 0."""
    return appended.groupBy(*keys).agg(F.count_if("is_new").alias("new_rows"))


def splice(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    idx: str = "hour_idx",
    warm_up: int = 24,
    overlap: int = 48,
) -> DataFrame:
    """Old rows before the cut, new rows from it on; one series may be missing on a side.

    The cut is the later of (new start + warm-up) and (old end - overlap).
    """
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    w = Window.partitionBy(*keys)
    start = F.min(F.when(F.col("_new"), F.col(idx))).over(w)
    end = F.max(F.when(~F.col("_new"), F.col(idx))).over(w)
    cut = F.greatest(start + warm_up, end - overlap)
    keep = (
        F.when(start.isNull() | end.isNull(), F.lit(True))
        .when(F.col("_new"), F.col(idx) >= cut)
        .otherwise(F.col(idx) < cut)
    )
    return both.withColumn("_keep", keep).filter("_keep").drop("_keep", "_new")
