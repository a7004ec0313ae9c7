"""Window frames over integer time, and halo chunks that bound every window group.

A frame such as ``[t-23, t]`` is a range over ``hour_idx``: an absent hour is simply
not in the frame, so lags and sums keep their meaning on series with gaps without
materialising the missing hours.

A window group is normally one series. ``chunk_len`` cuts a series into chunks and
copies the rows within reach of a chunk's edge into it (the halo), so one long
series spreads over many tasks and a group never exceeds chunk + halo rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"


def exactly(w: WindowSpec, value: Column, offset: int) -> Column:
    """Value at exactly ``offset`` steps from the current row; NULL when absent."""
    return F.first(value).over(w.rangeBetween(offset, offset))


def trailing(w: WindowSpec, agg: Column, length: int) -> Column:
    """Aggregate over the last ``length`` steps, current one included."""
    return agg.over(w.rangeBetween(-(length - 1), 0))


def with_halo(df: DataFrame, idx: str, chunk_len: int, back: int, ahead: int) -> DataFrame:
    """Assign rows to their chunk and to the neighbours that need them."""
    if back > chunk_len or ahead > chunk_len:
        raise ValueError("a chunk must be at least as long as the look-back and the look-ahead")
    own = F.floor(F.col(idx) / chunk_len)
    offset = F.pmod(F.col(idx), F.lit(chunk_len))
    homes = [own]
    if back:
        homes.append(F.when(offset >= chunk_len - back, own + 1))
    if ahead:
        homes.append(F.when(offset < ahead, own - 1))
    return df.withColumn(CHUNK, F.explode(F.array_compact(F.array(*homes))))


def add_windowed(
    df: DataFrame,
    keys: list[str],
    idx: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    chunk_len: int | None = None,
) -> DataFrame:
    """Add window columns over each series, whole or in halo chunks."""
    if chunk_len is None:
        w = Window.partitionBy(*keys).orderBy(idx)
        return df.select("*", *[c.alias(n) for n, c in columns(w).items()])
    w = Window.partitionBy(*keys, CHUNK).orderBy(idx)
    spread = with_halo(df, idx, chunk_len, back, ahead)
    out = spread.select("*", *[c.alias(n) for n, c in columns(w).items()])
    return out.filter(F.col(CHUNK) == F.floor(F.col(idx) / chunk_len)).drop(CHUNK)


def fill_gaps(
    df: DataFrame, keys: list[str], idx: str, values: list[str], first_at: Column | None = None
) -> DataFrame:
    """Insert the missing steps between a series' rows, with NULL ``values``.

    Each row expands to itself plus the gap up to the next row, so there is no
    calendar table, no join and no second pass over the input. ``first_at`` (a
    column over the same groups) also fills before the first row. The result has
    ``filled`` = true on inserted rows. ``idx`` must be unique within a series.
    """
    w = Window.partitionBy(*keys).orderBy(idx)
    step = F.col(idx)
    ends = F.coalesce(F.lead(step).over(w) - 1, step)
    starts = step
    if first_at is not None:
        starts = F.when(F.lag(step).over(w).isNull(), F.least(step, first_at)).otherwise(step)
    spans = df.select("*", starts.alias("_from"), ends.alias("_to"))
    rows = spans.select(
        *keys,
        F.explode(F.sequence("_from", "_to")).alias("_step"),
        F.col(idx).alias("_own"),
        *values,
    )
    inserted = F.col("_step") != F.col("_own")
    return rows.select(
        *keys,
        F.col("_step").alias(idx),
        *[F.when(~inserted, F.col(v)).alias(v) for v in values],
        inserted.alias("filled"),
    )
