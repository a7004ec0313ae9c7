"""Sliding quantiles over long frames, in halo chunks of days.

A series is cut into chunks of a few frames' length; the rows before a chunk that its frames reach are copied into it
(``operators.frames``), so one group is bounded and any number of quantiles comes from one shuffle. Inside a chunk the
count of every distinct value is carried from row to row: a row costs one pass over the distinct values, however long the frame is, and
results are exact. The built-in ``percentile`` over a range frame collects the whole frame again for every row, which is why this one
operator works in numpy inside the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.frames import CHUNK, with_halo
from freshet.session import ship

FRAMES = 3  # longest frames in a chunk
CELLS = 1 << 18  # counts held at once while a chunk is walked


def frame_quantiles(at: np.ndarray, value: np.ndarray, own: int, length: int, q: float) -> np.ndarray:
    """Interpolated quantile over the last ``length`` steps at each row from number ``own`` on; rows are sorted by step."""
    values, rank = np.unique(value, return_inverse=True)
    rows = len(at) - own
    leaves = np.searchsorted(at[own:], at + length, side="left")  # the first own row whose frame lacks the row
    first = np.searchsorted(leaves, 1)  # rows before are in no frame
    counts = np.bincount(rank[first:own], minlength=len(values))
    step = max(16, CELLS // len(values))
    out = np.empty(rows)
    for a in range(0, rows, step):
        b = min(a + step, rows)
        change = np.zeros((b - a, len(values)), np.int64)
        change[np.arange(b - a), rank[own + a : own + b]] = 1
        lo, hi = np.searchsorted(leaves, [max(a, 1), b])
        np.subtract.at(change, (leaves[lo:hi] - a, rank[lo:hi]), 1)
        change[0] += counts
        held = np.cumsum(change, axis=0)
        counts = held[-1]
        upto = np.cumsum(held, axis=1)
        place = (upto[:, -1] - 1) * q
        low = np.floor(place)
        under = values[(upto > low[:, None]).argmax(axis=1)]
        over = values[(upto > np.minimum(low + 1, upto[:, -1] - 1)[:, None]).argmax(axis=1)]
        out[a:b] = under + (over - under) * (place - low)
    return out


def with_sliding_quantiles(
    df: DataFrame, keys: list[str], idx: str, per_day: int, wanted: dict[str, tuple[str, int, float]]
) -> DataFrame:
    """The rows with, for each name in ``wanted`` (value, days, q), the quantile of ``value`` over the last ``days * per_day`` steps, the
    row's included.

    ``idx`` is an integer step, unique in a series; the values are whole numbers and not null.
    """
    longest = max(days for _, days, _ in wanted.values()) * per_day
    chunk_len = FRAMES * longest
    ship(df.sparkSession)

    def of_chunk(key: tuple, chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(idx)
        at = chunk.column(idx).to_numpy()
        own = int(np.searchsorted(at, key[-1].as_py() * chunk_len))
        made = {n: frame_quantiles(at, chunk.column(v).to_numpy(), own, days * per_day, q) for n, (v, days, q) in wanted.items()}
        out = chunk.slice(own).drop_columns([CHUNK])
        for name, found in made.items():
            out = out.append_column(name, pa.array(found, pa.float64()))
        return out

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` double" for n in wanted])
    return with_halo(df, idx, chunk_len, longest, 0).groupBy(*keys, CHUNK).applyInArrow(of_chunk, types)


def sliding_quantile(
    df: DataFrame, keys: list[str], idx: str, per_day: int, value: str, days: int, q: float, name: str
) -> DataFrame:
    """keys, ``idx`` and ``name`` of one quantile (``with_sliding_quantiles``)."""
    rows = df.select(*keys, F.col(idx).cast("long").alias(idx), F.col(value).cast("long").alias("_v"))
    return with_sliding_quantiles(rows, keys, idx, per_day, {name: ("_v", days, q)}).drop("_v")
