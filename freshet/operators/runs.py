"""Order-based work within long series, cut into days: neighbours, runs, running maxima.

A window over a whole series is one task, however many readings it has. Here windows hold one day of a series; what crosses
midnight is settled on a few rows per day (its first and last ones) and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.timegrid import epoch_micros

DAY = "_day"


def seconds_between(earlier: Column, later: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / 1_000_000


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Add ``before`` and ``after``: structs (order, values) of the rows next to each one in its series, NULL at the ends.

    ``order`` starts with a time and is unique within a series.
    """
    own = F.struct(*order, *values)
    rows = df.withColumn(DAY, F.col(order[0]).cast("date"))
    w = Window.partitionBy(*keys, DAY).orderBy(*order)
    inner = rows.withColumns({"before": F.lag(own).over(w), "after": F.lead(own).over(w)})
    days = rows.groupBy(*keys, DAY).agg(F.min(own).alias("_first"), F.max(own).alias("_last"))
    along = Window.partitionBy(*keys).orderBy(DAY)
    edges = days.select(
        *keys, DAY, F.lag("_last").over(along).alias("_earlier"), F.lead("_first").over(along).alias("_later"))
    return inner.join(edges, [*keys, DAY]).withColumns(
        {"before": F.coalesce("before", "_earlier"), "after": F.coalesce("after", "_later")}).drop(DAY, "_earlier", "_later")


def runs(
    df: DataFrame, keys: list[str], order: list[str], same: list[str], gap_seconds: float | None = None
) -> DataFrame:
    """Longest stretches of rows with equal ``same`` (nulls equal) and no more than ``gap_seconds`` between neighbours.

    Returns keys, ``same``, start, end (times) and n. ``order`` starts with a time and is unique within a series. Stretches inside a
    day are final; those at a day's edge, two per day at most, are merged across midnights.
    """
    ts = F.col(order[0])

    def broken(w, value: Column, start: Column, end: Column) -> Column:
        differs = ~value.eqNullSafe(F.lag(value).over(w)) if same else F.lit(False)
        if gap_seconds is None:
            return differs
        return differs | F.coalesce(seconds_between(F.lag(end).over(w), start) > gap_seconds, F.lit(False))

    # Columns one by one: a struct in an aggregate would have all rows sorted once more.
    value = F.struct(*same) if same else F.lit(0)
    firsts = [F.first(c).alias(c) for c in same]
    rows = df.select(*keys, *order, *same).withColumn(DAY, ts.cast("date"))
    w = Window.partitionBy(*keys, DAY).orderBy(*order)
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("_new", (first | broken(w, value, ts, ts)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy(*keys, DAY, "_run").agg(
        *firsts, F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
    pieces = pieces.withColumn("_most", F.max("_run").over(Window.partitionBy(*keys, DAY)))
    at_edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_most"))
    columns = [*keys, *same, "start", "end", "n"]
    along = Window.partitionBy(*keys).orderBy(DAY, "_run")
    fresh = F.lag(DAY).over(along).isNull() | (F.lag(DAY).over(along) == F.col(DAY))
    edges = pieces.filter(at_edge).withColumn(
        "_new", (fresh | broken(along, value, F.col("start"), F.col("end"))).cast("int"))
    edges = edges.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = edges.groupBy(*keys, "_run").agg(
        *firsts, F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return pieces.filter(~at_edge).select(*columns).unionByName(merged.select(*columns))


def running_max(df: DataFrame, keys: list[str], idx: str, per_day: int, values: dict[str, Column]) -> DataFrame:
    """Add each value's maximum over the series up to and including the row; ``idx`` is an integer step, unique in a series,
    ``per_day`` steps to a day."""
    rows = df.withColumns({DAY: F.floor(F.col(idx) / per_day), **{f"_{n}": v for n, v in values.items()}})
    upto = Window.partitionBy(*keys, DAY).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.max(f"_{n}").over(upto) for n in values})
    days = rows.groupBy(*keys, DAY).agg(*[F.max(f"_{n}").alias(f"_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select(*keys, DAY, *[F.max(f"_{n}").over(before).alias(f"_carry_{n}") for n in values])
    out = rows.join(carry, [*keys, DAY])
    # ``greatest`` skips NULL, as a running maximum does.
    return out.withColumns({n: F.greatest(n, f"_carry_{n}") for n in values}).drop(
        DAY, *[f"_{n}" for n in values], *[f"_carry_{n}" for n in values])
