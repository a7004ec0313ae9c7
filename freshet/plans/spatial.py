"""Routes along a stream, station distances and station-pair comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import hydrology
from freshet.functions.geo import haversine_km
from freshet.functions.timegrid import day_date, day_index

FULL_DAY = 24


def segments(points: DataFrame, route: str = "route", order: str = "ord") -> DataFrame:
    """Each stretch between consecutive points with the route length at both ends.

    A route is an ordered list of anchors along one stream, a handful of rows.
    """
    w = Window.partitionBy(route).orderBy(order)
    prev = {c: F.lag(c).over(w) for c in ("lat", "lon")}
    step = haversine_km(prev["lat"], prev["lon"], F.col("lat"), F.col("lon"))
    out = points.select("*", prev["lat"].alias("lat0"), prev["lon"].alias("lon0"), step.alias("km"))
    upto = F.coalesce(F.sum("km").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return out.withColumn("km_end", upto).withColumn(
        "km_start", F.col("km_end") - F.coalesce("km", F.lit(0.0))
    )


def route_points(points: DataFrame, n: int, route: str = "route", order: str = "ord") -> DataFrame:
    """n points equally spaced by distance along each route, ends included.

    Each stretch emits the positions it owns (after its start, up to its end), so a
    position belongs to the first stretch that reaches it and no join is needed.
    """
    whole = Window.partitionBy(route)
    s = segments(points, route, order).withColumn("_total", F.max("km_end").over(whole))
    s = s.filter(F.col("km").isNotNull())
    first = F.row_number().over(whole.orderBy(order)) == 1
    last = F.row_number().over(whole.orderBy(F.desc(order))) == 1
    s = s.select("*", first.alias("_first"), last.alias("_last"))
    # Positions around the stretch, one to spare on either side; the exact test follows.
    per_km = F.lit(float(max(n - 1, 1))) / F.col("_total")
    low = F.when(F.col("_first") | ~(F.col("_total") > 0), 0).otherwise(F.floor(F.col("km_start") * per_km) - 1)
    high = F.when(F.col("_last") | ~(F.col("_total") > 0), n - 1).otherwise(F.ceil(F.col("km_end") * per_km) + 1)
    within = F.sequence(F.greatest(F.lit(0), low.cast("int")), F.least(F.lit(n - 1), high.cast("int")))
    index = F.explode(within)
    p = s.select("*", index.alias("i")).withColumn(
        "pos", F.col("_total") * F.col("i") / F.lit(float(max(n - 1, 1)))
    )
    after = F.col("_first") | (F.col("pos") > F.col("km_start"))
    until = F.col("_last") | (F.col("pos") <= F.col("km_end"))
    share = F.coalesce(F.try_divide(F.col("pos") - F.col("km_start"), F.col("km")), F.lit(0.0))
    own = p.filter(after & until)

    def between(a: str, b: str) -> Column:
        return F.col(a) + share * (F.col(b) - F.col(a))

    return own.select(
        route, (F.col("i") + 1).alias("node"),
        between("lat0", "lat").alias("lat"), between("lon0", "lon").alias("lon"), "pos",
    )


def daily_rain(stations: DataFrame, min_hours: int = FULL_DAY) -> DataFrame:
    """Daily rain per station, only for days with enough recorded hours."""
    day = day_index(F.col("hour_idx"))
    days = stations.groupBy("basin", "station_id", day.alias("day_idx")).agg(
        F.sum("mm").alias("mm"), F.count("mm").alias("hours")
    )
    return days.filter(F.col("hours") >= min_hours).drop("hours")


def compare_pairs(
    stations: DataFrame,
    pairs: DataFrame,
    cn: float | DataFrame = hydrology.DEFAULT_CN,
    min_hours: int = FULL_DAY,
) -> DataFrame:
    """Wet days in both stations of each pair, exceedances of the abstraction, correlation.

    ``pairs`` is the configured list (basin, station_a, station_b); only those pairs
    are formed. Each day is looked up once with its role in a pair and the two roles
    meet in an aggregation, so the daily rain is computed once and never self-joined.
    """
    daily = daily_rain(stations, min_hours)
    roles = pairs.select(
        "basin", "station_a", "station_b",
        F.explode(F.array(*[
            F.struct(F.col(f"station_{s}").alias("station_id"), F.lit(s).alias("side")) for s in "ab"
        ])).alias("_role"),
    ).select("basin", "station_a", "station_b", "_role.*")
    sides = daily.join(roles, ["basin", "station_id"]).groupBy(
        "basin", "station_a", "station_b", "day_idx"
    ).agg(*[F.max(F.when(F.col("side") == s, F.col("mm"))).alias(s) for s in "ab"])
    wet = sides.filter((F.col("a") > 0) & (F.col("b") > 0))
    wet, number = hydrology.with_cn(wet, cn, ["basin"])
    ia = hydrology.abstraction(number)
    over = (F.col("a") > ia).cast("int") + (F.col("b") > ia).cast("int")
    spread = (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
    out = wet.groupBy("basin", "station_a", "station_b").agg(
        F.count(F.lit(1)).alias("dias_lluvia_ambas"),
        F.count_if(over > 0).alias("dias_supera_alguna"),
        F.count_if(over == 1).alias("dias_supera_una_sola"),
        F.when(spread, F.corr("a", "b")).alias("correlacion_diaria"),
        day_date(F.min("day_idx")).alias("desde"),
        day_date(F.max("day_idx")).alias("hasta"),
    )
    return out.withColumn(
        "share_single", F.try_divide(F.col("dias_supera_una_sola").cast("double"), "dias_supera_alguna")
    )


def pair_distances(pairs: DataFrame, located: DataFrame) -> DataFrame:
    """Distance of each pair, coordinates looked up by padded code."""
    def side(s: str) -> DataFrame:
        return located.select(
            F.col("codigo").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}")
        )

    both = pairs.join(side("code_a"), "code_a").join(side("code_b"), "code_b")
    km = haversine_km(*[F.col(c) for c in ("lat_code_a", "lon_code_a", "lat_code_b", "lon_code_b")])
    return both.select("code_a", "code_b", km.alias("distancia_km"))
