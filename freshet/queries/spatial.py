"""Station catalogue, distance, pair and route queries over ``supplier`` as stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators.series import station_hours
from freshet.plans import spatial
from freshet.queries import query
from freshet.queries.base import r6
from freshet.queries.sql import IA, r, with_ctes
from freshet.session import shared_folder
from freshet.sources import catalogue, gauges

# Fixed value: the point distances are measured from.
POINT = (6.271, -75.564)
ZONES = [f"nation_{i}" for i in range(0, 25, 2)]

STATIONS_SQL = """SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS codigo, s_name AS nombre,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Pluviométrica' ELSE 'Climatológica' END AS categoria,
    CASE WHEN s_suppkey % 7 = 0 THEN 'Suspendida' ELSE 'Activa' END AS estado,
    ' ' || n_name || ' ' AS municipio, n_nationkey AS zone, s_suppkey,
    round(6.10::DOUBLE + (s_suppkey % 40) * 0.01::DOUBLE, 2) AS lat,
    round(-75.70::DOUBLE + (s_suppkey % 30) * 0.01::DOUBLE, 2) AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(12742.0::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def _stations(spark, sf_dir):
    return gauges.suppliers_as_stations(spark, sf_dir)


DIST = f"""SELECT codigo, nombre, categoria, estado, municipio, lat, lon,
  {_km('6.271::DOUBLE', '(-75.564)::DOUBLE', 'lat', 'lon')} AS d FROM stations
  WHERE lower(trim(municipio)) IN ({', '.join(f"'{z}'" for z in ZONES)})"""


@query(
    "stations_by_distance", "A4 B3 B7 B15 H2 H6 H8",
    with_ctes(f"SELECT codigo, nombre, categoria, estado, municipio, {r('d')} AS distancia_km, lat, lon FROM d",
              stations=STATIONS_SQL, d=DIST),
)
def stations_by_distance(spark, sf_dir):
    rows = _stations(spark, sf_dir).filter(F.col("departamento") == "Antioquia")
    return r6(catalogue.by_distance(rows, *POINT, ZONES))


@query(
    "catalogue_of_one_department", "A4 B7",
    with_ctes(f"SELECT codigo, nombre, municipio, {r('d')} AS distancia_km FROM d JOIN stations s USING (codigo, nombre, municipio) WHERE s.s_suppkey % 5 <> 0",
              stations=STATIONS_SQL, d=DIST),
)
def catalogue_of_one_department(spark, sf_dir):
    """The catalogue as published (JSON, two departments), read with the filter at the source."""
    path = shared_folder(spark, "catalogue")
    other = F.col("codigo").cast("long") % 5 == 0
    rows = _stations(spark, sf_dir).drop("zone").withColumn("departamento", F.when(other, "Caldas").otherwise("Antioquia"))
    rows.write.partitionBy("estado").json(path)
    found = catalogue.by_distance(catalogue.scan(spark, path, "Antioquia"), *POINT, ZONES)
    return r6(found.select("codigo", "nombre", "municipio", "distancia_km"))


@query(
    "nearest_stations", "F1 H2",
    with_ctes(f"SELECT codigo, nombre, {r('d')} AS distancia_km FROM d ORDER BY d, codigo LIMIT 15", stations=STATIONS_SQL, d=DIST),
)
def nearest_stations(spark, sf_dir):
    near = catalogue.nearest(_stations(spark, sf_dir), *POINT, ZONES, k=15)
    return r6(near.select("codigo", "nombre", "distancia_km"))


PAIRS_SQL = "SELECT DISTINCT basin, station_id AS station_a, 'S2' AS station_b FROM station_hours WHERE station_id <> 'S2'"
MIN_HOURS = 18


@query(
    "station_pair_comparison", "C10 D4 D35 D36",
    with_ctes(
        f"""SELECT basin, station_a, station_b, count(*) AS dias_lluvia_ambas,
              count(*) FILTER (a > {IA} OR b > {IA}) AS dias_supera_alguna,
              count(*) FILTER ((a > {IA}) <> (b > {IA})) AS dias_supera_una_sola,
              {r('CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END')} AS correlacion_diaria,
              CAST(min(day) AS DATE) AS desde, CAST(max(day) AS DATE) AS hasta,
              {r(f'count(*) FILTER ((a > {IA}) <> (b > {IA})) / nullif(count(*) FILTER (a > {IA} OR b > {IA}), 0)')} AS share_single
            FROM pairs JOIN (SELECT basin, station_id AS station_a, day, mm AS a FROM daily) USING (basin, station_a)
              JOIN (SELECT basin, station_id AS station_b, day, mm AS b FROM daily) USING (basin, station_b, day)
            WHERE a > 0 AND b > 0 GROUP BY ALL""",
        "station_hours", pairs=PAIRS_SQL,
        daily=f"""SELECT basin, station_id, DATE '1970-01-01' + CAST(hour_idx // 24 AS INTEGER) AS day, sum(mm) AS mm
                  FROM station_hours GROUP BY ALL HAVING count(mm) >= {MIN_HOURS}"""),
)
def station_pair_comparison(spark, sf_dir):
    stations = station_hours(gauges.readings(spark, sf_dir))
    pairs = stations.filter("station_id <> 'S2'").select(
        "basin", F.col("station_id").alias("station_a"), F.lit("S2").alias("station_b")
    ).distinct()
    return r6(spatial.compare_pairs(stations, pairs, min_hours=MIN_HOURS))


@query(
    "station_pair_distances", "C9 H2",
    with_ctes(
        f"SELECT a.codigo AS code_a, b.codigo AS code_b, {r(_km('a.lat', 'a.lon', 'b.lat', 'b.lon'))} AS distancia_km "
        "FROM stations a JOIN stations b ON b.s_suppkey = a.s_suppkey - a.s_suppkey % 10 WHERE a.s_suppkey % 10 <> 0",
        stations=STATIONS_SQL),
)
def station_pair_distances(spark, sf_dir):
    """Each station against the first of its ten, by padded code."""
    located = catalogue.located(_stations(spark, sf_dir))
    key = F.col("codigo").cast("long")
    pairs = located.filter(key % 10 != 0).select(
        F.col("codigo").alias("code_a"), F.lpad((key - key % 10).cast("string"), 10, "0").alias("code_b")
    )
    return r6(spatial.pair_distances(pairs, located))


@query(
    "catalogue_lookup", "C9",
    with_ctes(
        """SELECT c.codigo, s.nombre, s.estado, s.zone FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS codigo FROM customer) c
           LEFT JOIN stations s ON s.codigo = lpad(c.codigo, 10, '0')""", stations=STATIONS_SQL),
)
def catalogue_lookup(spark, sf_dir):
    """Every customer key looked up as a station code; most have no catalogue row."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    codes = c.select(F.col("c_custkey").cast("string").alias("codigo")).distinct()
    rows = _stations(spark, sf_dir).select("codigo", "nombre", "estado", "zone")
    return catalogue.metadata(codes, rows)


# A route per ten suppliers, in key order.
ROUTE_SQL = {
    "stations": STATIONS_SQL,
    "pts": "SELECT s_suppkey // 10 AS route, s_suppkey AS ord, lat, lon FROM stations",
    "seg": f"""SELECT *, {_km('lat0', 'lon0', 'lat', 'lon')} AS km FROM (
      SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM pts WINDOW w AS (PARTITION BY route ORDER BY ord))""",
    "cum": """SELECT *, coalesce(sum(km) OVER (PARTITION BY route ORDER BY ord), 0) AS km_end,
      row_number() OVER (PARTITION BY route ORDER BY ord) AS rn FROM seg""",
}


def _route(spark, sf_dir):
    rows = catalogue.located(_stations(spark, sf_dir))
    key = F.col("codigo").cast("long")
    return rows.select(F.floor(key / 10).alias("route"), key.alias("ord"), "lat", "lon")


@query(
    "route_length_along_points", "E11 H2",
    with_ctes(f"SELECT route, ord, {r('km')} AS km, {r('km_end')} AS km_end FROM cum", **ROUTE_SQL),
)
def route_length_along_points(spark, sf_dir):
    return r6(spatial.segments(_route(spark, sf_dir)).select("route", "ord", "km", "km_end"))


N_NODES = 5


@query(
    "points_along_route", "H14 E11",
    with_ctes(
        f"""SELECT route, CAST(i + 1 AS INTEGER) AS node, {r('lat0 + f * (lat - lat0)')} AS lat, {r('lon0 + f * (lon - lon0)')} AS lon, {r('pos')} AS pos
            FROM (SELECT p.route, p.i, p.pos, c.*, CASE WHEN c.km = 0 THEN 0 ELSE (p.pos - (c.km_end - c.km)) / c.km END AS f,
                    row_number() OVER (PARTITION BY p.route, p.i ORDER BY c.rn) AS pick
                  FROM (SELECT route, i, mx * i / {N_NODES - 1}.0::DOUBLE AS pos, mx_rn FROM (SELECT route, max(km_end) AS mx, max(rn) AS mx_rn FROM cum GROUP BY route)
                        CROSS JOIN range({N_NODES}) t(i)) p
                  JOIN cum c ON c.route = p.route AND c.km IS NOT NULL AND (p.pos <= c.km_end OR c.rn = p.mx_rn)) WHERE pick = 1""",
        **ROUTE_SQL),
)
def points_along_route(spark, sf_dir):
    return r6(spatial.route_points(_route(spark, sf_dir), N_NODES))
