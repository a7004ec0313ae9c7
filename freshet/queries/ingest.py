"""Ingest queries: typed readings, de-duplication, gaps, high-water marks, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.text import bare_code, code_variants, name_fragments
from freshet.operators import dedup
from freshet.operators import series as ops
from freshet.plans import diagnostics
from freshet.queries import query
from freshet.queries.base import r6, series
from freshet.queries.sql import r, with_ctes
from freshet.session import shared_folder
from freshet.sources import catalogue, gauges, landing, readings, tables



def _all(spark, sf_dir):
    return gauges.from_events(gauges.events(spark, sf_dir))


def _damaged_text(spark, sf_dir):
    """Text readings with some unreadable times and values, from the whole table."""
    rows = gauges.from_events(gauges.events(spark, sf_dir))
    text = gauges.as_text(rows)
    bad_time, bad_value = F.substring("fechaobservacion", 18, 2) == "07", F.substring("fechaobservacion", 18, 2) == "13"
    return text.withColumns(
        {
            "fechaobservacion": F.when(bad_time, "no time").otherwise(F.col("fechaobservacion")),
            "valorobservado": F.when(bad_value, "n/a").otherwise(F.col("valorobservado")),
        }
    )


@query(
    "typed_readings", "A1 A8 A9 B1 B2 B3 B5 A14",
    with_ctes(
        """SELECT basin, '2701' || substr(station_id, 2) AS station_id, sensor_id, date_trunc('second', ts) AS ts,
             CASE WHEN second(ts) = 13 THEN NULL ELSE CAST(tips AS DOUBLE) END AS mm
           FROM all_readings WHERE second(ts) <> 7""", "all_readings"),
)
def typed_readings(spark, sf_dir):
    """Landing files as text, read back and typed."""
    path = shared_folder(spark, "landing")
    tables.write_non_empty(_damaged_text(spark, sf_dir), path, partition_by=["basin"], fmt="csv")
    typed = readings.typed(readings.require_any(readings.scan_text(spark, path)))
    return typed.select("basin", "station_id", "sensor_id", "ts", "mm")


@query(
    "readings_by_date_column", "A9",
    with_ctes(
        """SELECT name, count(*) FILTER (name <> 'ninguna' AND second(ts) <> 7 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05'
             AND TIMESTAMP '2024-01-09 12:00:00') AS n FROM all_readings, (VALUES ('fechaobservacion'), ('fecha'), ('timestamp'), ('ninguna')) v(name)
           GROUP BY name""", "all_readings"),
)
def readings_by_date_column(spark, sf_dir):
    """One table published under four names of its date column, the last of which is none; beside each stands a column of lesser rank."""
    text = _damaged_text(spark, sf_dir)
    found = None
    for name in ("fechaobservacion", "fecha", "timestamp", "ninguna"):
        raw = text.withColumnRenamed("fechaobservacion", name)
        if name == "fecha":
            raw = raw.withColumn("timestamp", F.lit("1999-01-01 00:00:00"))
        got = readings.in_range(raw, "2024-01-05 00:00:00", "2024-01-09 12:00:00").agg(F.count(F.lit(1)).alias("n"))
        got = got.select(F.lit(name).alias("name"), "n")
        found = got if found is None else found.unionByName(got)
    return found


@query(
    "sensor_sides", "B4",
    with_ctes(
        """SELECT basin, station_id, CASE sensor_id WHEN '240' THEN 'principal' ELSE 'qa' END AS side, count(*) AS n, CAST(sum(tips) AS BIGINT) AS tips
           FROM all_readings GROUP BY ALL""", "all_readings"),
)
def sensor_sides(spark, sf_dir):
    rows, meta = _all(spark, sf_dir), gauges.station_meta(spark)
    sides = ops.principal_sensor(rows, meta).withColumn("side", F.lit("principal")).unionByName(
        ops.qa_sensor(rows, meta).withColumn("side", F.lit("qa"))
    )
    return sides.groupBy("basin", "station_id", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tips").alias("tips")
    )


@query(
    "stations_without_readings", "A2",
    """SELECT 'S9' AS station_id, 'Station S9' AS name WHERE NOT EXISTS (SELECT 1 FROM events WHERE 'S' || CAST(user_id % 3 AS VARCHAR) = 'S9')""",
)
def stations_without_readings(spark, sf_dir):
    absent = readings.absent_stations(_all(spark, sf_dir), gauges.station_meta(spark))
    return absent.select("station_id", "name")


COPIES_SQL = {
    "arrivals": """SELECT basin, '2701' || substr(station_id, 2) AS codigoestacion, sensor_id, date_trunc('second', ts) AS ts, tips, 0 AS arrival
        FROM all_readings UNION ALL
      SELECT basin, '2701' || substr(station_id, 2), sensor_id, date_trunc('second', ts), tips + 1, 1 FROM all_readings
        WHERE second(ts) % 10 = 0""",
    "kept": """SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY basin, codigoestacion, sensor_id, ts ORDER BY arrival DESC, tips DESC) = 1""",
}


def _arrivals(spark, sf_dir):
    """Every reading once, and a corrected copy of a tenth in another spelling."""
    first = gauges.as_text(_all(spark, sf_dir))
    seconds = F.substring("fechaobservacion", 18, 2).cast("int")
    again = first.filter(seconds % 10 == 0).withColumns(
        {
            "codigoestacion": bare_code(F.col("codigoestacion")),
            "codigosensor": bare_code(F.col("codigosensor")),
            "fechaobservacion": F.regexp_replace("fechaobservacion", "T|\\.000$", " "),
            "valorobservado": (F.col("valorobservado").cast("int") + 1).cast("string"),
        }
    ).withColumn("fechaobservacion", F.trim("fechaobservacion"))
    return first, again


@query(
    "keep_last_reading", "E14 G2 G5 F2 B5",
    with_ctes("SELECT basin, codigoestacion, sensor_id AS codigosensor, ts AS fechaobservacion, tips FROM kept", "all_readings", **COPIES_SQL),
)
def keep_last_reading(spark, sf_dir):
    first, again = _arrivals(spark, sf_dir)
    both = first.withColumn("arrival", F.lit(0)).unionByName(again.withColumn("arrival", F.lit(1)))
    typed = dedup.normalise_codes(both).withColumn("tips", F.col("valorobservado").cast("int")).drop("valorobservado")
    kept = dedup.keep_last_if_keyed(typed, ["basin", *dedup.READING_KEY], ["arrival"])
    return kept.drop("arrival").orderBy("basin", "fechaobservacion", "codigoestacion", "codigosensor")


@query(
    "append_new_counts", "G1 D38",
    with_ctes(
        """SELECT n.basin, n.codigoestacion, count(*) FILTER (o.ts IS NULL) AS new_rows, count(*) AS total_rows FROM
             (SELECT DISTINCT basin, codigoestacion, sensor_id, ts FROM arrivals) n
             LEFT JOIN (SELECT DISTINCT basin, codigoestacion, sensor_id, ts FROM arrivals WHERE arrival = 0 AND ts < TIMESTAMP '2024-01-20') o
             USING (basin, codigoestacion, sensor_id, ts) GROUP BY ALL""", "all_readings", **COPIES_SQL),
)
def append_new_counts(spark, sf_dir):
    """History up to 20 January, then a batch with the rest and the re-published copies."""
    first, again = _arrivals(spark, sf_dir)
    old = first.filter("fechaobservacion < '2024-01-20'")
    batch = first.filter("fechaobservacion >= '2024-01-20'").unionByName(again)
    # Basins are separate landing areas: the code carries the basin into the key.
    tag = F.concat_ws("/", bare_code(F.col("codigoestacion")), F.col("basin"))
    merged = dedup.append_readings(
        old.withColumn("codigoestacion", tag), batch.withColumn("codigoestacion", tag)
    )
    counts = merged.groupBy("codigoestacion").agg(
        F.count_if("is_new").alias("new_rows"), F.count(F.lit(1)).alias("total_rows")
    )
    parts = F.split("codigoestacion", "/")
    return counts.select(parts[1].alias("basin"), parts[0].alias("codigoestacion"), "new_rows", "total_rows")


STATION_LIST_SQL = """SELECT DISTINCT 'B' || CAST(user_id // 75 AS VARCHAR) AS basin, 'S' || CAST(user_id % 5 AS VARCHAR) AS station_id FROM events
  UNION SELECT 'X' || CAST(user_id // 75 AS VARCHAR), 'S0' FROM events"""


def _station_list(spark, sf_dir):
    """Five stations per basin (two never report) and one in a basin without any data."""
    user = F.col("user_id")
    e = gauges.events(spark, sf_dir)
    number = F.floor(user / gauges.USERS_PER_BASIN).cast("string")
    known = e.select(F.concat(F.lit("B"), number).alias("basin"), F.concat(F.lit("S"), (user % 5).cast("string")).alias("station_id"))
    other = e.select(F.concat(F.lit("X"), number).alias("basin"), F.lit("S0").alias("station_id"))
    return known.distinct().unionByName(other.distinct())


@query(
    "high_water_marks", "A10 H13",
    with_ctes(
        """SELECT s.basin, s.station_id, coalesce(r.last, b.safe, TIMESTAMP '2026-09-30 18:00:00') AS since FROM stations s
           LEFT JOIN (SELECT basin, station_id, max(ts) AS last FROM readings GROUP BY ALL) r USING (basin, station_id)
           LEFT JOIN (SELECT basin, date_trunc('hour', max(ts)) - INTERVAL 72 HOUR AS safe FROM readings GROUP BY basin) b USING (basin)""",
        "readings", stations=STATION_LIST_SQL),
)
def high_water_marks(spark, sf_dir):
    rows = gauges.readings(spark, sf_dir)
    ends = series(spark, sf_dir).groupBy("basin").agg(F.max("hour_idx").alias("hour_idx"))
    return landing.high_water_marks(_station_list(spark, sf_dir), rows, ends)


@query(
    "last_reading_text", "A11 A12",
    with_ctes(
        """SELECT s.station_id, coalesce(strftime(max(r.ts), '%Y-%m-%d %H:%M'), '') AS last_reading
           FROM (SELECT DISTINCT station_id FROM stations) s LEFT JOIN readings r USING (station_id) GROUP BY s.station_id""",
        "readings", stations=STATION_LIST_SQL),
)
def last_reading_text(spark, sf_dir):
    stations = _station_list(spark, sf_dir).select("station_id").distinct()
    return landing.last_reading_text(stations, gauges.readings(spark, sf_dir))


LONG_FROM, LONG_TO = "1995-01-01", "2001-12-31"
GAP_STATIONS_SQL = "SELECT DISTINCT 'P' || CAST(l_partkey % 97 AS VARCHAR) AS station_id FROM lineitem"
GAP_READINGS_SQL = "SELECT 'P' || CAST(l_partkey % 97 AS VARCHAR) AS station_id, CAST(l_shipdate AS DATE) AS d FROM lineitem"


@query(
    "gap_ledger", "A7",
    with_ctes(
        f"""SELECT s.station_id, x.slice_start, least(x.slice_start + 6, DATE '{LONG_TO}') AS slice_end,
              strftime(x.slice_start, '%Y-%m-%d') || ' a ' || strftime(least(x.slice_start + 6, DATE '{LONG_TO}'), '%Y-%m-%d') AS rango FROM stations s
            CROSS JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '{LONG_FROM}', TIMESTAMP '{LONG_TO}', INTERVAL 7 DAY)) AS DATE) AS slice_start) x
            WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.station_id = s.station_id AND rd.d >= x.slice_start AND rd.d < x.slice_start + 7)""",
        stations=GAP_STATIONS_SQL, rd=GAP_READINGS_SQL),
)
def gap_ledger(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    station = F.concat(F.lit("P"), (F.col("l_partkey") % 97).cast("string")).alias("station_id")
    rows = li.select(station, F.col("l_shipdate").cast("timestamp_ntz").alias("ts"))
    path = shared_folder(spark, "gaps")
    landing.record_gaps(landing.gap_ledger(rows.select("station_id").distinct(), rows, LONG_FROM, LONG_TO), path)
    return spark.read.parquet(path)


@query(
    "landing_range_read", "A5 A6 A13 B8 G5",
    with_ctes(
        """SELECT station_id, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, CAST(sum(tips) AS BIGINT) AS tips FROM long_readings
           WHERE ts BETWEEN TIMESTAMP '1996-06-01' AND TIMESTAMP '1999-03-15 12:00:00' AND station_id IN ('S0', 'S1') GROUP BY ALL""",
        "long_readings"),
)
def landing_range_read(spark, sf_dir):
    path = shared_folder(spark, "years")
    landing.write_year_slices(gauges.long_readings(spark, sf_dir), path)
    rows = landing.read_range(spark, path, "1996-06-01 00:00:00", "1999-03-15 12:00:00", ["S0", "S1"])
    return rows.groupBy("station_id", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("tips").alias("tips"))


@query(
    "code_spellings", "B6",
    """SELECT s_suppkey, array_to_string(list_distinct_ordered, '|') AS spellings FROM (
         SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0
           THEN CASE WHEN s_suppkey = 0 THEN [lpad('0', 10, '0')] ELSE [lpad(CAST(s_suppkey AS VARCHAR), 10, '0'), CAST(s_suppkey AS VARCHAR)] END
           ELSE [CAST(s_suppkey AS VARCHAR), lpad(CAST(s_suppkey AS VARCHAR), 10, '0')] END AS list_distinct_ordered FROM supplier)""",
)
def code_spellings(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = F.col("s_suppkey").cast("string")
    code = F.when(F.col("s_suppkey") % 2 == 0, F.lpad(text, 10, "0")).otherwise(F.concat(F.lit(" "), text, F.lit(" ")))
    return s.select("s_suppkey", F.array_join(code_variants(code), "|").alias("spellings"))


PUBLISHED_SQL = """SELECT o_orderkey, o_custkey AS k, upper(o_orderpriority) || ' STATION - X' AS nombreestacion,
    CASE o_custkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0')
      ELSE ' ' || CAST(o_custkey AS VARCHAR) END AS codigoestacion,
    'DEP' || CAST(o_custkey % 2 AS VARCHAR) AS departamento, o_totalprice FROM orders"""


@query(
    "tiered_station_match", "B13 B6 H6 H7",
    with_ctes(
        """SELECT k, tier, count(*) AS n FROM (
             SELECT k, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 1
                 WHEN nombreestacion LIKE '%1-URGENT%' OR nombreestacion LIKE '%URGENT%' THEN 2 END AS tier
             FROM published WHERE k % 3 <> 2 OR (nombreestacion LIKE '%URGENT%' AND departamento = 'DEP0')) GROUP BY ALL""",
        published=PUBLISHED_SQL),
)
def tiered_station_match(spark, sf_dir):
    """Customers as stations: found by code, by padded code, or only by name and region."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, text = F.col("o_custkey"), F.col("o_custkey").cast("string")
    spelled = F.when(k % 3 == 0, text).when(k % 3 == 1, F.lpad(text, 10, "0")).otherwise(F.concat(F.lit(" "), text))
    published = o.select(
        k.alias("k"), spelled.alias("codigoestacion"),
        F.concat(F.upper("o_orderpriority"), F.lit(" STATION - X")).alias("nombreestacion"),
        F.concat(F.lit("DEP"), (k % 2).cast("string")).alias("departamento"),
        F.lit(None).cast("string").alias("municipio"), "o_totalprice",
    )
    wanted = o.select(
        F.when(k % 3 == 2, F.concat(F.lit(" "), text)).otherwise(text).alias("codigo"),
        F.lit("1 - urgent [auto]").alias("nombre"), F.lit("dep0").alias("departamento"),
        F.lit("").alias("municipio"),
    ).distinct()
    found = catalogue.tiered_match(wanted, published)
    return found.groupBy("k", F.col("tier").cast("int").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "name_fragments", "H7 H6",
    """SELECT p_partkey, array_to_string([trim(x) FOR x IN string_split(upper(p_name), ' ') IF len(trim(x)) >= 5], '|') AS fragments
       FROM part""",
)
def name_fragments_of_parts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.regexp_replace("p_name", " ", " - "), F.lit(" [27010]"))
    return p.select("p_partkey", F.array_join(name_fragments(name), "|").alias("fragments"))


STEPS_SQL = """SELECT basin, station_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY basin, station_id ORDER BY ts)) / 1e6::DOUBLE AS step_s FROM all_readings"""


@query(
    "raw_profile", "D15 E8",
    with_ctes(
        f"""SELECT p.*, {r('m.median_step_s')} AS median_step_s FROM (
              SELECT basin, station_id, count(*) AS n_rows, string_agg(DISTINCT sensor_id, ',' ORDER BY sensor_id) AS sensors,
                min(tips) * 1.5::DOUBLE AS value_min, max(tips) * 1.5::DOUBLE AS value_max, min(ts) AS first_ts, max(ts) AS last_ts
              FROM all_readings GROUP BY ALL) p
            LEFT JOIN (SELECT basin, station_id, quantile_cont(step_s, 0.5) AS median_step_s FROM steps GROUP BY ALL) m USING (basin, station_id)""",
        "all_readings", steps=STEPS_SQL),
)
def raw_profile(spark, sf_dir):
    return r6(diagnostics.raw_profile(_all(spark, sf_dir), ["basin", "station_id"]))


@query(
    "commonest_steps", "D15 E8",
    with_ctes(
        """SELECT station_id, step_s, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY n DESC, step_s) AS rank FROM (
             SELECT station_id, step_s, count(*) AS n FROM (
               SELECT station_id, CAST(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY station_id ORDER BY ts) AS DOUBLE) AS step_s FROM long_readings)
             WHERE step_s IS NOT NULL GROUP BY ALL)) WHERE rank <= 10""", "long_readings"),
)
def commonest_steps(spark, sf_dir):
    steps = diagnostics.step_counts(gauges.long_readings(spark, sf_dir), ["station_id"])
    return diagnostics.commonest_steps(steps, ["station_id"])


@query(
    "sensor_breakdown", "D16",
    with_ctes(
        """SELECT basin, station_id, sensor_id, count(*) AS n FROM all_readings WHERE (basin, station_id) IN (
             SELECT (basin, station_id) FROM all_readings GROUP BY basin, station_id HAVING count(DISTINCT sensor_id) > 1)
           GROUP BY ALL""", "all_readings"),
)
def sensor_breakdown(spark, sf_dir):
    return diagnostics.sensor_breakdown(_all(spark, sf_dir), ["basin", "station_id"])


