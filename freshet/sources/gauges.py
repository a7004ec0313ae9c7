"""Rain-gauge readings derived from the sample tables.

``events`` becomes a dense month of readings for one basin per 75 users; ``lineitem``
becomes seven sparse years of one basin. Rain comes in whole bucket tips, so sums are
exact: 1.5 mm per tip keeps means over one, two or three stations exact too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USERS_PER_BASIN = 75
MM_PER_TIP = 1.5
PRINCIPAL_SENSOR = "240"
QA_SENSOR = "257"
STATIONS = ["S0", "S1", "S2"]
OUTAGES = [
    ("S1", "2024-01-10 00:00:00", "2024-01-14 00:00:00"),
    ("S0", "2024-01-29 00:00:00", None),
]
LONG_OUTAGES = [
    ("S1", "1997-03-05 00:00:00", "1997-09-20 00:00:00"),
    ("S0", "2000-07-01 00:00:00", None),
]


def _outside(outages: list[tuple[str, str, str | None]]) -> Column:
    keep = F.lit(True)
    for station, start, end in outages:
        hit = (F.col("station_id") == station) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            hit = hit & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
        keep = keep & ~hit
    return keep


def from_events(events: DataFrame, users_per_basin: int = USERS_PER_BASIN) -> DataFrame:
    """Every reading of every sensor, outages applied."""
    user = F.col("user_id")
    tips = F.floor(F.greatest(F.col("value") - 75, F.lit(0.0)) / 25).cast("int")
    # Three rainy days in six, and heavier rain from the 22nd on, so that the later test
    # rows hold events too.
    rainy = (F.dayofmonth("ts") % 6).isin(1, 2, 3)
    tips = tips * F.when(F.dayofmonth("ts") >= 22, 2).otherwise(1)
    rows = events.select(
        F.concat(F.lit("B"), F.floor(user / users_per_basin).cast("string")).alias("basin"),
        F.concat(F.lit("S"), (user % 3).cast("string")).alias("station_id"),
        F.when(F.col("event_type") == "error", QA_SENSOR).otherwise(PRINCIPAL_SENSOR).alias("sensor_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(rainy, tips).otherwise(0).alias("tips"),
    )
    return rows.filter(_outside(OUTAGES)).withColumn("mm", F.col("tips") * F.lit(MM_PER_TIP))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One basin over seven years, a reading per line at an hour of its ship date."""
    hours = F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"))
    rows = lineitem.select(
        F.lit("L0").alias("basin"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")).alias("station_id"),
        F.lit(PRINCIPAL_SENSOR).alias("sensor_id"),
        (F.col("l_shipdate").cast("timestamp_ntz") + hours).alias("ts"),
        F.when(F.col("l_partkey") % 10 < 2, F.col("l_linenumber")).otherwise(0).cast("int").alias("tips"),
    )
    return rows.filter(_outside(LONG_OUTAGES)).withColumn("mm", F.col("tips") * F.lit(MM_PER_TIP))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings(spark: SparkSession, sf_dir: str, users_per_basin: int = USERS_PER_BASIN) -> DataFrame:
    """Readings of the principal sensor, the input of the hourly series."""
    rows = from_events(events(spark, sf_dir), users_per_basin)
    return rows.filter(F.col("sensor_id") == PRINCIPAL_SENSOR)


def long_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def as_text(rows: DataFrame, row_id: Column | None = None) -> DataFrame:
    """The same readings as a source publishes them: padded codes, text times and values."""
    out = rows.select(
        F.lpad(F.regexp_replace("station_id", "S", "2701"), 10, "0").alias("codigoestacion"),
        F.lpad("sensor_id", 4, "0").alias("codigosensor"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000")).alias("fechaobservacion"),
        F.col("tips").cast("string").alias("valorobservado"),
        "basin",
    )
    return out if row_id is None else out.withColumn("row_id", row_id)


def station_meta(spark: SparkSession) -> DataFrame:
    """Configured stations; the last one never reports."""
    rows = [(s, f"Station {s}", PRINCIPAL_SENSOR, QA_SENSOR) for s in STATIONS]
    rows.append(("S9", "Station S9", PRINCIPAL_SENSOR, None))
    return spark.createDataFrame(
        rows, "station_id string, name string, principal_sensor string, qa_sensor string"
    )


def suppliers_as_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows from ``supplier`` and ``nation``; odd keys carry the nested location."""
    key = F.col("s_suppkey")
    lat = F.round(F.lit(6.10) + (key % 40) * F.lit(0.01), 2)
    lon = F.round(F.lit(-75.70) + (key % 30) * F.lit(0.01), 2)
    flat = key % 2 == 0
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.lpad(key.cast("string"), 10, "0").alias("codigo"),
        F.col("s_name").alias("nombre"),
        F.when(key % 3 == 0, "Pluviométrica").otherwise("Climatológica").alias("categoria"),
        F.when(key % 7 == 0, "Suspendida").otherwise("Activa").alias("estado"),
        F.lit("Antioquia").alias("departamento"),
        F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("municipio"),
        F.when(flat, lat.cast("string")).alias("latitud"),
        F.when(flat, lon.cast("string")).alias("longitud"),
        F.when(~flat, F.struct(lat.cast("string").alias("latitude"), lon.cast("string").alias("longitude"))).alias("ubicaci_n"),
        F.col("n_nationkey").cast("long").alias("zone"),
    )
