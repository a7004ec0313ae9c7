"""Station catalogue: locations, nearest stations, tiered matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.functions.geo import coordinate, haversine_km
from freshet.functions.text import code_variants, lower_text, name_fragments, padded_code, upper_text
from freshet.sources.columns import available

OUTPUT = ["codigo", "nombre", "categoria", "estado", "municipio", "distancia_km", "lat", "lon"]


def scan(spark: SparkSession, path: str, department: str, fmt: str = "json") -> DataFrame:
    """Catalogue rows of one department; the filter reaches the scan."""
    return spark.read.schema(S.CATALOGUE).format(fmt).load(path).filter(
        F.col("departamento") == department
    )


def located(catalogue: DataFrame) -> DataFrame:
    """Rows with usable coordinates, from the flat columns or the nested location."""
    none = F.lit(None).cast("string")
    has = catalogue.columns

    def pick(flat: str, nested: str) -> Column:
        inner = F.col("ubicaci_n").getField(nested) if "ubicaci_n" in has else none
        return coordinate(F.col(flat) if flat in has else none, inner)

    out = catalogue.withColumns({"lat": pick("latitud", "latitude"), "lon": pick("longitud", "longitude")})
    return out.dropna(subset=["lat", "lon"])


def by_distance(catalogue: DataFrame, lat: float, lon: float, municipalities: list[str]) -> DataFrame:
    """Stations in the listed municipalities with their distance to a point."""
    near = located(catalogue).filter(lower_text(F.col("municipio")).isin(municipalities))
    near = near.withColumn(
        "distancia_km", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    )
    return available(near, OUTPUT)


def nearest(catalogue: DataFrame, lat: float, lon: float, municipalities: list[str], k: int = 15) -> DataFrame:
    """The k nearest stations; equal distances resolve by code."""
    return by_distance(catalogue, lat, lon, municipalities).orderBy("distancia_km", "codigo").limit(k)


def metadata(codes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue row of each code (by padded code); NULLs when there is none.

    A code listed several times resolves to its first row by value.
    """
    rest = [c for c in catalogue.columns if c != "codigo"]
    key = padded_code(F.col("codigo")).alias("_code")
    first = catalogue.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    joined = codes.withColumn("_code", padded_code(F.col("codigo"))).join(first, "_code", "left")
    return joined.select(*codes.columns, *[F.col("_row").getField(c).alias(c) for c in rest])


DESCRIPTION = ["codigoestacion", "nombreestacion", "departamento", "municipio"]


def tiered_match(requests: DataFrame, published: DataFrame) -> DataFrame:
    """Rows of ``published`` for each requested station, from the first rule that finds any.

    Rules in order: the code as given, bare, padded; then, per fragment of the name, the
    untrimmed code with that fragment in the name plus department and municipality (those
    only when the catalogue knows them). ``requests`` has ``codigo, nombre, departamento,
    municipio``.

    The rules are decided on the distinct station descriptions, not on the readings, so
    the readings are only pre-aggregated once and then filtered by an equi-join.
    """
    spelled = F.transform(
        code_variants(F.col("codigo")),
        lambda s: F.struct(s.alias("spelling"), F.lit(None).cast("string").alias("fragment")),
    )
    named = F.transform(
        name_fragments(F.col("nombre")),
        lambda f: F.struct(F.col("codigo").alias("spelling"), f.alias("fragment")),
    )
    rules = requests.select(
        "codigo",
        upper_text(F.col("departamento")).alias("_dep"),
        upper_text(F.col("municipio")).alias("_mun"),
        F.posexplode(F.concat(spelled, named)).alias("tier", "_rule"),
    )
    rules = rules.select("*", F.col("_rule.spelling").alias("codigoestacion"), "_rule.fragment").drop("_rule")
    seen = published.select(*DESCRIPTION).distinct()
    hits = seen.join(rules, "codigoestacion").filter(
        F.col("fragment").isNull()
        | (
            F.contains(F.col("nombreestacion"), F.col("fragment"))
            & ((F.col("_dep") == "") | (F.col("departamento") == F.col("_dep")))
            & ((F.col("_mun") == "") | (F.col("municipio") == F.col("_mun")))
        )
    )
    best = F.min("tier").over(Window.partitionBy("codigo"))
    winners = hits.withColumn("_best", best).filter(F.col("tier") == F.col("_best"))
    winners = winners.select("codigo", "tier", *[F.col(c).alias(f"_{c}") for c in DESCRIPTION])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DESCRIPTION]
    return published.join(winners, same).drop(*[f"_{c}" for c in DESCRIPTION])
