"""Tables published together: a version is complete when its list of parts is.

A table lies under ``root``/parts, partitioned by (day, v). A publication writes new parts under its own version ``v`` beside the old
ones, then one small table ``versions/<v>`` that lists, for every table and day, the version to read. Readers take the newest
complete list, so they see all tables of one publication or none, and open only the days they ask for. A run that dies
leaves parts that no list names; ``remove_unlisted`` deletes them. One writer at a time.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.sources.tables import exists, write_table

LIST = "table string, day date, v bigint"
VERSIONS, PARTS = "versions", "parts"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    system, hadoop = _files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(hadoop)]


def latest(spark: SparkSession, root: str) -> int:
    """The newest complete version, 0 before the first one."""
    found = [int(n) for n in _names(spark, f"{root}/{VERSIONS}") if n.isdigit()]
    # The marker is written when the list is whole.
    return next((v for v in sorted(found, reverse=True) if exists(spark, f"{root}/{VERSIONS}/{v}/_SUCCESS")), 0)


def parts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """table, day, v of a version (default: the newest)."""
    v = latest(spark, root) if version is None else version
    return spark.read.schema(LIST).parquet(f"{root}/{VERSIONS}/{v}") if v else spark.createDataFrame([], LIST)


def read(
    spark: SparkSession, root: str, name: str, schema: str, since: date | None = None, version: int | None = None
) -> DataFrame | None:
    """The published table, or None before its first publication. ``since`` leaves the files of earlier days unopened."""
    mine = parts(spark, root, version).filter(F.col("table") == name)
    wanted = mine if since is None else mine.filter(F.col("day") >= F.lit(since))
    listed = [(r["day"], r["v"]) for r in wanted.filter("v > 0").collect()]  # one row a day
    if not listed:
        return None if mine.isEmpty() else spark.createDataFrame([], schema)
    # A table without days (a state table) has one part, under no day.
    paths = [f"{root}/{PARTS}/{name}/day={day or '__HIVE_DEFAULT_PARTITION__'}/v={v}" for day, v in listed]
    columns = [c.split()[0] for c in schema.split(", ")]
    return spark.read.schema(f"{schema}{'' if 'day' in columns else ', day date'}, v bigint").option("basePath", f"{root}/{PARTS}/{name}").parquet(*paths).select(*columns)


def stage(df: DataFrame, root: str, name: str, version: int) -> None:
    """Write the parts of a coming version; its readers do not see them yet. Rows need a ``day`` (NULL for a state table)."""
    rows = df if "day" in df.columns else df.withColumn("day", F.lit(None).cast("date"))
    write_table(rows.withColumn("v", F.lit(version).cast("long")), f"{root}/{PARTS}/{name}", ["day", "v"])


def publish(spark: SparkSession, root: str, version: int, changed: dict[str, DataFrame], whole: bool = False) -> None:
    """Make a version readable: the staged days of each table (``changed``: rows with ``day``) replace the ones listed before.

    ``whole``: the tables consist of these days only. This is the one step after which readers see anything.
    """
    # A table without any row is listed too, under version 0.
    new = spark.createDataFrame([(name, None, 0) for name in changed], LIST)
    for name, rows in changed.items():
        days = (rows if "day" in rows.columns else rows.withColumn("day", F.lit(None).cast("date"))).select("day").distinct()
        listed = days.select(F.lit(name).alias("table"), "day", F.lit(version).cast("long").alias("v"))
        new = new.unionByName(listed)
    old = parts(spark, root)
    if whole:
        old = old.filter(~F.col("table").isin(list(changed)))
    best = old.unionByName(new).groupBy("table", "day").agg(F.max("v").alias("v"))
    write_table(best.coalesce(1), f"{root}/{VERSIONS}/{version}")


def remove_unlisted(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the parts that none of the newest ``keep`` versions lists, and older lists; returns how many parts went."""
    newest = latest(spark, root)
    versions = sorted((int(n) for n in _names(spark, f"{root}/{VERSIONS}") if n.isdigit() and int(n) <= newest), reverse=True)
    kept = {(r["table"], str(r["day"]), r["v"]) for v in versions[:keep] for r in parts(spark, root, v).collect()}
    gone = 0
    for table in {t for t, *_ in kept}:
        for day in (n for n in _names(spark, f"{root}/{PARTS}/{table}") if n.startswith("day=")):
            for v in (n for n in _names(spark, f"{root}/{PARTS}/{table}/{day}") if n.startswith("v=")):
                name = day.removeprefix("day=").replace("__HIVE_DEFAULT_PARTITION__", "None")
                if (table, name, int(v.removeprefix("v="))) not in kept:
                    system, path = _files(spark, f"{root}/{PARTS}/{table}/{day}/{v}")
                    system.delete(path, True)
                    gone += 1
    for v in versions[keep:]:
        system, path = _files(spark, f"{root}/{VERSIONS}/{v}")
        system.delete(path, True)
    return gone
