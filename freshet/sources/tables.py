"""Table sinks: guarded writes, affected-partition upserts and the serving snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.session import shared_folder

MAX_LISTED_DAYS = 1_000


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table; one that is published by versions is read at its newest one."""
    return spark.read.schema(schema).parquet(path) if (found := _published(spark, path, schema)) is None else found


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    found = _published(spark, path, schema)
    return read(spark, path, schema) if found is None and exists(spark, path) else found


def _published(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    from freshet.sources import published

    root, _, name = path.rstrip("/").rpartition("/")
    return published.read(spark, root, name, schema) if exists(spark, f"{root}/{published.VERSIONS}") else None


def on_days_of(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows of the days that ``new`` touches.

    The days are few scalars and become a literal list, so only their partitions are listed and read; a
    batch over more than ``MAX_LISTED_DAYS`` days (a first load) is joined instead, with the same rows.
    """
    days = new.select("day").distinct()
    listed = [r[0] for r in days.limit(MAX_LISTED_DAYS + 1).collect()]
    if len(listed) > MAX_LISTED_DAYS:
        return stored.join(days, "day", "left_semi")
    return stored.filter(F.col("day").isin(listed))


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
    salt_on: list[str] | None = None,
) -> None:
    """Replace a table, or only the partitions present in ``df`` when it is partitioned.

    Rows are rebalanced on the partition columns first: a small partition becomes one
    file instead of one per task, and a large one is split at run time. Micro-batches
    run without adaptive execution, so they split each partition by a hash of ``salt_on``.
    """
    if partition_by and salt_on:
        salts = df.sparkSession.sparkContext.defaultParallelism
        salt = F.pmod(F.xxhash64(*salt_on), F.lit(salts))
        df = df.repartition(*partition_by, salt)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.save(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: what several parts of a plan use is computed once."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_non_empty(df: DataFrame, path: str, **kwargs) -> bool:
    """Write unless there is nothing to write; tells whether it wrote."""
    if df.isEmpty():
        return False
    write_table(df, path, **kwargs)
    return True


def publish_snapshot(log: DataFrame, table: str, path: str | None = None) -> None:
    """Replace the serving table: load time added, one partition per day, time-ordered.

    ``path`` places the files; otherwise they go to the session's warehouse.
    """
    rows = log.withColumn("actualizado_en", F.current_timestamp()).withColumn(
        "dia", F.col("timestamp").cast("date")
    )
    ordered = rows.repartitionByRange("dia", "timestamp").sortWithinPartitions("dia", "timestamp")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if path:
        writer = writer.option("path", path)
    writer.partitionBy("dia").saveAsTable(table)


def refresh_snapshot(spark: SparkSession, log: DataFrame, table: str, path: str | None = None) -> None:
    """Replace the days of ``log`` in the serving table; a table that does not exist yet is made of them."""
    if not spark.catalog.tableExists(table):
        publish_snapshot(log, table, path)
        return
    rows = log.withColumns({"actualizado_en": F.current_timestamp(), "dia": F.col("timestamp").cast("date")})
    ordered = rows.select(*spark.table(table).columns).repartitionByRange("dia", "timestamp").sortWithinPartitions("dia", "timestamp")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table)


def seed_snapshot(spark: SparkSession, log: DataFrame, table: str, path: str | None = None) -> bool:
    """Publish only when the table does not exist yet."""
    if spark.catalog.tableExists(table):
        return False
    publish_snapshot(log, table, path)
    return True
