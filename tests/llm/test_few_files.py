"""Short rows are written to few files however many partitions shuffles have; the results stay the same."""

import glob

import pytest
from pyspark.sql import functions as F

from freshet.llm import common, graph, minhash

PARTITIONS = 64


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def files(spark, monkeypatch):
    """Label and number of files of every table written."""
    made, stored = [], common.stored

    def noted(df, label, *rest):
        out = stored(df, label, *rest)
        made.append((label, len(glob.glob(out.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] + "/part-*"))))
        return out

    monkeypatch.setattr(minhash, "stored", noted)
    monkeypatch.setattr(graph, "stored", noted)
    return made


def test_a_table_of_ids_has_few_files(spark, many_partitions, files):
    # Documents in groups of three near copies: 60 words, of which a copy changes the last.
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.hash(F.floor(F.col("id") / 3), i).cast("string")),
        F.concat(F.lit("end"), F.col("id") % 3)).alias("text"))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i // 3 * 3 for i in range(600)}
    cores = spark.sparkContext.defaultParallelism
    ids = {"classes", "buckets", "bucket_members", "near_pairs", "confirmed", "links", "components", "class_labels"}
    assert ids <= {label for label, _ in files}
    assert all(n <= cores for label, n in files if label in ids), files


def test_many_rows_are_not_dealt_again(spark, many_partitions):
    rows = spark.range(4000).groupBy((F.col("id") % 1000).alias("id")).count()
    few, many = (common.stored(rows, "ids", n) for n in (1000, PARTITIONS * common.FILE_ROWS))
    assert len(few.inputFiles()) <= spark.sparkContext.defaultParallelism < len(many.inputFiles())
    assert sorted(r[0] for r in few.collect()) == sorted(r[0] for r in many.collect()) == list(range(1000))
