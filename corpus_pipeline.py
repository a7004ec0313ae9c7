"""The corpus pipeline: five operators, each applied to what the stage before it kept.

A stage reads its predecessor's table (written as Parquet) and returns the columns of ``documents``; the last one
returns the packed pieces. Trained and measured inputs (labels, benchmark) are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import decontam, linededup, minhash, packing, toxicity
from freshet.llm.common import carried, stored, table
from freshet.llm.queries import tokenizer_path

NEAR_COPIES = 80  # per cent; op8's contract of 85 binds op8 only


def with_free_names(docs: DataFrame, results: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like a result under another name, and that name by their own."""
    private: dict[str, str] = {}
    for name in docs.columns:
        if name in results:
            other = f"_input_{name}"
            while other in docs.columns:
                other = f"_{other}"
            private[name] = other
    return docs.withColumnsRenamed(private), private


def as_before(df: DataFrame, docs: DataFrame, private: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` again, in order and under their own names."""
    return df.select(*[F.col(private.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    Null and empty texts have the score of no words; repeated rows are judged alike; rows without an id are scored, but never learnt from.
    """
    free, private = with_free_names(docs, ["toxic_score"])
    model = toxicity.train(free, table(spark, sf_dir, "labels"))
    return as_before(toxicity.score(free, model, free.columns).filter("toxic_score < 0.5"), docs, private)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go; every document stays, with ``n_chars`` of its new text.

    A null text becomes an empty one; rows that share an id (or have none) count as one document.
    """
    free, private = with_free_names(docs, ["n_lines", "n_dropped"])
    kept = linededup.dedup_lines(free)
    changes = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return as_before(kept.withColumns(changes), docs, private)


def row_ids(docs: DataFrame) -> DataFrame:
    """The rows as (row, _r1, _r2, _id): an id of their own for every different (doc_id, text).

    A document id stands for one text. Of several texts under one id one keeps it; the others, and texts without an id, get an id beyond
    all given ones from their fingerprint. Only such rows are listed and joined.
    """
    rows = carried(docs)
    given = F.col("row.doc_id").cast("long").alias("given")
    prints = stored(rows.select(given, "_r1", "_r2").distinct(), "row_prints")
    n = prints.count()
    least = prints.groupBy("given").agg(F.min(F.struct("_r1", "_r2")).alias("least"), F.count(F.lit(1)).alias("texts"))
    shared = stored(least.filter("given IS NULL OR texts > 1"), "shared_ids", n)
    several = prints.join(shared, "given").filter("struct(_r1, _r2) <> least").select("_r1", "_r2")
    odd = several.unionByName(prints.filter("given IS NULL").select("_r1", "_r2"))
    beyond = (F.xxhash64("_r1", "_r2").bitwiseAND(F.lit(2**61 - 1)) + F.lit(2**62)).alias("_other")
    odd = stored(odd.select("_r1", "_r2", beyond), "odd_rows", n)
    return rows.join(odd, ["_r1", "_r2"], "left").select("row", "_r1", "_r2", F.coalesce("_other", given).alias("_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (word shingles alike to ``NEAR_COPIES`` per cent or more) the document with the
    smallest id stays.

    Of rows equal in id and text one stays. Documents without words are linked with nothing. Several texts under one id are judged each for
    itself; texts without an id come after all others.
    """
    rows = row_ids(docs)
    # Only ids move: what goes is listed, and the documents are filtered by that list.
    found = minhash.near_duplicates(rows.select(F.col("_id").alias("doc_id"), F.col("row.text").alias("text")), NEAR_COPIES)
    n = docs.count()
    gone = stored(found.filter("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "near_copies", n)
    again = stored(rows.groupBy("_r1", "_r2").count().filter("count > 1").select("_r1", "_r2"), "repeated_rows", n)
    left = rows.join(gone, "_id", "left_anti")
    single = left.join(again, ["_r1", "_r2"], "left_anti").select("row")
    # Partial aggregates: a row copied very often is a few rows before the exchange.
    one = left.join(again, ["_r1", "_r2"]).groupBy("_r1", "_r2").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(one).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage on one twentieth of their words or more go.

    Null and empty texts have no words and stay; repeated rows, and rows of one id, are judged by their own text.
    """
    free, private = with_free_names(docs, ["n_words", "n_hit", "items", "contaminated"])
    found = decontam.contamination(free, table(spark, sf_dir, "benchmark"))
    return as_before(found.filter("NOT contaminated"), docs, private)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents in sequences of at most 4096 tokens.

    Null texts are empty ones, which still end in their closing token; repeated rows are packed each.
    """
    return packing.sequences(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Toxicity and packing are a trained model and a heuristic: no SQL equivalent. Tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
