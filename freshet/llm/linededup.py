"""Line dedup with DataFrame functions only.

Normalised lines are exploded with their position and hashed; distinct documents are counted
per hash; lines of hashes over the threshold are dropped, except in the document with the
largest id; what stays is reassembled by position. Text crosses the network once (the last join); before
that only hashes and positions do. A line that a third of all documents hold is counted by partial
aggregates, and the join with it has an exchange on either side, so a skewed key is split at run time.

Defined results: null or empty text is one empty line; rows sharing a ``doc_id`` count as one document
for the threshold and keep their own text; a null ``doc_id`` counts as one document below every other
(its lines are never the kept ones unless no id holds the line); other columns pass through untouched, but for
``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import carried, fingerprint, lower_ascii, stored, unpacked

MIN_CHARS, MIN_DOCS = 20, 3
STRIPPED = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: row fingerprint, id, position, 128-bit key hash."""
    lines = docs.select(
        "doc_id", *fingerprint("doc_id", "text"),
        F.posexplode(split_lines(lower_ascii(F.coalesce("text", F.lit(""))))).alias("pos", "line"),
    )
    key = F.btrim("line", F.lit(STRIPPED))
    lines = lines.select("doc_id", "_r1", "_r2", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
    return lines.select(
        "doc_id", "_r1", "_r2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")
    )


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes held by at least ``min_docs`` documents, with the document that keeps its lines."""
    per_doc = lines.select("h1", "h2", "doc_id").distinct()
    counted = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n") >= min_docs).drop("n")


def without_positions(lines: Column, dropped: Column) -> Column:
    """The array without the (ascending) positions; each kept stretch is one slice."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))

    def kept(ls: Column) -> Column:
        ends = F.concat(dropped, F.array(F.size(ls)))
        gaps = F.arrays_zip(starts.alias("s"), ends.alias("e"))
        return F.flatten(F.transform(gaps, lambda g: F.slice(ls, g["s"] + 1, g["e"] - g["s"])))

    # The one-element array binds the split lines to a variable, so they are split once per row.
    return F.transform(F.array(lines), kept)[0]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, plus ``n_lines`` (before) and ``n_dropped``."""
    lines = keyed_lines(docs, min_chars)
    frequent = stored(frequent_lines(lines, min_docs), "frequent_lines")
    hits = lines.join(frequent, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = hits.groupBy("_r1", "_r2").agg(F.sort_array(F.collect_set("pos")).alias("_dropped"))
    joined = carried(docs).join(drops, ["_r1", "_r2"], "left")
    text = F.col("row.text")
    split = split_lines(text)
    kept = F.concat_ws("\n", without_positions(split, F.col("_dropped")))
    out = joined.select(
        "row", F.size(split).cast("long").alias("n_lines"),
        F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"),
        F.when(F.col("_dropped").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("text"),
    )
    return unpacked(out, docs.columns, ["text", "n_lines", "n_dropped"])
