"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Every benchmark window (``WINDOW`` consecutive words; a shorter item is one window) is a set of positioned
shingles. Containment of the whole window needs all of its shingles, so a prefix of one is enough:

1. Document shingles that occur in any window are found (``occurrences``) and counted over all
   documents. A window with a shingle that no document has cannot occur and goes.
2. Each remaining window keeps its rarest shingle; joining that with the occurrences gives candidates.
   Positional bound: the window would start at (document position - shingle offset) >= 0; length bound: it
   must end inside the document.
3. Candidates meet the document's words again and are verified word by word.

The shingle table comes from the benchmark, not from documents. It is broadcast only when it has at most
``BROADCAST_ROWS`` rows of three numbers; above that the occurrences are found by a shuffled join with
the same result.

Defined results: null text has no words; items without words have no window; rows sharing a ``doc_id``
are judged by their own text; items sharing an ``item_id`` count as one item; null item ids are named "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import carried, lower_ascii, stored, unpacked

WINDOW, SHINGLE = 13, 5
BROADCAST_ROWS = 2_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1)
    return F.array_remove(parts, "")


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once per row, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def shingles(ws: Column, sizes: list[int]) -> Column:
    """Array of (pos, k, sh): the hash of every run of k words, for each k in ``sizes``."""

    def runs(k: int):
        def of(ws: Column) -> Column:
            starts = F.when(F.size(ws) >= k, F.sequence(F.lit(1), F.size(ws) - (k - 1))).otherwise(
                F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.struct(
                (i - 1).alias("pos"), F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.slice(ws, i, k)).alias("sh")))

        return of

    return bound(ws, lambda a: F.concat(*[runs(k)(a) for k in sizes]))


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words) and the items that have them (wid, item)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws"))
    items = items.filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (window - 1)))
    runs = items.select("item", "ws", F.explode(starts).alias("i")).select("item", F.slice("ws", F.col("i"), window).alias("words"))
    runs = runs.withColumn("wid", F.sha2(F.concat_ws(" ", "words"), 256))
    return runs.select("wid", "words").distinct(), runs.select("wid", "item").distinct()


def window_shingles(found: DataFrame, size: int = SHINGLE) -> DataFrame:
    """wid, len, offset, k, sh of every shingle of every window."""
    sized = found.withColumns({"len": F.size("words"), "k": F.least(F.size("words"), F.lit(size))})
    each = sized.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("k") + 1)))
    return each.select("wid", "len", (F.col("i") - 1).alias("offset"), "k",
                       F.xxhash64("k", F.slice("words", F.col("i"), F.col("k"))).alias("sh"))


def occurrences(docs: DataFrame, wanted: DataFrame, sizes: list[int], wanted_rows: int) -> DataFrame:
    """Positions of wanted shingles in documents: _r1, _r2, n_words, pos, sh."""
    ws = words(F.col("text"))
    rows = docs.select("_r1", "_r2", bound(ws, lambda a: F.struct(F.size(a).alias("n"), shingles(a, sizes).alias("s"))).alias("_d"))
    rows = rows.select("_r1", "_r2", F.col("_d.n").alias("n_words"), F.explode("_d.s").alias("_s"))
    rows = rows.select("_r1", "_r2", "n_words", F.col("_s.pos").alias("pos"), F.col("_s.sh").alias("sh"))
    return rows.join(F.broadcast(wanted) if wanted_rows <= BROADCAST_ROWS else wanted, "sh")


def covered(spans: Column) -> Column:
    """Number of positions in the union of (start, len) spans sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        new = F.greatest(F.lit(0), end - F.greatest(s["start"], acc["end"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = SHINGLE,
                  percent: int = 5) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, items (sorted ids with occurring windows), contaminated."""
    keyed = carried(docs)
    found, owners = (stored(t, label) for t, label in zip(windows(benchmark, window), ("windows", "window_items")))
    n_windows = found.count()
    grams = stored(window_shingles(found, size), "window_shingles", n_windows * window)
    wanted = stored(grams.select("sh").distinct(), "shingles", n_windows * window)
    sizes = sorted(r[0] for r in grams.select("k").distinct().collect())  # at most ``size`` numbers
    texts = keyed.select("_r1", "_r2", F.col("row.text").alias("text"))
    if sizes:
        hits = stored(occurrences(texts, wanted, sizes, wanted.count()), "occurrences")
    else:
        hits = docs.sparkSession.createDataFrame([], "sh bigint, _r1 bigint, _r2 bigint, n_words int, pos int")
    rarity = hits.groupBy("sh").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(rarity, "sh", "left").groupBy("wid", "len").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sh", "offset")).alias("least"))
    anchors = ranked.filter("least.df > 0").select("wid", "len", "least.sh", "least.offset")
    anchors = stored(anchors.join(found, "wid"), "anchors", n_windows)
    starts = hits.join(anchors, "sh").withColumn("start", F.col("pos") - F.col("offset"))
    starts = starts.filter("start >= 0 AND start + len <= n_words")
    per_doc = starts.groupBy("_r1", "_r2").agg(F.collect_set(F.struct("start", "len", "wid", "words")).alias("cands"))
    per_doc = stored(per_doc, "candidates")

    def verify(ws: Column) -> Column:
        same = F.filter("cands", lambda c: F.slice(ws, c["start"] + 1, c["len"]) == c["words"])
        return F.array_sort(F.transform(same, lambda c: F.struct(
            c["start"].alias("start"), c["len"].alias("len"), c["wid"].alias("wid"))))

    spans = texts.join(per_doc, ["_r1", "_r2"]).select("_r1", "_r2", bound(words(F.col("text")), verify).alias("spans"))
    # Rows with the same id and text have the same spans: one of them is enough.
    spans = stored(spans.filter(F.size("spans") > 0).dropDuplicates(["_r1", "_r2"]), "spans")
    items = (
        spans.select("_r1", "_r2", F.explode("spans.wid").alias("wid")).distinct()
        .join(owners, "wid").groupBy("_r1", "_r2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    verdict = spans.select("_r1", "_r2", covered(F.col("spans")).alias("n_hit")).join(items, ["_r1", "_r2"])
    verdict = stored(verdict, "verdicts")
    out = keyed.join(verdict, ["_r1", "_r2"], "left").select(
        "row", F.size(words(F.col("row.text"))).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return unpacked(out.withColumn("contaminated", bad), docs.columns, ["n_words", "n_hit", "items", "contaminated"])
