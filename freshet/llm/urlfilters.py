"""Temporal URL list join with DataFrame functions only.

Dated list entries (list, key, day, action add or remove) become validity intervals [from, to) and every capture is
judged by the entries active when it was fetched. A key is a host or a parent domain; a capture matches its own host
and every parent of at least two labels.

An interval is cut into months; captures and intervals meet on (key, month) and a range test, so a key with a long
history costs a capture one month of it. Entries collapse to one per list, key and day before the interval window, which
bounds a window group by the days of the calendar. The join has an exchange on either side; a host with a third of
all captures is split at run time.

Rules: several actions of one list, key and day count as the last in the order add, remove; adding an
active entry or removing an inactive one changes nothing; an interval without removal stays open. The most specific key
wins; on a tie an allow list beats a block list, then the first list by name.

Defined results: a null or unparsable URL has no host and is not blocked; a null fetch time matches nothing; entries
with a null list, key, day or action are ignored; repeated captures are each judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import lower_ascii, stored

OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading "www."; null if there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(lower_ascii(F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")), r"^www\.|\.$", "")
    return F.when(F.length(host) > 0, host)


def keys_of(host: Column) -> Column:
    """The host and its parents of two labels and more, most specific first."""
    labels = F.split(host, r"\.")
    deepest = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), deepest), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, from, to of every stretch of days on which an entry is active."""
    valid = entries.filter("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    daily = valid.groupBy("list", "kind", "key", "day").agg(F.max("action").alias("action"))
    by = Window.partitionBy("list", "kind", "key").orderBy("day")
    changes = daily.withColumn("_before", F.lag("action").over(by)).filter(
        (F.col("action") != F.coalesce("_before", F.lit("remove"))))
    spans = changes.withColumn("to", F.coalesce(F.lead("day").over(by), F.lit(OPEN_END).cast("date")))
    return spans.filter("action = 'add'").select("list", "kind", "key", F.col("day").alias("from"), "to")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (capture_id, url, fetched) with host, n_active, list, kind, key, valid_from, blocked."""
    rows = captures.select("capture_id", F.col("fetched").cast("date").alias("fetched"), host_of(F.col("url")).alias("host"))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "captures")
    months = rows.agg(F.trunc(F.min("fetched"), "MM"), F.trunc(F.max("fetched"), "MM")).first()
    # Open intervals reach to the last fetch month and none starts before the first: a bounded calendar.
    lo, hi = (F.lit(m).cast("date") for m in months)
    month = F.explode(F.sequence(F.greatest(F.trunc("from", "MM"), lo), F.least(F.trunc("to", "MM"), hi), F.expr("INTERVAL 1 MONTH")))
    active = intervals(entries).filter((F.trunc("to", "MM") >= lo) & (F.trunc("from", "MM") <= hi))
    active = stored(active.select("list", "kind", "key", "from", "to", month.alias("month")), "intervals")

    looked = rows.select("_row", "fetched", F.trunc("fetched", "MM").alias("month"),
                         F.posexplode(keys_of(F.col("host"))).alias("depth", "key"))
    hits = looked.join(active, ["key", "month"]).filter((F.col("fetched") >= F.col("from")) & (F.col("fetched") < F.col("to")))
    first = F.struct("depth", "kind", "list", "key", F.col("from").alias("valid_from"))
    best = hits.groupBy("_row").agg(F.count(F.lit(1)).alias("n_active"), F.min(first).alias("m"))
    out = rows.join(best, "_row", "left").select(
        "capture_id", "host", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        "m.list", "m.kind", "m.key", "m.valid_from",
    )
    return out.withColumn("blocked", F.coalesce(F.col("kind") == "block", F.lit(False)))
