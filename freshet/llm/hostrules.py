"""Quality rules with host-level verdicts.

Every document is measured once (counts below). Rules turn the counts into failures, and a document that fails any rule
is not kept. Failures are also aggregated per host, and each rule's host rates are shrunk with a beta prior fitted to all
hosts by moments, so that a host of two documents is not condemned by one failure. A rule's limit follows from its prior:
``SPREAD`` standard deviations above the mean, within ``HOST_LIMITS``. Hosts whose shrunk rate of any rule reaches the limit
are rejected; the verdict is joined back and takes all their documents along. Only rejected hosts take part in that
join. Measuring yields narrow rows that are written once; the aggregation has a map-side half, so a host with a
third of all documents is a few partial rows.

Defined results: null text counts like an empty one (no words, failed); a null host is the host "" of all
documents without one; repeated rows each count; with a single host, or hosts of equal rates, the prior is
the flat one (1, 1).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import gram_hashes, map_rows, stored, utf8, word_hashes

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\f\r"
# Below a fifth a rejection would cost mostly documents that fail nothing; above a half it is due whatever the other hosts do.
SPREAD, HOST_LIMITS = 4.0, (0.2, 0.5)
BASE = ("short", "repetitive")


def rules() -> dict[str, Column]:
    """Failures per document; ``BASE`` names the base rules.

    Word length says nothing where words are not set apart by blanks (Chinese, Japanese, Thai: about three bytes a
    character). A line that recurs once or twice in a text of few lines is no share of it.
    """
    words, blanks = F.col("n_words"), 2 * F.col("word_bytes") < 5 * F.col("word_chars")
    return {
        "short": words < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "word_length": blanks & ((F.col("word_chars") > 10 * words) | (F.col("word_chars") < 3 * words)),
        "dup_lines": (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) & (F.col("n_dup_lines") > 2),
    }


def measures(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, word_bytes of one whole text."""
    raw = utf8(text)
    words = raw.split()
    # Characters are the bytes that do not continue one; blanks are single bytes.
    body = raw.translate(None, BLANKS)
    chars = len(body) - int(np.count_nonzero((np.frombuffer(body, np.uint8) & 0xC0) == 0x80))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), len(body)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice, first occurrences included."""
    if len(words) <= window:
        return 0
    _, which, counts = np.unique(gram_hashes(word_hashes(words), window), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def measured(docs: DataFrame, host: Column) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "word_bytes")

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = [measures(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "host": cols["host"]} | {n: [f[i] for f in found] for i, n in enumerate(names)}

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), "text")
    return map_rows(rows, run, "doc_id bigint, host string, " + ", ".join(f"{n} bigint" for n in names))


def shrunk(failures: Column, n: Column, alpha: Column, beta: Column) -> Column:
    return (failures + alpha) / (n + alpha + beta)


def host_rates(rows: DataFrame, rule_set: Mapping[str, Column]) -> DataFrame:
    """host, n and per rule: failures, prior (alpha, beta), shrunk rate and the limit that follows from the prior."""
    fails = [F.count_if(c).alias(f"{name}_failures") for name, c in rule_set.items()]
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *fails)
    hosts = stored(hosts, "hosts")
    # Moments of the host rates: the only values here that reach the driver, two per rule.
    rate = {name: F.col(f"{name}_failures") / F.col("n") for name in rule_set}
    moments = hosts.agg(
        F.count(F.lit(1)).alias("_hosts"), *[F.avg(r).alias(f"{name}_m") for name, r in rate.items()],
        *[F.var_pop(r).alias(f"{name}_v") for name, r in rate.items()],
    ).first()
    out = hosts
    for name in rule_set:
        alpha, beta = beta_prior(moments[f"{name}_m"], moments[f"{name}_v"])
        out = out.withColumns({f"{name}_alpha": F.lit(alpha), f"{name}_beta": F.lit(beta)})
        out = out.withColumn(f"{name}_rate", shrunk(
            F.col(f"{name}_failures"), F.col("n"), F.col(f"{name}_alpha"), F.col(f"{name}_beta")))
        out = out.withColumn(f"{name}_limit", F.lit(host_limit(alpha, beta)))
    return out


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Beta parameters with the given moments; the flat prior where they define none."""
    if mean is None or not 0 < mean < 1 or not variance or variance >= mean * (1 - mean):
        return 1.0, 1.0
    strength = mean * (1 - mean) / variance - 1
    return mean * strength, (1 - mean) * strength


def host_limit(alpha: float, beta: float) -> float:
    """``SPREAD`` standard deviations above the mean of the prior, within ``HOST_LIMITS``."""
    mean = alpha / (alpha + beta)
    low, high = HOST_LIMITS
    return min(max(mean + SPREAD * (mean * (1 - mean) / (alpha + beta + 1)) ** 0.5, low), high)


def judged(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host, the five counts, base_failed, rules_failed (any other rule), host_rejected, kept."""
    rows = stored(measured(docs, host), "measured")
    found = rules()
    bad = reduce(or_, [F.col(f"{name}_rate") >= F.col(f"{name}_limit") for name in found])
    rejected = stored(host_rates(rows, found).filter(bad).select("host", F.lit(True).alias("_bad")), "rejected_hosts")
    out = rows.join(rejected, "host", "left").withColumns({
        "base_failed": reduce(or_, [found[name] for name in BASE]),
        "rules_failed": reduce(or_, [rule for name, rule in found.items() if name not in BASE]),
        "host_rejected": F.coalesce("_bad", F.lit(False)),
    })
    kept = ~F.col("base_failed") & ~F.col("rules_failed") & ~F.col("host_rejected")
    return out.withColumn("kept", kept).drop("_bad", "n_lines", "word_bytes")
