"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled text in which toxic documents may hide.
The classifier minimises the class-prior-corrected risk

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

with the logistic loss, in numpy. When the bracket turns negative, its gradient is followed upwards,
which keeps the model from fitting away the toxic documents among the unlabelled ones.

Fitting uses a bounded sample: at most ``MAX_POSITIVE`` confirmed and ``MAX_UNLABELLED`` other rows,
lowest hash of the id first. The unlabelled rows are drawn from the labelled table with their labels hidden, so
the prior is the share of toxic rows in it. Inputs are words and word beginnings, by how many distinct words share
them; their counts in the sample are aggregated in Spark, and the ``FEATURES`` most over-represented among
positives are used, so what reaches the driver is bounded by rows x features whatever the length of the texts. Scoring covers every document and whole texts.

Defined results: null and empty texts have no words and get the intercept's score; without any confirmed example
every score is 0; repeated rows each get their score; the labels table may repeat ids (any 1 confirms).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import held_out, map_rows, stored

MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
FEATURES, MIN_DOCS = 2_048, 4
STEPS, RATE, L2, L1 = 400, 0.1, 1e-4, 2e-4

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)
REMEMBERED = 300_000


def word_set(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def stems(word: str) -> list[str]:
    """The word and its beginnings: inflected and compound forms share them."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def inputs(text: str | None, known: dict[str, tuple[str, ...]], wanted: dict[str, int] | None = None) -> set[tuple[str, int]]:
    """Stem and level: the stem begins at least that many distinct words of the text.

    ``known`` remembers the (wanted) stems of words; it is emptied when full.
    """
    counts: Counter = Counter()
    for word in word_set(text):
        found = known.get(word)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = tuple(s for s in stems(word) if wanted is None or s in wanted)
            known[word] = found
        counts.update(found)
    return {(s, level) for s, n in counts.items() for level in LEVELS if n >= level}


@dataclass(frozen=True)
class Classifier:
    """Weights by (stem, level)."""

    weights: dict[tuple[str, int], float]
    intercept: float

    def scores(self, texts: list[str | None], known: dict[str, tuple[str, ...]]) -> list[float]:
        wanted = {stem: 1 for stem, _ in self.weights}
        z = [self.intercept + sum(sorted(self.weights.get(i, 0.0) for i in inputs(t, known, wanted))) for t in texts]
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """Training rows (doc_id, text, kind p or u) outside the test fold, and the class prior."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stored(marks.filter(~held_out()), "marks")
    total, toxic = marks.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    p = marks.filter("toxic = 1").orderBy(*order).limit(positives).select("doc_id", F.lit("p").alias("kind"))
    u = marks.orderBy(*order).limit(unlabelled).select("doc_id", F.lit("u").alias("kind"))
    rows = stored(p.unionByName(u), "sample")
    return docs.select("doc_id", "text").join(rows, "doc_id"), toxic / total if total else 0.0


def features(rows: DataFrame, n_features: int, min_docs: int) -> list[tuple[str, int]]:
    """Inputs in the most positive documents beyond their share of the unlabelled ones."""

    def count(cols: dict[str, list]) -> dict[str, list]:
        seen: dict[str, Counter] = {"p": Counter(), "u": Counter()}
        known: dict[str, tuple[str, ...]] = {}
        for kind, text in zip(cols["kind"], cols["text"]):
            seen[kind].update(inputs(text, known))
        keys = list(seen["p"].keys() | seen["u"].keys())
        return {"word": [k[0] for k in keys], "level": [k[1] for k in keys],
                "p": [seen["p"][k] for k in keys], "u": [seen["u"][k] for k in keys]}

    counts = map_rows(rows.select("kind", "text"), count, "word string, level int, p bigint, u bigint")
    counts = counts.groupBy("word", "level").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") >= min_docs)
    sizes = dict(rows.groupBy("kind").count().collect())
    n_p, n_u = sizes.get("p", 0), sizes.get("u", 0)
    # The signed root of the log-likelihood ratio against the unlabelled rate orders by evidence.
    expected = (F.col("u") + 1) * (n_p / (n_u + 2))
    gain = F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected)
    best = counts.filter(F.col("p") > expected).orderBy(gain.desc(), "word", "level").limit(n_features)
    return [(r["word"], r["level"]) for r in best.select("word", "level").collect()]


def fit_nnpu(x_p: list[np.ndarray], x_u: list[np.ndarray], n: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear model on word presence (rows are arrays of feature numbers)."""
    rows = [*x_p, *x_u]
    sizes = np.array([len(r) for r in rows])
    index = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    pos = np.arange(len(rows)) < len(x_p)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, w[index], minlength=len(rows))
        negative = softplus(z[~pos]).mean() - prior * softplus(z[pos]).mean()
        up = prior * (sigmoid(z) - 1) * pos / max(pos.sum(), 1)
        down = sigmoid(z) * (~pos) / max((~pos).sum(), 1) - prior * sigmoid(z) * pos / max(pos.sum(), 1)
        g = up + down if negative >= 0 else -down
        grad = np.append(np.bincount(index, g[owner], minlength=n) + L2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1, 0)
    return w, b


def train(docs: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVE, unlabelled: int = MAX_UNLABELLED,
          n_features: int = FEATURES, min_docs: int = MIN_DOCS) -> Classifier:
    rows, prior = sample(docs, labels, positives, unlabelled)
    rows = stored(rows, "training_rows")
    words = features(rows, n_features, min_docs)
    number = {w: i for i, w in enumerate(words)}
    wanted = {stem: 1 for stem, _ in words}

    def mark(cols: dict[str, list]) -> dict[str, list]:
        known: dict[str, tuple[str, ...]] = {}
        hits = [sorted(number[i] for i in number.keys() & inputs(t, known, wanted)) for t in cols["text"]]
        return {"kind": cols["kind"], "hits": hits}

    found = map_rows(rows.select("kind", "text"), mark, "kind string, hits array<int>").toPandas()
    split = {k: [np.asarray(h, np.int64) for h in found.loc[found["kind"] == k, "hits"]] for k in ("p", "u")}
    if not split["p"] or not split["u"] or not words:
        return Classifier({}, -50.0)
    prior = min(max(prior, 1e-4), 0.9)
    w, b = fit_nnpu(split["p"], split["u"], len(words), prior)
    return Classifier({words[i]: float(w[i]) for i in np.flatnonzero(w)}, b)


def score(docs: DataFrame, model: Classifier, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``toxic_score`` (0 to 1), which replaces an input column of that name."""
    columns = [c for c in columns if c != "toxic_score"]
    schema = docs.select(*columns).schema

    known: dict[str, tuple[str, ...]] = {}  # lives as long as a task

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {c: cols[c] for c in columns} | {"toxic_score": model.scores(cols["text"], known)}

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", toxic_score double"
    return map_rows(docs.select("text", *[c for c in columns if c != "text"]), run, ddl)
