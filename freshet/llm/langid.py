"""Language ID by interpolated Kneser-Ney character models.

Counting covers every training document: tasks count distinct words first, then the character grams of the distinct words
weighted by those counts, and Spark sums (language, gram) rows. A word is read with blanks around it and contexts never
reach beyond its own start, so a text's cost is the sum of its words' and equal words are scored once.

Model: grams up to ``ORDER`` characters under their packed 64 bits, so different grams never meet (letters beyond 16 bits are numbered: the
first 16,000 or so seen in training have a code each, any others share one with the unseen). Tables of up
to ``CELLS`` cells (rows x languages) travel in the task; larger ones stay in Spark, and the distinct grams of the texts are joined with them.
The highest order holds counts; lower orders hold continuation counts (distinct characters seen before the gram).
Each order is a sorted gram array with one column of discounted shares per language:

    p_n(c | h) = max(count - D, 0) / total(h) + D * types(h) / total(h) * p_{n-1}(c | h')

down to a uniform distribution over the alphabet. D is estimated per order as n1 / (n1 + 2 n2).

The language with the lowest cross-entropy per character wins. The confidence is a logistic function of its lead over the
second, times the square root of the length; slope, offset and the rejection limit are calibrated on all training documents,
never on held-out ones: leads meet in cells of a fixed relative width (``LEAD_CELLS``), and each cell counts its documents and the right ones.

Defined results: null text and texts without a letter are "und" with score 0; without training rows everything is "und"; a null or
empty lang is not learned; repeated rows are counted and scored each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import held_out, map_rows, stored

ORDER = 4
CELLS = 4_000_000
LEAD_CELLS = 1_000  # cells of the lead per factor e
TRUSTED = 0.99  # share of right answers wanted above the rejection limit
REMEMBERED = 300_000
UNKNOWN = "und"
BLANK = 32
WORD = re.compile(r"[^\W\d_]+")


# 16-bit codes that are no letter: the letters beyond 16 bits seen in training get them, in order. All others get UNSEEN.
UNSEEN = 0xFFFF
FREE = np.array([c for c in range(33, UNSEEN) if not chr(c).isalpha()], np.int64)


def letters(text: str | None) -> list[str]:
    """Runs of letters (``str.isalpha``), in lower case. ``WORD`` also takes numbers such as a half or a Roman four: they part words."""
    found = WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def letters_beyond(docs: DataFrame) -> np.ndarray:
    """The letters beyond 16 bits in the texts, sorted. Only texts that have such characters are read in Python."""
    rows = docs.select("text").filter(F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"c": [ord(c) for c in set().union(*(w for t in cols["text"] for w in letters(t))) if ord(c) > 0xFFFF]}

    found = map_rows(rows, run, "c bigint").distinct().orderBy("c").limit(len(FREE)).collect()
    return np.array([r["c"] for r in found], np.int64)


def packed(words: list[str], beyond: np.ndarray = FREE[:0]) -> np.ndarray:
    """For every character of every word and its final blank: that character and the three before it, 16 bits each.

    Characters before the blank that opens the word are 0. Letters beyond 16 bits have the code of their place in ``beyond``.
    """
    text = " " + " ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = codes > 0xFFFF
    if wide.any():
        at = np.searchsorted(beyond, codes[wide])
        known = np.append(beyond, -1)[at] == codes[wide]
        codes[wide] = np.where(known, FREE[np.minimum(at, len(FREE) - 1)], UNSEEN)
    codes = codes.astype(np.uint64)
    place = np.arange(len(codes))
    opened = np.maximum.accumulate(np.where(codes == BLANK, place, 0))[:-1]
    out = np.zeros(len(codes) - 1, np.uint64)
    for back in range(ORDER):
        at = place[1:] - back
        out |= np.where(at >= opened, codes[np.maximum(at, 0)], np.uint64(0)) << np.uint64(16 * back)
    return out


def last(gram: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` characters of packed grams."""
    return gram & np.uint64((1 << 16 * k) - 1)


def hashed(gram: np.ndarray, k: int) -> np.ndarray:
    """Key of the last ``k`` characters: these themselves."""
    return last(gram, k).view(np.int64)


def context(gram: np.ndarray, k: int) -> np.ndarray:
    """Key of the k - 1 characters before the last one."""
    return hashed(gram >> np.uint64(16), k - 1)


def counted(docs: DataFrame, beyond: np.ndarray = FREE[:0]) -> DataFrame:
    """lang and packed gram with its number, over all rows given."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(cols["lang"], cols["text"]):
            words[lang].update(letters(text))
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang, counts in words.items():
            if not counts:
                continue
            sizes = np.array([len(w) + 1 for w in counts])
            weights = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), sizes)
            grams, which = np.unique(packed(list(counts), beyond), return_inverse=True)
            out["lang"].extend([lang] * len(grams))
            out["gram"].extend(grams.view(np.int64).tolist())
            out["n"].extend(np.bincount(which, weights).astype(np.int64).tolist())
        return out

    rows = map_rows(docs.select("lang", "text"), run, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def orders(counts: DataFrame) -> DataFrame:
    """lang, k, context ``h``, gram ``g``, number: counts at the highest k, continuation counts below."""
    out = above = counts.select("lang", F.lit(ORDER).alias("k"), "gram", "n")
    for k in range(ORDER - 1, 0, -1):
        # The gram without its first character, once for every different first character.
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")
        above = above.groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n")).select("lang", F.lit(k).alias("k"), "gram", "n")
        out = out.unionByName(above)

    return out.select("lang", "k", F.col("gram").alias("g"), F.shiftrightunsigned("gram", 16).alias("h"), "n")


@dataclass
class Order:
    """One order for all languages: sorted grams with the discounted share of each, and sorted contexts
    with the weight left for the order below (rows are grams or contexts, columns languages)."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


def order_of(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Order:
    """The tables of one order from each language's (g, h, n)."""
    grams = np.unique(np.concatenate([g for g, _, _ in rows]))
    contexts = np.unique(np.concatenate([h for _, h, _ in rows]))
    share, rest = np.zeros((len(grams), len(rows))), np.ones((len(contexts), len(rows)))
    for j, (g, h, n) in enumerate(rows):
        once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        at = np.searchsorted(contexts, h)
        total = np.bincount(at, n, len(contexts))
        types = np.bincount(at, minlength=len(contexts))
        share[np.searchsorted(grams, g), j] = (n - discount) / total[at]
        rest[total > 0, j] = discount * types[total > 0] / total[total > 0]
    return Order(grams, share, contexts, rest)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
    """Rows of ``values`` at the wanted keys of a sorted array."""
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), absent)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], absent)


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    orders: list[Order] = field(default_factory=list)
    alphabet: int = 1
    slope: float = 1.0
    offset: float = 0.0
    limit: float = 0.0
    beyond: np.ndarray = field(default_factory=lambda: FREE[:0])  # letters beyond 16 bits, sorted
    large: tuple[DataFrame, DataFrame] | None = None  # shares and rests of the orders above 1, where they stay in Spark

    def costs(self, words: list[str]) -> np.ndarray:
        """Natural-log cost of each word in each language (rows are words)."""
        grams, which = np.unique(packed(words, self.beyond), return_inverse=True)
        p = self.chances(grams)
        starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        return np.add.reduceat(-np.log(p)[which], starts, axis=0)

    def chances(self, grams: np.ndarray) -> np.ndarray:
        """p(last character | the three before it) of packed grams, in each language."""
        p = np.full((len(grams), len(self.langs)), 1.0 / self.alphabet)
        for k, t in enumerate(self.orders, 1):
            p = looked_up(t.grams, t.share, hashed(grams, k), 0.0) + looked_up(t.contexts, t.rest, context(grams, k), 1.0) * p
        return p

    def entropies(self, texts: list[str | None], known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of every text in every language, and the texts' lengths in characters."""
        counts = [Counter(letters(t)) for t in texts]
        new = list(set().union(*counts) - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*counts))
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            known.update(zip(part, self.costs(part)))
        length, cost = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        for i, c in enumerate(counts):
            if c:
                times = np.fromiter(c.values(), np.int64, len(c))
                length[i] = times @ np.fromiter((len(w) + 1 for w in c), np.int64, len(c))
                cost[i] = times @ np.array([known[w] for w in c])
        return cost / np.maximum(length, 1)[:, None], length

    def lead(self, entropy: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Lead of the best language over the second, in standard units of the text's length."""
        if entropy.shape[1] < 2:
            return np.sqrt(length)
        two = np.partition(entropy, 1, axis=1)[:, :2]
        return (two[:, 1] - two[:, 0]) * np.sqrt(length)


def learned(rows: DataFrame) -> Column:
    """Whether a row is learned from: it has a text and a language and lies outside the test fold."""
    return rows["text"].isNotNull() & F.coalesce(F.length(rows["lang"]) > 0, F.lit(False)) & ~held_out()


def counted_model(docs: DataFrame) -> Model:
    """The gram tables of every language named outside the test fold, not calibrated; counts cover all those documents."""
    rows = docs.filter(learned(docs)).select("lang", "text")
    beyond = letters_beyond(rows)
    counts = stored(counted(rows, beyond), "grams")
    tables = stored(orders(counts), "gram_tables")
    langs = sorted(r["lang"] for r in tables.select("lang").distinct().collect())
    whole = tables.count() * len(langs) <= CELLS
    # Order 1 has at most 2**16 rows per language.
    table = (tables if whole else tables.filter("k = 1")).toPandas()
    # Every character seen, and one for all others.
    model = Model(langs=langs, alphabet=int(table.loc[table["k"] == 1, "g"].nunique()) + 1, beyond=beyond)
    for k in range(1, (ORDER if whole else 1) + 1) if langs else ():
        parts = [table[(table["lang"] == lang) & (table["k"] == k)] for lang in langs]
        model.orders.append(order_of([(p["g"].to_numpy(), p["h"].to_numpy(), p["n"].to_numpy(float)) for p in parts]))
    if not whole:
        model.large = large_tables(tables.filter("k > 1"))
    return model


def train(docs: DataFrame) -> Model:
    """Models of every language named outside the test fold, calibrated; both cover all those documents."""
    model = counted_model(docs)
    calibrate(model, measured(docs.filter(learned(docs)).select("doc_id", "text", "lang"), model))
    return model


def trained_and_identified(docs: DataFrame) -> DataFrame:
    """``identified`` of the rows that the model is learned from and of all others, each text scored once."""
    model = counted_model(docs)
    known = docs.select("doc_id", "text", F.when(learned(docs), docs["lang"]).alias("lang"))
    rows = stored(measured(known, model), "leads")
    calibrate(model, rows.filter("lang IS NOT NULL"))
    return answered(rows, model)


def large_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables of ``order_of`` in Spark: (k, g, share per language) and (k, h, rest per language)."""
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5)
    discounts = stored(tables.groupBy("lang", "k").agg(discount.alias("d")), "discounts")
    totals = tables.groupBy("lang", "k", "h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    totals = stored(totals.join(discounts, ["lang", "k"]), "contexts")

    def by_lang(value: str) -> Column:
        return F.map_from_entries(F.collect_list(F.struct("lang", F.expr(value).alias("v"))))

    shares = tables.join(totals, ["lang", "k", "h"]).groupBy("k", "g").agg(by_lang("(n - d) / total").alias("s"))
    rests = totals.groupBy("k", "h").agg(by_lang("d * types / total").alias("r"))
    return stored(shares, "shares"), stored(rests, "rests")


def gram_costs(grams: DataFrame, model: Model) -> DataFrame:
    """gram and its natural-log cost in each language, by joins with the large tables."""
    first, names, alphabet = model.orders[0], model.langs, model.alphabet
    ks = range(2, ORDER + 1)
    wide = grams.select("gram", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    g = F.col("gram")
    for k in range(2, ORDER):
        g = F.when(F.col("k") == k, F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))).otherwise(g)
    wide = wide.withColumn("g", g).withColumn("h", F.shiftrightunsigned("g", 16))
    joined = wide.join(model.large[0], ["k", "g"], "left").join(model.large[1], ["k", "h"], "left")
    joined = joined.groupBy("gram").agg(*[
        F.first(F.when(F.col("k") == k, F.col(c)), ignorenulls=True).alias(f"{c}{k}") for k in ks for c in "sr"])

    def dense(maps: list, absent: float) -> np.ndarray:
        found = [dict(m or ()) for m in maps]
        return np.array([[m.get(n, absent) for n in names] for m in found])

    def run(cols: dict[str, list]) -> dict[str, list]:
        gram = np.array(cols["gram"], np.int64).view(np.uint64)
        if not len(gram):
            return {"gram": [], "cost": []}
        p = looked_up(first.grams, first.share, hashed(gram, 1), 0.0)
        p = p + looked_up(first.contexts, first.rest, context(gram, 1), 1.0) / alphabet
        for k in ks:
            p = dense(cols[f"s{k}"], 0.0) + dense(cols[f"r{k}"], 1.0) * p
        return {"gram": cols["gram"], "cost": (-np.log(p)).tolist()}

    return map_rows(joined, run, "gram bigint, cost array<double>")


def joined_entropies(rows: DataFrame, model: Model) -> DataFrame:
    """The rows without their text, with ``entropy`` per language and ``length`` (see ``Model.entropies``)."""
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    beyond = model.beyond

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"_row": [], "gram": [], "n": []}
        for row, text in zip(cols["_row"], cols["text"]):
            if words := letters(text):
                grams, n = np.unique(packed(words, beyond), return_counts=True)
                out["_row"].extend([row] * len(grams))
                out["gram"].extend(grams.view(np.int64).tolist())
                out["n"].extend(n.tolist())
        return out

    grams = stored(map_rows(rows.select("_row", "text"), run, "_row bigint, gram bigint, n bigint"), "text_grams")
    costs = stored(gram_costs(grams.select("gram").distinct(), model), "gram_costs")
    total = [F.sum(F.col("n") * F.col("cost")[i]).alias(f"_c{i}") for i in range(len(model.langs))]
    sums = grams.join(costs, "gram").groupBy("_row").agg(F.sum("n").alias("length"), *total)
    entropy = F.array(*[F.coalesce(F.col(f"_c{i}") / F.col("length"), F.lit(0.0)) for i in range(len(model.langs))])
    out = rows.drop("text").join(sums, "_row", "left").withColumn("entropy", entropy)
    return out.withColumn("length", F.coalesce("length", F.lit(0))).drop("_row", *[f"_c{i}" for i in range(len(model.langs))])


def as_arrays(cols: dict[str, list], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(cols["entropy"], float).reshape(-1, len(langs)), np.array(cols["length"], np.int64)


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang (NULL where the rows have none), best language, its lead and the text's length of every row."""
    words: dict[str, np.ndarray] = {}  # lives as long as a task
    local = replace(model, large=None)

    def run(cols: dict[str, list]) -> dict[str, list]:
        n = len(cols["doc_id"])
        same = {"doc_id": cols["doc_id"], "lang": cols["lang"]}
        if not local.langs:
            return same | {"best": [None] * n, "lead": [0.0] * n, "length": [0] * n}
        entropy, length = as_arrays(cols, local.langs) if "entropy" in cols else local.entropies(cols["text"], words)
        return same | {"best": [local.langs[b] for b in entropy.argmin(axis=1)], "lead": local.lead(entropy, length), "length": length}

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", lang)
    return map_rows(joined_entropies(rows, model) if model.large else rows, run,
                    "doc_id bigint, lang string, best string, lead double, length bigint")


def calibrate(model: Model, rows: DataFrame) -> None:
    """Fit the confidence to all the rows (``measured``); what comes back is one row per cell of the lead."""
    if len(model.langs) < 2:
        model.offset = 5.0
        return
    # The lower edge stands for its cell; a lead of 0 is a cell of its own.
    cell = F.when(F.col("lead") > 0, F.floor(F.log("lead") * LEAD_CELLS))
    cells = rows.filter("length > 0").groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("best") == F.col("lang")).alias("ok")).toPandas()
    cells["lead"] = np.where(cells["cell"].isna(), 0.0, np.exp(cells["cell"].fillna(0.0).to_numpy(float) / LEAD_CELLS))
    cells = cells.sort_values("lead")
    fit_confidence(model, cells["lead"].to_numpy(), cells["ok"].to_numpy(float), cells["n"].to_numpy(float))


def fit_confidence(model: Model, lead: np.ndarray, right: np.ndarray, n: np.ndarray, wanted: float = TRUSTED) -> None:
    """Slope, offset and limit from ascending leads, each with its number of answers and of right ones."""
    if not len(lead):
        return
    scale = max(float(lead[np.searchsorted(np.cumsum(n), n.sum() / 2)]), 1e-6)
    # A made-up wrong answer without lead and a right one with the median lead keep the slope finite.
    z, y, weight = np.append(lead / scale, [0.0, 1.0]), np.append(right, [0.0, 1.0]), np.append(n, [1.0, 1.0])
    a, b = 1.0, 0.0
    for _ in range(500):
        off = weight / (1 + np.exp(-np.clip(a * z + b, -50, 50))) - y
        a, b = a - 0.5 * ((off * z).sum() / weight.sum() + 1e-3 * a), b - 0.5 * off.sum() / weight.sum()
    model.slope, model.offset = a / scale, b
    share = np.cumsum(right[::-1]) / np.cumsum(n[::-1])
    good = np.flatnonzero(share >= wanted)
    model.limit = confidence(model, float(lead[::-1][good[-1]])) if len(good) else 1.0


def confidence(model: Model, lead: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.slope * lead + model.offset, -50, 50))))


def answered(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of ``measured`` rows."""
    some = (F.col("length") > 0) & F.col("best").isNotNull()
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(model.slope) * F.col("lead") + F.lit(model.offset)))
    score = F.when(some, 1 / (1 + F.exp(-z))).otherwise(0.0)
    pred = F.when(some, F.col("best")).otherwise(UNKNOWN)
    return rows.select("doc_id", pred.alias("lang_pred"), score.alias("score"), (~some | (score < model.limit)).alias("rejected"))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    return answered(measured(docs.select("doc_id", "text"), model), model)
