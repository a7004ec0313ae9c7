"""The stages of the corpus pipeline on edge rows, and the figures they promise."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import MEDIUM, SMALL

import corpus_pipeline
from freshet.llm import langid, minhash

# Result names of every operator, and working names, as input columns.
NAMES = ["toxic_score", "n_lines", "n_dropped", "n_words", "n_hit", "items", "contaminated", "_input_n_hit", "row", "_r1", "_id", "keeper"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in NAMES)
LINE = "this very line is in many of the documents"
LONG = " ".join(f"w{i % 90_000}x" for i in range(300_000))  # over two megabytes


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{n}!" for n in NAMES]) for i, t in rows], SCHEMA)


BODY = " ".join(f"word{i}" for i in range(80))
NEAR = BODY + " and one more"
ROWS = [
    (1, BODY), (1, BODY), (2, NEAR), (3, None), (3, None), (4, ""), (5, LONG), (6, f"{LINE}\na"), (7, f"{LINE}\nb"), (8, f"{LINE}\nc"),
    (None, BODY), (None, BODY), (None, "no id but a text of its own"), (9, "one id and this text"), (9, "one id and another text"), (9, NEAR), (10, "\n\n"),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_survive_edge_rows(spark, name, stage):
    docs = rows_of(spark, ROWS)
    out = stage(spark, docs, SMALL)
    assert out.schema.names == docs.schema.names
    got = out.collect()
    assert all(r[n] == f"{n}!" for r in got for n in NAMES)
    ids = Counter(r["doc_id"] for r in got)
    if name == "near_dedup":
        # One of equal rows; near copies of document 1 go, also without an id or beside other texts of an id.
        assert ids == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 1, 9: 2, 10: 1}
        assert {r["text"] for r in got if r["doc_id"] == 9} == {"one id and this text", "one id and another text"}
    else:
        assert ids == Counter(i for i, _ in ROWS)
    if name == "line_dedup":
        texts = {r["doc_id"]: r["text"] for r in got}
        assert (texts[6], texts[7], texts[8]) == ("a", "b", f"{LINE}\nc") and texts[3] == ""
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert stage(spark, docs.filter("false"), SMALL).collect() == []


def test_packing_stage_on_edge_rows(spark):
    out = corpus_pipeline.pack(spark, rows_of(spark, ROWS), SMALL).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(i for i, _ in ROWS)
    assert corpus_pipeline.pack(spark, rows_of(spark, []), SMALL).collect() == []


def test_bad_documents_go_and_clean_ones_stay(spark):
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("length(text) > 100").select("text").first()[0]
    out = corpus_pipeline.drop_contaminated(spark, rows_of(spark, [(1, passage), (2, passage), (3, BODY)]), SMALL).collect()
    assert [r["doc_id"] for r in out] == [3] and out[0]["n_hit"] == "n_hit!"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_recall_of_the_stage_against_exact_links_at_eighty_per_cent(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b]
             and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b]))
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, corpus_pipeline.NEAR_COPIES).collect()}
    joined = sum(label[a] == label[b] for a, b in links)
    assert len(links) > 20 and joined / len(links) >= 0.99
    # Nothing is joined that exact links do not join.
    linked = {x for pair in links for x in pair}
    assert all(label[i] == i for i in sets if i not in linked)


# ---- language models against brute force ----------------------------------------------------------------------------

def test_letters_are_letters():
    assert langid.letters("½ ² ① Ⅷ 12_3") == [] and langid.letters("a½b é٣ß 漢字") == ["a", "b", "é", "ß", "漢字"]


def test_texts_without_letters_are_undetermined(spark):
    d = rows_of(spark, [(i, f"some plain words {i}") for i in range(30)] + [(50, "½ ²"), (51, None), (52, "Ⅷ ①")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(d, langid.train(d)).collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0) and got[0][0] == "en"


def test_confidence_is_fitted_to_all_training_documents(spark):
    # Every seventh of the shorter texts bears the wrong name, so the limit depends on which documents are counted.
    n = F.expr("1 + CAST(id * 7919 % 40 AS INT)")
    said = F.when(F.expr("id % 2 = 0"), F.expr("concat_ws(' ', transform(sequence(1, n), i -> element_at(array('the','and','this','with','house'), 1 + CAST(xxhash64(id, i) & 3 AS INT))))"))
    other = F.expr("concat_ws(' ', transform(sequence(1, n), i -> element_at(array('der','und','dies','mit','haus'), 1 + CAST(xxhash64(id, i) & 3 AS INT))))")
    wrong = F.expr("n < 12 AND id % 7 = 3")
    d = spark.range(9000).withColumn("n", n).select(
        F.col("id").alias("doc_id"), F.coalesce(said, other).alias("text"),
        F.when(F.expr("id % 2 = 0") != wrong, "en").otherwise("de").alias("lang"))
    found = langid.trained_and_identified(d)
    apart = {r["doc_id"]: r for r in langid.identified(d, langid.train(d)).collect()}
    outside = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
    rows = found.join(d.select("doc_id", "lang"), "doc_id").filter(outside).collect()
    assert len(rows) > 7000 and all(apart[r["doc_id"]]["rejected"] == r["rejected"] for r in rows)
    right, accepted, best = 0, sum(not r["rejected"] for r in rows), 0
    by_score = sorted(rows, key=lambda r: -r["score"])
    for i, r in enumerate(by_score, 1):
        right += r["lang"] == r["lang_pred"]
        if right >= langid.TRUSTED * i and (i == len(rows) or by_score[i]["score"] < r["score"]):
            best = i
    cell = [r for r in rows if abs(r["score"] - by_score[best - 1]["score"]) < 1e-3]
    assert 0 < best < len(rows) and abs(accepted - best) <= len(cell)


def test_the_fit_counts_every_training_document(spark, monkeypatch):
    d = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'the house and', 'das haus und') AS text", "IF(id % 2 = 0, 'en', 'de') AS lang")
    seen = []
    fit = langid.fit_confidence
    monkeypatch.setattr(langid, "fit_confidence", lambda model, lead, right, n=None: (
        seen.append(len(lead) if n is None else int(n.sum())), fit(model, lead, right, *([] if n is None else [n]))))
    langid.train(d)
    assert seen == [d.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count()] and seen[0] > 4700


def kneser_ney(words, order=4):
    """Interpolated Kneser-Ney by its formula, with dictionaries: p(gram's last character | those before)."""
    grams = Counter()
    for w in words:
        chars = "\0" * (order - 1) + w + " "
        # The blank that opens a word is a character of its own.
        chars = "\0" * (order - 2) + " " + w + " "
        grams.update(chars[i - order + 1 : i + 1] for i in range(order - 1, len(chars)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    alphabet = len(levels[1]) + 1

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / alphabet
        counts = levels[k]
        once, twice = (sum(n == x for n in counts.values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(counts[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p, [g[-1] for g in levels[1]], grams


def test_shares_equal_the_formula_and_add_up_to_one(spark):
    words = "der die das haus hauses hausen \U00020000\U00020001 \U00020000a straße er es".split()
    d = rows_of(spark, [(i, " ".join(words)) for i in (1, 2, 3, 4, 6)])
    trained = d.filter(~F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")).count()
    model = langid.train(d)
    assert trained > 0 and model.beyond.tolist() == [0x20000, 0x20001]
    p, alphabet, grams = kneser_ney(words * trained)
    code = lambda c: int(langid.FREE[model.beyond.tolist().index(ord(c))]) if ord(c) > 0xFFFF else ord(c)
    pack = lambda g: np.uint64(sum(code(c) << 16 * back for back, c in enumerate(reversed(g))))
    contexts = sorted({g[:-1] for g in grams})
    for h in contexts:
        chances = model.chances(np.array([pack(h + c) for c in [*alphabet, chr(langid.UNSEEN)]], np.uint64))[:, 0]
        assert chances.sum() == pytest.approx(1, abs=1e-9)
        assert chances[:-1] == pytest.approx([p(h + c) for c in alphabet], abs=1e-9)
