"""Secret scans beyond the patterns, and the host verdicts against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import MEDIUM, SMALL

from freshet.llm import hostrules, queries, secretscan

KEY = "x9Kq27LmZ4tR8vB1nW6yPd03"
NEW = ["auth header value Bearer {}", "my credential is {}", "client_secret_value {}", "please use the key {} today"]
CLEAN = [
    "see https://example.org/a/b/123456 today", "mail bob.smith42@example.com or call 555-123-4567",
    "on 2024-01-02T03:04:05 order 12345678 was sent", "a perfectly ordinary line about version 12.4.1 of the programme",
    "die Donaudampfschifffahrtsgesellschaftskapitaen fuhr", "passage monkey author keyboard tokens", "",
]


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    # Secrets are few in the small table: some assignments of random values are mixed in.
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = [(10_000_000 + i, f"some words before\n{n} {s} \"{''.join(rng.choices(letters, k=rng.randint(16, 40)))}\" and after it\nmore words")
            for i in range(150) for n, s in [(rng.choice(["password", "api_key", "Token", "secret"]), rng.choice(["=", ":"]))]]
    return secretscan.train(docs.unionByName(spark.createDataFrame(made, "doc_id bigint, text string")))


def found(field, texts):
    spans = secretscan.Scanner(field).extra(texts, [[] for _ in texts])
    return [[t[a:z] for a, _, z in s] for t, s in zip(texts, spans)]


def test_new_spellings_are_found_and_clean_lines_left_alone(field):
    assert found(field, [t.format(KEY) for t in NEW]) == [[KEY]] * len(NEW)
    assert found(field, CLEAN) == [[] for _ in CLEAN]


def test_a_line_is_tagged_alike_whatever_else_the_text_says(field):
    line = NEW[0].format(KEY)
    for other in ("passage monkey author", "plain words", "é ß"):
        assert found(field, [f"{line}\n{other}"]) == [[KEY]]
    assert found(field, [f"some words\n{CLEAN[0]}\npassword token key"])[0] == []


def test_the_field_adds_spans_to_the_result(spark, field):
    d = spark.createDataFrame([(i, t.format(KEY)) for i, t in enumerate(NEW + CLEAN)] + [(90, f"token = {KEY}"), (91, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in secretscan.scanned(d, field).collect()}
    assert all(got[i]["spans"].startswith("crf:") and got[i]["base"] == "" for i in range(len(NEW)))
    assert all(got[len(NEW) + i]["spans"] == "" for i in range(len(CLEAN)))
    assert got[90]["spans"] == got[90]["base"] != "" and got[91]["spans"] == ""


def test_false_spans_on_the_sample_texts(spark, field):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    extra = [s for r in secretscan.scanned(docs, field).collect() for s in r["spans"].split(",") if s.startswith("crf")]
    assert len(extra) <= 2


def test_skipped_lines_hold_no_secret(field):
    rng = random.Random(7)
    words = ["the", "Token", "=", KEY, "12345678", "abc.DEF", '"q1w2e3r4t5y6u7i8"', "plain,", "https://x.y/1", "AKIA"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(20)) for _ in range(20)]
    some = found(field, texts)
    everything = secretscan.Scanner(field)
    everything.hopeful = lambda ids, starts, sizes, files: np.ones(len(sizes), bool)
    spans = everything.extra(texts, [[] for _ in texts])
    assert some == [[t[a:z] for a, _, z in s] for t, s in zip(texts, spans)] and any(some)


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(1)
    b, _ = secretscan.batch_of([[0] * 3, [0] * 2], [[0.0] * 6] * 2)
    e, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))

    def log_z(e, moves):
        total = 0.0
        for start, n in ((0, 3), (3, 2)):
            alpha = e[start]
            for t in range(1, n):
                alpha = np.logaddexp.reduce(alpha[:, None] + moves, axis=0) + e[start + t]
            total += np.logaddexp.reduce(alpha)
        return total

    posterior, expected = secretscan.likelihood(e, moves, b)
    h = 1e-6
    for i in range(5):
        for s in range(3):
            up, down = e.copy(), e.copy()
            up[i, s] += h
            down[i, s] -= h
            assert posterior[i, s] == pytest.approx((log_z(up, moves) - log_z(down, moves)) / (2 * h), abs=1e-5)
    for a in range(3):
        for z in range(3):
            up, down = moves.copy(), moves.copy()
            up[a, z] += h
            down[a, z] -= h
            assert expected[a, z] == pytest.approx((log_z(e, up) - log_z(e, down)) / (2 * h), abs=1e-5)


def test_bare_windows_leave_the_name_out():
    text = f'first line\nhere is password = "{KEY}" you see\nold card number 1234 5678 and 99887766554433\n'
    kinds = defaultdict(list)
    for kind, words, states in secretscan.windows_of(text):
        kinds[kind].append(([w.decode() for w in words], states))
    assert kinds["marked"] == [(["here", "is", "password", "=", f'"{KEY}"', "you", "see"], [0, 0, 0, 0, 1, 0, 0])]
    assert kinds["bare"] == [(["here", "is", f'{KEY}"', "you", "see"], [0, 0, 1, 0, 0])]
    assert len(kinds["odd"]) == 1 and len(kinds["plain"]) == 1


# ---- host verdicts --------------------------------------------------------------------------------------------------

def brute_verdicts(rows):
    """kept by doc: rules, host rates, moments, prior, shrunk rates and limits, all in Python."""
    def fails(m):
        words, chars, size = m["n_words"], m["word_chars"], m["word_bytes"]
        return {
            "short": words < 10, "repetitive": 100 * m["n_repeat_words"] > 20 * words, "symbols": 10 * m["n_symbols"] > words,
            "word_length": 2 * size < 5 * chars and (chars > 10 * words or chars < 3 * words),
            "dup_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"] and m["n_dup_lines"] > 2,
        }

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "word_bytes")
    judged = [(i, h or "", fails(dict(zip(names, hostrules.measures(t))))) for i, h, t in rows]
    size = Counter(h for _, h, _ in judged)
    bad = set()
    for rule in judged[0][2]:
        n_bad = Counter(h for _, h, f in judged if f[rule])
        rates = [n_bad[h] / size[h] for h in size]
        mean = sum(rates) / len(rates)
        var = sum((r - mean) ** 2 for r in rates) / len(rates)
        alpha = beta = 1.0
        if 0 < mean < 1 and 0 < var < mean * (1 - mean):
            strength = mean * (1 - mean) / var - 1
            alpha, beta = mean * strength, (1 - mean) * strength
        m = alpha / (alpha + beta)
        limit = min(max(m + 4 * (m * (1 - m) / (alpha + beta + 1)) ** 0.5, 0.2), 0.5)
        bad |= {h for h in size if (n_bad[h] + alpha) / (size[h] + alpha + beta) >= limit}
    return [(i, not any(f.values()) and h not in bad) for i, h, f in judged], bad


def test_host_verdicts_against_brute_force(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rng = random.Random(3)
    rows = []
    for h in range(25):
        share = 0.9 if h in (3, 11) else 0.03
        for k in range(rng.randint(1, 60)):
            bad = rng.random() < share
            text = rng.choice(["x", good + " # $ % & # $ % &", "a b " * 20, "\n".join([good] * 6)]) if bad else good
            rows.append((len(rows), None if h == 24 else f"h{h}", text))
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    want, bad_hosts = brute_verdicts(rows)
    got = hostrules.judged(df, F.col("source")).collect()
    assert {(r["doc_id"], r["kept"]) for r in got} == set(want)
    assert {r["host"] for r in got if r["host_rejected"]} == bad_hosts and bad_hosts


def test_host_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text").collect()
    want, _ = brute_verdicts([tuple(r) for r in docs])
    assert {(r["doc_id"], r["kept"]) for r in queries.op1_quality_rules(spark, SMALL).collect()} == set(want)
