"""Chat formatting, vector codes and conversation repair: brute force, round trips, edge rows."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from freshet.llm import chatformat, queries, turnrepair, vectorcodes

# Extra columns with the names of working columns and of results.
CONV = "conv_id bigint, turn bigint, role string, text string, turns string, formatted string, n bigint, audit string, copy string, g1 string"
TRAPS = ["</s>", "[\\INST]", "[\\\\/INST] [INST", "INST]", "<", "s>", "[TURN]", "[ROLE]x[NAME]", "\\", "[/SYS]\\", "", "é\U0001f600\n[/ROLE]"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 5, "z", "c", "g") for r in rows], CONV)


EDGE = [
    (1, 0, "user", None), (1, None, None, "null turn"), (1, 0, "user", None), (2, 3, "assistant", "a"), (2, 1, "assistant", "b"), (2, 2, "tool[NAME]", "x"),
    (None, 1, "user", "no id."), (None, 2, "assistant", "none"), (3, 1, "", ""), (4, 1, "user", "w " * 300_000 + "[INST]"),
    *[(5, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(TRAPS)],
]


def expected_turns(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


# ---- chat formatting ------------------------------------------------------------------------------------------------

def test_chat_round_trip_over_control_strings_and_edge_rows(spark):
    done = chatformat.formatted(conversations(spark, EDGE)).cache()
    back = {r["conv_id"]: r for r in chatformat.read_back(done).collect()}
    want = expected_turns(EDGE)
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == turns
        assert "".join(back[c]["trained"]) == "".join(x for r, x in turns if r == "assistant")
        assert back[c]["n_blocks"] == len(list(itertools.groupby(turns, lambda t: t[0])))
    control = re.compile(r"\[/?(?:SYS|INST|ROLE)\]|\[NAME\]|\[TURN\]|</?s>")
    for r in done.collect():
        # The mask walked over the formatted text; the marks there are exactly the template's.
        at, taken = 0, []
        for m in r["loss_mask"]:
            at += m["skip"]
            taken.append(r["formatted"][at : at + m["take"]])
            at += m["take"]
        turns = want[r["conv_id"]]
        plain = [re.sub(r"([<\[])\\(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|NAME\]|TURN\])", r"\1\2\3", t) for t in taken]
        assert [p for p, (role, _) in zip(plain, turns) if role == "assistant"] == [x for role, x in turns if role == "assistant"]
        assert all(not t for t, (role, _) in zip(taken, turns) if role != "assistant")
        blocks = [k for k, _ in itertools.groupby(turns, lambda t: t[0])]
        others = sum(k not in chatformat.MARKS for k in blocks)
        assert len(control.findall(r["formatted"])) == 2 * len(blocks) + others + len(turns) - len(blocks)


def test_chat_format_of_an_empty_table_and_plan_without_python(spark):
    assert chatformat.formatted(conversations(spark, [])).collect() == []
    plan = queries.op11_chat_format(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# ---- vector codes ---------------------------------------------------------------------------------------------------

VEC = "vec_id bigint, embedding array<float>, label int, code string, error string, v string"


def brute_codes(rows, parts=16, k=64, rounds=2):
    """Codes by full search in Python integers."""
    kept = sorted((i, [int(np.floor(256.0 * float(np.float32(x)))) for x in e]) for i, e in rows)
    width = len(kept[0][1]) // parts
    cut = [(i, [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]) for i, v in kept]
    books = [[v[p] for _, v in cut[:k]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v in cut:
                held[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(held[j]) for c in zip(*held[j])) if j in held else e for j, e in enumerate(books[p])]
    out = {}
    for i, v in cut:
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.setdefault(i, []).append(("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("case", ["normal", "ties", "copies", "few"])
def test_codes_equal_full_search(spark, monkeypatch, case):
    monkeypatch.setattr(vectorcodes, "BLOCK", 150)
    monkeypatch.setattr(vectorcodes, "LEAF", 8)
    rng = np.random.default_rng(3)
    n, dim = (30, 32) if case == "few" else (700, 32)
    data = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
    if case == "ties":  # a coarse grid: many equal distances, equal entries and equal parts
        data = (np.round(data * 2) / 2).astype(np.float32)
    if case == "copies":
        data[50:550] = data[50]
    rows = [(int(i), data[i].tolist(), int(i % 3) if i % 5 else None, "c", "e", "v") for i in range(n)]
    codes, books = vectorcodes.compressed(spark.createDataFrame(rows, VEC).repartition(3))
    want, want_books = brute_codes([(r[0], r[1]) for r in rows])
    assert [[tuple(e) for e in b.tolist()] for b in books] == want_books
    got = vectorcodes.with_label_errors(codes).collect()
    assert {r["vec_id"]: [(r["code"], r["error"])] for r in got} == want
    sums = defaultdict(int)
    for r in got:
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got) and (None in sums)


def test_codes_of_edge_rows(spark):
    fine = [float(i) / 8 for i in range(16)]
    bad = [None, [], [0.5] * 15, [None] + fine[1:], [float("nan")] + fine[1:], [float("inf")] + fine[1:], [1e30] + fine[1:], [0.5] * 32]
    rows = [(1, fine, 1, "", "", ""), (1, fine, 1, "", "", ""), (None, fine, None, "", "", ""), *[(9 + i, b, 1, "", "", "") for i, b in enumerate(bad)]]
    codes, books = vectorcodes.compressed(spark.createDataFrame(rows, VEC))
    got = vectorcodes.with_label_errors(codes).collect()
    assert sorted((r["vec_id"] is None, r["code"], r["error"], r["label_error"]) for r in got) == [(False, "00" * 16, 0, 0)] * 2 + [(True, "00" * 16, 0, 0)]
    assert len(books) == 16 and books[0].shape == (3, 1)
    codes, books = vectorcodes.compressed(spark.createDataFrame([], VEC))
    assert vectorcodes.with_label_errors(codes).collect() == []


def test_pruning_assigns_whole_nodes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (64, 4))
    points = (centres[rng.integers(0, 64, 4000)] + rng.integers(-3, 4, (4000, 4))).astype(np.int64)
    levels = vectorcodes.tree_levels(len(points), vectorcodes.LEAF)
    ordered = points[vectorcodes.tree_order(points, levels)]
    found = list(vectorcodes.assign(ordered, levels, vectorcodes.EntryTree(centres)))
    whole = sum(b - a for a, b, _, depth in found if depth >= 0)
    assert sum(b - a for a, b, *_ in found) == 4000 and whole > 2000


# ---- conversation repair --------------------------------------------------------------------------------------------

def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        tail = text.strip(" \t\n\x0b\f\r")[-1:]
        blank = tail == ""
        dup = not blank and (role, text) in seen
        out.append((role[:1], blank, dup, not blank and not dup and tail not in ".!?"))
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Cheapest (cost, audit) by search over all audits: rows in order, any insertions between."""
    found = faults_of(rows)
    best = None
    todo = [(0, "", "", 0)]  # cost, audit, roles, rows used
    while todo:
        cost, audit, roles, i = todo.pop()
        if best is not None and (cost > best[0]):
            continue
        if not re.fullmatch("s?(?:ua)*u?", roles):
            continue
        if i == len(found) and re.fullmatch("(?:s?(?:ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if audit.count("I") < 2 * len(found) + 2 and cost < 4 * len(found) + 1:
            todo += [(cost + 3, audit + "I", roles + r, i) for r in "ua"]
        if i < len(found):
            role, blank, dup, cut = found[i]
            todo.append((cost + 4, audit + "D", roles, i + 1))
            if not blank and not dup:
                extra = 3 * cut
                if role in ("s", "u", "a"):
                    todo.append((cost + extra, audit + "K", roles + role, i + 1))
                todo += [(cost + 3 + extra, audit + "R", roles + r, i + 1) for r in "ua"]
    return best or (0, "")


def applied(rows, audit):
    left = len(audit) - audit.count("D")
    names = iter((["system"] if left % 2 else []) + ["user", "assistant"] * (left // 2))
    at, out = iter(rows), []
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter != "D":
            name = next(names)
            out.append(f"{role if letter == 'K' else name}:{text}")
    return "\n".join(out)


def checked(spark, rows):
    d = turnrepair.readable(conversations(spark, rows))
    found = turnrepair.verdicts(d)
    texts = {r["conv_id"]: r["repaired_sha256"] for r in turnrepair.digests(turnrepair.repaired(d, found)).collect()}
    return {r["conv_id"]: r for r in found.collect()}, texts


def ordered_rows(rows):
    """Rows by conversation in the operator's order; test rows that share a turn are equal."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def test_repair_equals_search_over_all_audits(spark):
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", None, "Unknown"], ["One.", "Two", "Three!", "", " \n", None, "Four?  "]
    rows = []
    for c in range(150):
        for t in range(int(rng.integers(1, 6))):
            row = (c, t if rng.random() > 0.1 else None, roles[rng.integers(0, 6)], texts[rng.integers(0, 7)])
            rows += [row] * (2 if rng.random() < 0.15 and row[1] is not None else 1)
    seen_null = set()
    rows = [r for r in rows if r[1] is not None or not (r[0] in seen_null or seen_null.add(r[0]))]
    found, digests = checked(spark, rows)
    for c, own in ordered_rows(rows).items():
        cost, audit = brute_repair(own)
        r = found[c]
        assert (r["cost"], r["audit"]) == (cost, audit), (own, r)
        faults = faults_of(own)
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(sum(f[i] for f in faults) for i in (1, 2, 3))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(own, own[1:])]
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        turns = [t for cc, t, *_ in rows if cc == c and t is not None]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        text = applied(own, audit)
        assert digests.get(c) == (hashlib.sha256(text.encode()).hexdigest() if len(audit) > audit.count("D") else None)


def dynamic(own):
    """(cost, audit) row by row over states: another algorithm than the parser's."""
    far = (10**9, "")
    state = {"-": (0, ""), "s": far, "u": (3, "I"), "a": (6, "II")}
    add = lambda s, k, x: (s[0] + k, s[1] + x)
    for role, blank, dup, cut in faults_of(own):
        new = {q: add(state[q], 4, "D") for q in state}
        for p, q, r in (("-", "s", "s"), ("-", "u", "u"), ("s", "u", "u"), ("a", "u", "u"), ("u", "a", "a")):
            if not blank and not dup:
                if role == r:
                    new[q] = min(new[q], add(state[p], 3 * cut, "K"))
                if r != "s":
                    new[q] = min(new[q], add(state[p], 3 + 3 * cut, "R"))
        new["u"] = min(new["u"], *(add(new[p], 3, "I") for p in "-sa"))
        new["a"] = min(new["a"], add(new["u"], 3, "I"))
        state = new
    return min(state["-"], state["a"])


def test_long_conversations_take_several_rounds_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(turnrepair, "FINISH", 4)
    monkeypatch.setattr(turnrepair, "BLOCK", 4)
    rng = np.random.default_rng(8)
    names = ["user", "assistant", "system", "tool"]
    rows = [(7, t, names[rng.choice(4, p=[0.45, 0.45, 0.05, 0.05])], f"text {t}" + ("." if rng.random() > 0.2 else "")) for t in range(1500)]
    rows += [(8, t, "user", "same.") for t in range(400)] + [(9, 1, "user", "Copied.")] * 90 + [(None, 0, "user", "Hello.")]
    found, digests = checked(spark, rows)
    for c, own in ordered_rows(rows).items():
        assert (found[c]["cost"], found[c]["audit"]) == dynamic(own)
        assert digests[c] == hashlib.sha256(applied(own, found[c]["audit"]).encode()).hexdigest()
    assert found[8]["duplicate"] == 399 and found[9]["duplicate"] == 89 and found[9]["gaps"] == 0


def test_repair_of_edge_rows_and_empty_tables(spark):
    found, digests = checked(spark, [r for r in EDGE if r[0] != 2])
    assert set(found) == {1, None, 3, 4, 5} and found[3]["audit"] == "D" and found[3]["cost"] == 4 and 3 not in digests
    assert checked(spark, []) == ({}, {})


def test_planted_damage(spark):
    rows = [(c, t, "assistant", f"It is {t}. Yes!") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    got = turnrepair.damaged(turnrepair.readable(conversations(spark, rows))).collect()
    out = {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["n"]) for r in got}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: None, 1: (role, "", 1), 2: (role, re.sub("[.!?]", "", text), 1), 3: (role, text, 2), 4: ("user", text, 1)}.get(kind, (role, text, 1))
        assert out.get((c, t)) == want


def test_conversations_without_rows_after_damage_are_reported(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_conversation_queries_have_one_row_a_conversation(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet")
    ids = {r[0] for r in rows.select("conv_id").distinct().collect()}
    for query, extra in ((queries.op11_chat_format, {-1}), (queries.op13_conversation_repair, set())):
        got = query(spark, SMALL).groupBy("conv_id").agg(F.count("*").alias("n")).collect()
        assert {r["conv_id"] for r in got} == ids | extra and all(r["n"] == 1 for r in got)
