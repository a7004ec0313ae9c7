"""Repair of broken conversations: weighted CYK parsing of each one's rows into a legal sequence of roles.

**Grammar** (Chomsky normal form). A nonterminal ``X[p,q]`` stands for output that takes a conversation from state p to
state q: ``-`` nothing yet, ``s`` after the system turn, ``u`` after a user turn, ``a`` after an assistant turn. Binary rules are
``X[p,r] -> X[p,q] X[q,r]``. A row is a terminal: kept (cost 0), its role set to user or assistant (3), or deleted (4, the only
way for blank and duplicate rows); an undeleted truncated row costs 3 more. The empty string derives the insertions (3 a turn);
their closure stands on both sides of every terminal, so the binary rules need no empty spans. The start symbols are
``X[-,-]`` (nothing) and ``X[-,a]``: ``(s?(ua)+)?``.

**Cells** hold the least (cost, audit), audit being the edits' initials (Keep, Rerole, Delete, Insert), and are filled
bottom-up by span length. Two audits of one span with one cost never extend each other (they hold one letter a row, and one more insertion
costs more), so least cells combine to least cells. Which role an ``R`` or ``I`` stands for follows from the audit: an odd
number of remaining turns starts with the system turn, then user and assistant take turns.

**Long conversations.** The nonterminals of this grammar are closed under concatenation, so the cell of a span is the same for any
split points. Rows are sorted by conversation and turn over all tasks (range partitions, so one conversation may use many),
cut into blocks of ``BLOCK`` rows that are parsed whole, and blocks become the terminals of the next round
until a conversation is one block. A task holds one block at a time; repeated rows are counted before the sort. Texts stay out of this;
they move once, to meet their audits, and stream through the task.

Defined results: rows are ordered by turn, nulls first, then by hashes of role and text (rows that tie there are equal);
null roles and texts are one space; a null ``conv_id`` is one conversation; repeated rows are duplicates; a role is read by
its first character; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import ship, slices, spark_arrow, stored

KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 3), ("D", 4), ("I", 3)
TRUNCATED_COST = 3
BLOCK = 16
# A conversation of at most this many blocks is finished in one task; longer ones take another round over all tasks.
FINISH = 256

STATES = "-sua"
STEPS = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
BETWEEN = {"-": "-sua", "s": "sua", "u": "ua", "a": "ua"}  # the states that can follow
SYMBOLS = [(p, q) for p in STATES for q in BETWEEN[p]]
RULES = [(p, q, r) for p, q in SYMBOLS for r in BETWEEN[q]]
Cells = dict[tuple[str, str], tuple[int, str]]


# ---- the parser -----------------------------------------------------------------------------------------------------

def combined(left: Cells, right: Cells, into: Cells) -> None:
    """Every binary rule once: the least of ``into`` and of the two spans side by side."""
    for p, q, r in RULES:
        a, b = left.get((p, q)), right.get((q, r))
        if a is None or b is None:
            continue
        cost, now = a[0] + b[0], into.get((p, r))
        if now is None or cost <= now[0]:
            cell = (cost, a[1] + b[1])
            if now is None or cell < now:
                into[p, r] = cell


def insertions() -> Cells:
    """What the empty string derives: the cheapest insertions from state to state."""
    closure: Cells = {(p, p): (0, "") for p in STATES}
    one = {(p, q): (INSERT[1], INSERT[0]) for (p, role), q in STEPS.items() if role in "ua"}
    for _ in STATES:
        step: Cells = dict(closure)
        combined(closure, one, step)
        closure = step
    return closure


INSERTED = insertions()


@lru_cache(maxsize=1024)
def terminal(role: str, blank: bool, duplicate: bool, truncated: bool) -> Cells:
    """The cells of one row, insertions on both sides included."""
    own: Cells = {(p, p): (DELETE[1], DELETE[0]) for p in STATES}
    if not blank and not duplicate:
        extra = TRUNCATED_COST if truncated else 0
        for (p, to), q in STEPS.items():
            ways = [(letter_cost + extra, letter) for letter, letter_cost, fits in (
                (*KEEP, role == to), (*REROLE, to in "ua")) if fits]
            for way in ways:
                own[p, q] = min(own.get((p, q), way), way)
    before: Cells = {}
    combined(INSERTED, own, before)
    closed: Cells = {}
    combined(before, INSERTED, closed)
    return closed


def parsed(terminals: list[Cells]) -> Cells:
    """The cells of the whole sequence: all spans by length, all split points."""
    n = len(terminals)
    spans = {(i, i + 1): cells for i, cells in enumerate(terminals)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cells = {}
            for k in range(i + 1, i + length):
                combined(spans[i, k], spans[k, i + length], cell)
            spans[i, i + length] = cell
    return spans[0, n]


@lru_cache(maxsize=20_000)
def parsed_rows(rows: tuple[tuple[str, bool, bool, bool], ...]) -> Cells:
    """The cells of rows given by role initial and fault; short conversations of the same make are parsed once."""
    return parsed([terminal(*row) for row in rows])


def least(cells: Cells) -> tuple[int, str]:
    return min(c for c in (cells.get(("-", "-")), cells.get(("-", "a"))) if c is not None)


def edits(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role initial it leaves) along an audit."""
    left = len(audit) - audit.count(DELETE[0])
    roles = ("s" if left % 2 else "") + "ua" * (left // 2)
    at = iter(roles)
    for letter in audit:
        yield letter, None if letter == DELETE[0] else next(at)


# ---- rows -----------------------------------------------------------------------------------------------------------

def readable(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (copies) with nulls filled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"), F.lit(1).alias("n"))


def damaged(rows: DataFrame) -> DataFrame:
    """Faults planted by crc32 of ``conv_id:turn`` (nulls: one space), modulo 20: 0 drops the row, 1 empties its text, 2 takes out
    sentence ends, 3 repeats it, 4 makes it the user's."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    return rows.withColumn("_kind", kind).filter("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 3, F.col("n") * 2).otherwise(F.col("n")).alias("n"))


def place() -> list[Column]:
    """The order of a conversation's texts: turn (nulls first), then 128 bits of role and text."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("g1").asc(), F.col("g2").asc()]


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"g1": F.xxhash64("role", "text"), "g2": F.xxhash64(F.lit(7), "text", "role")})


def faults(rows: DataFrame) -> DataFrame:
    """One narrow row per row of the conversations: conv_id, turn, g1, g2, role (initial), and its first fault.

    Equal rows are counted by partial aggregates. A text's first place in its conversation is a partial minimum and joined
    back from a written table, so a conversation with a third of all rows is split at run time.
    """
    last = F.right(F.btrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    narrow = hashed(rows).select(
        "conv_id", "turn", "g1", "g2", F.left("role", F.lit(1)).alias("role"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"), "n")
    groups = narrow.groupBy("conv_id", "turn", "g1", "g2", "role", "blank", "cut").agg(F.sum("n").alias("n"))
    groups = stored(groups.withColumn("_c", F.coalesce("conv_id", F.lit(0))), "turn_groups")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    known = F.col("conv_id").isNotNull().alias("_k")
    first = stored(groups.groupBy("_c", known, "g1", "g2").agg(F.min(at).alias("_first")), "first_turns")
    joined = groups.withColumn("_k", F.col("conv_id").isNotNull()).join(first, ["_c", "_k", "g1", "g2"])
    again = (F.col("_copy") > 1) | ~at.eqNullSafe(F.col("_first"))
    each = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return each.select(
        "conv_id", "turn", "g1", "g2", F.col("_copy").alias("copy"), "role", "blank", (~F.col("blank") & again).alias("duplicate"),
        (~F.col("blank") & ~again & F.col("cut")).alias("truncated"))


# ---- parsing in rounds ----------------------------------------------------------------------------------------------

# A stretch of a conversation: its place (that of its first row), what adds up, its ends, and its cells.
STRETCH = (
    "conv_id bigint, turn bigint, g1 bigint, g2 bigint, copy bigint, distinct_turns bigint, first_turn bigint, last_turn bigint, blank bigint,"
    " duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, costs array<bigint>, audits array<string>"
)
LEGAL = {"su", "ua", "au"}
SUMS = ("distinct_turns", "blank", "duplicate", "truncated", "illegal")


def row_stretch(row: dict) -> dict:
    known = row["turn"] is not None
    return {k: row[k] for k in ("conv_id", "turn", "g1", "g2", "copy")} | {
        "distinct_turns": int(known), "first_turn": row["turn"], "last_turn": row["turn"],
        "blank": int(row["blank"]), "duplicate": int(row["duplicate"]), "truncated": int(row["truncated"]), "illegal": 0,
        "first_role": row["role"], "last_role": row["role"],
        "row": (row["role"], row["blank"], row["duplicate"], row["truncated"]),
    }


def cells_of(row: dict) -> dict:
    cells = {s: (c, a) for s, c, a in zip(SYMBOLS, row["costs"], row["audits"]) if c is not None}
    return row | {"cells": cells}


def joined_stretch(parts: list[dict]) -> dict:
    """Adjacent stretches as one."""
    out = dict(parts[0])
    for x in parts[1:]:
        for name in SUMS:
            out[name] += x[name]
        out["distinct_turns"] -= out["last_turn"] is not None and out["last_turn"] == x["first_turn"]
        out["illegal"] += out["last_role"] + x["first_role"] not in LEGAL
        out["first_turn"] = x["first_turn"] if out["first_turn"] is None else out["first_turn"]
        out["last_turn"] = out["last_turn"] if x["last_turn"] is None else x["last_turn"]
        out["last_role"] = x["last_role"]
    rows = "row" in parts[0]
    return out | {"cells": parsed_rows(tuple(x["row"] for x in parts)) if rows else parsed([x["cells"] for x in parts])}


def written(stretch: dict) -> dict:
    cells = [stretch["cells"].get(s) for s in SYMBOLS]
    rest = {k: v for k, v in stretch.items() if k not in ("row", "cells", "costs", "audits")}
    return rest | {"costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells]}


def stretched(sorted_rows: DataFrame, whole: bool, rows: bool) -> DataFrame:
    """Adjacent rows (or stretches) of a conversation joined, ``BLOCK`` at a time; ``whole``: until one is left."""
    schema = spark_arrow(STRETCH)
    read = row_stretch if rows else cells_of
    ship(sorted_rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        # Stretches that wait for more, per round; a full round's become one of the next (whole) or go out.
        waiting: list[list[dict]] = [[]]

        def push(stretch: dict, level: int = 0) -> None:
            waiting[level].append(stretch)
            if len(waiting[level]) == BLOCK:
                done, waiting[level] = joined_stretch(waiting[level]), []
                if not whole:
                    out.append(written(done))
                    return
                if level + 1 == len(waiting):
                    waiting.append([])
                push(done, level + 1)

        def close() -> None:
            last: list[dict] = []
            for level in waiting:  # what waits below comes after what waits above
                last = [joined_stretch(level + last)] if level or last else []
            out.extend(map(written, last))
            waiting[:] = [[]]

        now, begun = None, False
        for batch in batches:
            for row in batch.to_pylist():
                if begun and row["conv_id"] != now:
                    close()
                now, begun = row["conv_id"], True
                push(read(row))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return sorted_rows.mapInArrow(run, STRETCH)


def verdicts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows."""
    spark = rows.sparkSession
    order = [*place(), "copy"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spread(df: DataFrame) -> DataFrame:
        return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    found = stored(stretched(spread(stored(faults(rows), "turn_faults")), whole=False, rows=True), "stretches")
    before = None
    while True:
        counts = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        if most <= FINISH or before is not None and most > before // 2:
            break
        before = most
        found = stored(stretched(spread(found), whole=False, rows=False), "stretches")
    if most > 1:
        gathered = found.repartition(tasks, "conv_id").sortWithinPartitions(*order)
        found = stored(stretched(gathered, whole=True, rows=False), "stretches")
    start, end = (F.array_position(F.array(*[F.lit(p + q) for p, q in SYMBOLS]), x).cast("int") - 1 for x in ("--", "-a"))
    cell = lambda i: F.struct(F.get("costs", i).alias("cost"), F.get("audits", i).alias("audit"))
    best = F.least(cell(start), cell(end))
    span = F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns")
    return found.withColumn("_best", best).select(
        "conv_id", F.coalesce(span, F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "_best.cost", "_best.audit")


# ---- applying the edits ---------------------------------------------------------------------------------------------

REPAIRED = "conv_id bigint, position bigint, edit string, role string, text string"
ROLES = {"u": "user", "a": "assistant"}


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text of the repaired turns, in order.

    Rows meet their conversation's audit in one task and stream through it; nothing but the audit is held. The rows of a conversation
    come one after another.
    """
    schema = spark_arrow(REPAIRED)
    ship(rows.sparkSession)
    texts = hashed(rows).select("conv_id", "turn", "g1", "g2", "role", "text", "n", F.lit(1).alias("kind"), F.lit("").alias("audit"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("g1", "bigint"), ("g2", "bigint"), ("role", "string"), ("text", "string"), ("n", "bigint"))]
    heads = found.select("conv_id", *nothing, F.lit(0).alias("kind"), "audit")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = heads.unionByName(texts).repartition(tasks, "conv_id")
    ordered = together.sortWithinPartitions(place()[0], "kind", *place()[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: Iterator = iter(())
        conv, position, out, size = None, 0, [], 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal position, size
            out.append({"conv_id": conv, "position": position, "edit": edit, "role": role, "text": text})
            position, size = position + 1, size + len(text) + 64

        def insert_until_row() -> tuple[str, str | None] | None:
            for edit, role in todo:
                if edit != INSERT[0]:
                    return edit, role
                put(edit, ROLES[role], "")
            return None

        for part in (part for batch in batches for part in slices(batch)):
            for row in part.to_pylist():
                if row["kind"] == 0:
                    insert_until_row()
                    todo, conv, position = edits(row["audit"]), row["conv_id"], 0
                    continue
                for _ in range(row["n"]):
                    edit, role = insert_until_row()
                    if edit != DELETE[0]:
                        put(edit, row["role"] if edit == KEEP[0] else ROLES[role], row["text"])
                if size >= 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        insert_until_row()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(run, REPAIRED)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` lines; reads ``repaired`` as it streams, without another exchange."""
    import hashlib

    schema = "conv_id bigint, repaired_sha256 string"
    arrow = spark_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["position"] == 0:
                    if digest:
                        out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest = row["conv_id"], hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{row['role']}:{row['text']}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if digest:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema=arrow)

    return turns.mapInArrow(run, schema)
