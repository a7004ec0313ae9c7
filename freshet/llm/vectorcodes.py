"""Product quantisation of vectors with integer arithmetic, its codebooks fitted by dual-tree Lloyd rounds.

A vector's components become integers ``floor(SCALE * x)`` and are cut into ``PARTS`` equal parts; every part position has
a codebook of ``ENTRIES`` entries. Rows are gathered into blocks of at most ``BLOCK`` rows; per part position a block holds
a k-d tree whose nodes keep the bounding box, the count and the integer sum of their parts. Blocks are written once and
read by every round. In a round each task gets the codebooks (a few thousand integers) and builds a tree over each
one's entries. A point node meets the entry nodes level by level: an entry node goes if its least distance to the node's box is
greater than the greatest distance of another entry node. A point node with one entry left is assigned whole, from its cached sum;
leaves that stay uncertain compare exact integer distances, ties to the lower index. All bounds are integers, so
pruning never changes a result. Tasks return sums per entry, which Spark adds up; only the new codebooks
(``PARTS * ENTRIES`` rows of one part) reach the driver.

Work is spread by rows, so equal vectors or a label with a third of the rows put no load on one task.

Defined results: a row whose vector is null, empty, of a length not divisible by ``PARTS``, of another length than the kept row
with the smallest id, or with a null, non-finite or (scaled) component of ``LIMIT`` or more in size is left out; below
``ENTRIES`` kept rows the codebooks are as short; equal ids are ordered by their vectors, null ids come last; repeated
rows are rows of their own; a null label is a label; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import ship, spark_arrow, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK, LEAF, ENTRY_LEAF = 4096, 32, 4
LIMIT = 2**24  # squared distances of up to 8,192 components stay within 64 bits


# ---- trees ----------------------------------------------------------------------------------------------------------

def tree_levels(n: int, leaf: int) -> list[np.ndarray]:
    """Node boundaries per level: halves of halves until no node has more than ``leaf`` points."""
    levels = [np.array([0, n])]
    while n and (levels[-1][1:] - levels[-1][:-1]).max() > leaf:
        b = levels[-1]
        cut = np.empty(2 * len(b) - 1, np.int64)
        cut[::2], cut[1::2] = b, (b[:-1] + b[1:]) // 2
        levels.append(cut)
    return levels


def tree_order(points: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The order of points in which every node of every level is a stretch; nodes are halved on their widest side."""
    order = np.arange(len(points))
    for bounds in levels[:-1]:
        sizes = np.diff(bounds)
        here = points[order]
        low, high = boxes(here, bounds)
        widest = np.argmax(high - low, axis=1)
        node = np.repeat(np.arange(len(sizes)), sizes)
        order = order[np.lexsort((here[np.arange(len(here)), widest[node]], node))]
    return order


def boxes(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(points, bounds[:-1]), np.maximum.reduceat(points, bounds[:-1])


class EntryTree:
    """Boxes per level over one codebook; the last level's nodes are the entries themselves, by index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        levels = tree_levels(len(entries), ENTRY_LEAF)
        self.order = tree_order(entries, levels)
        self.levels = []
        for bounds in levels:
            low, high = boxes(entries[self.order], bounds)
            member = np.zeros((len(bounds) - 1, len(entries)), bool)
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                member[i, self.order[a:b]] = True
            self.levels.append((low, high, member))
        self.levels.append((entries, entries, np.eye(len(entries), dtype=bool)))

    def candidates(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Which entries (nodes x entries) may be nearest to a point of each box, among those still ``alive``."""
        for e_low, e_high, member in self.levels:
            nodes = alive @ member.T
            gap = np.maximum(0, np.maximum(e_low[None] - high[:, None], low[:, None] - e_high[None]))
            span = np.maximum(high[:, None] - e_low[None], e_high[None] - low[:, None])
            least, most = (gap * gap).sum(2), (span * span).sum(2)
            bound = np.where(nodes, most, np.iinfo(np.int64).max).min(1)
            alive = alive & ((nodes & (least <= bound[:, None])) @ member)
        return alive


def assign(points: np.ndarray, levels: list[np.ndarray], tree: EntryTree) -> Iterator[tuple[int, int, np.ndarray | int, int]]:
    """(first, last, entry or entries, level or -1) for stretches of the ordered points, all points once.

    A stretch with one entry is a whole node of ``level``; one with an array of entries was compared point by point.
    """
    k = len(tree.entries)
    nodes, alive = np.array([0]), np.ones((1, k), bool)
    for depth, bounds in enumerate(levels):
        low, high = boxes(points, bounds)
        alive = tree.candidates(low[nodes], high[nodes], alive)
        sure = alive.sum(1) == 1
        for node, entry in zip(nodes[sure], alive[sure].argmax(1)):
            yield int(bounds[node]), int(bounds[node + 1]), int(entry), depth
        nodes, alive = nodes[~sure], alive[~sure]
        if depth + 1 < len(levels):
            nodes, alive = np.repeat(2 * nodes, 2), np.repeat(alive, 2, axis=0)
            nodes[1::2] += 1
    bounds = levels[-1]
    for node, row in zip(nodes, alive):
        a, b = int(bounds[node]), int(bounds[node + 1])
        left = np.flatnonzero(row)
        d = ((points[a:b, None] - tree.entries[left][None]) ** 2).sum(2)
        yield a, b, left[d.argmin(1)], -1


# ---- blocks ---------------------------------------------------------------------------------------------------------

BLOCKS = "ids array<bigint>, labels array<string>, vectors binary, orders binary"


def pack_block(ids: list, labels: list, vectors: np.ndarray) -> dict[str, object]:
    """A block as one row: integer vectors and, per part position, the tree's order of the rows."""
    parts = vectors.reshape(len(ids), PARTS, -1)
    levels = tree_levels(len(ids), LEAF)
    orders = np.stack([tree_order(parts[:, p].astype(np.int64), levels) for p in range(PARTS)])
    return {"ids": ids, "labels": labels, "vectors": vectors.astype("<i4").tobytes(), "orders": orders.astype("<u2").tobytes()}


class Block:
    def __init__(self, row: dict):
        self.ids, self.labels = row["ids"], row["labels"]
        n = len(self.ids)
        self.parts = np.frombuffer(row["vectors"], "<i4").reshape(n, PARTS, -1)
        self.orders = np.frombuffer(row["orders"], "<u2").reshape(PARTS, n)
        self.levels = tree_levels(n, LEAF)

    def part(self, p: int) -> np.ndarray:
        """The ordered points of a part position."""
        return self.parts[self.orders[p], p].astype(np.int64)

    def sums(self, p: int, tree: EntryTree) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the parts assigned to each entry; whole nodes come from cumulated (cached) sums."""
        points = self.part(p)
        cached = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
        counts, sums = np.zeros(len(tree.entries), np.int64), np.zeros(tree.entries.shape, np.int64)
        for a, b, entry, depth in assign(points, self.levels, tree):
            if depth >= 0:
                counts[entry] += b - a
                sums[entry] += cached[b] - cached[a]
            else:
                np.add.at(counts, entry, 1)
                np.add.at(sums, entry, points[a:b])
        return counts, sums

    def codes(self, p: int, tree: EntryTree) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row's part."""
        points = self.part(p)
        found = np.empty(len(points), np.int64)
        for a, b, entry, _ in assign(points, self.levels, tree):
            found[a:b] = entry
        error = ((points - tree.entries[found]) ** 2).sum(1)
        code, far = np.empty_like(found), np.empty_like(error)
        code[self.orders[p]], far[self.orders[p]] = found, error
        return code, far


# ---- Spark ----------------------------------------------------------------------------------------------------------

def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers) of the rows whose vector can be coded."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    # NaN is greater than every number in Spark.
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT / SCALE, F.lit(False)))
    fit = F.coalesce((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & fine, F.lit(False))
    return vectors.filter(fit).select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), scaled.alias("v"))


def blocks(rows: DataFrame) -> DataFrame:
    schema = spark_arrow(BLOCKS)
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part.column("v").flatten().to_numpy(zero_copy_only=False)
                row = pack_block(part.column("vec_id").to_pylist(), part.column("label").to_pylist(), values.reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return rows.mapInArrow(run, BLOCKS)


def first_codebooks(rows: DataFrame) -> list[np.ndarray]:
    """The parts of the rows with the smallest ids, in order: [part] -> entries x positions."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).select(F.size("v")).first()
    size = first[0] if first else PARTS
    least = rows.filter(F.size("v") == size).orderBy(*order).limit(ENTRIES).select("v").collect()
    values = np.array([r["v"] for r in least], np.int64).reshape(len(least), PARTS, size // PARTS)
    return [values[:, p] for p in range(PARTS)]


def improved(held: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: assign every part, then replace each used entry by the floored mean of its parts."""
    schema = "part int, entry int, n bigint, sums array<bigint>"
    arrow = spark_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(b) for b in books if len(b)]
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                for p, tree in enumerate(trees):
                    n, s = block.sums(p, tree)
                    counts[p] += n
                    sums[p] += s
        rows = [{"part": p, "entry": int(e), "n": int(counts[p][e]), "sums": sums[p][e].tolist()}
                for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    partial = held.mapInArrow(run, schema).select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
    total = partial.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [b.copy() for b in books]
    for r in total.collect():  # at most one part's positions for every entry
        out[r["part"]][r["entry"], r["pos"]] = r["s"] // r["n"]
    return out


def coded(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (indexes in part order, two hex digits each), error."""
    schema = "vec_id bigint, label string, code string, error bigint"
    arrow = spark_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(b) for b in books if len(b)]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                found = [block.codes(p, tree) for p, tree in enumerate(trees)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                rows = [block.ids, block.labels, [c.tobytes().hex() for c in codes], sum(e for _, e in found)]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(rows, arrow)], schema=arrow)

    return held.mapInArrow(run, schema)


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of (vec_id, embedding, label) as vec_id, label, code, error, and the final codebooks."""
    rows = integers(vectors)
    books = first_codebooks(rows)
    size = sum(b.shape[1] for b in books)
    held = stored(blocks(rows.filter(F.size("v") == size)), "vector_blocks")
    for _ in range(rounds):
        books = improved(held, books)
    return coded(held, books), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``label_error``: the errors of equal labels added up (nulls together). Codes are written once and read twice;
    both sides of the join have an exchange, so a label with a third of the rows is split at run time."""
    codes = stored(codes, "vector_codes")
    label = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("name"))
    totals = codes.groupBy(label.alias("_label")).agg(F.sum("error").alias("label_error"))
    totals = stored(totals, "label_errors")
    return codes.withColumn("_label", label).join(totals, "_label").drop("_label")
