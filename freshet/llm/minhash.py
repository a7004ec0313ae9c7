"""Near-duplicate groups by b-bit MinHash.

1. Every document's distinct word shingles give 128 minima. Groups of ``ROWS`` minima are hashed into band
   keys; the low 2 bits of every minimum are packed into four longs. Shingle sets that are equal
   become one class before anything is compared, so exact copies cost one row.
2. Band candidates: each class is paired with the smallest class of every bucket it falls in (one row per
   member, never all pairs). The packed signatures give a similarity estimate, corrected for the
   quarter of unequal minima whose low bits agree by chance; pairs far below the threshold go.
3. The rest is confirmed on full shingle sets; links give components.
4. Buckets that still hold several components are finished exactly: members are cut into
   blocks and blocks are compared with blocks. A pair of different components goes on if its signatures allow the
   threshold, and if a bound that never errs does too: with shingles counted in ``CELLS`` cells, the sum of the
   smaller counts is at least the intersection. What remains is confirmed in turn. A bucket whose members
   are already joined costs nothing here.

Chances of losing a link at similarity 0.85: no common band (1 - 0.85^5)^25 = 4e-7; estimate more
than ``MARGIN`` too low, 1.3e-6 (binomial, 34 or more unequal of 128). At 0.80, which the pipeline's stage takes:
(1 - 0.80^5)^25 = 5e-5 and 7e-6 (39 or more). Both fall fast above the threshold.

Defined results: a document without words has an empty set and links with nothing. Rows that share a
``doc_id`` are one document. A null ``doc_id`` cannot be named in a link: it stays alone, its component is
null and it is kept. Other columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import gram_hashes, map_rows, mix, ship, signed, stored, utf8, word_hashes
from freshet.llm.graph import components

SHINGLE = 5
SIMILARITY = 85  # per cent
BANDS, ROWS, MINIMA, BITS = 25, 5, 128, 2
CHANCE = 1 / 2**BITS
MARGIN = 0.20
BLOCK, CELLS = 256, 1024
SIG = [f"s{i}" for i in range(MINIMA * BITS // 64)]
LOW = 0x5555555555555555

_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles (fewer words: the whole sequence is one).

    ``bytes.lower`` changes A-Z only, and ``bytes.split`` splits on exactly the six ASCII blanks.
    """
    return np.unique(gram_hashes(word_hashes(utf8(text).lower().split()), size))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the 128 multiplicative hashes."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[start : start + 1024, None] * _FACTORS).min(axis=0), out=least)
    return least


def pack(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima (below the bits that decide the minimum), 32 to a long."""
    low = (least >> np.uint64(20)) & np.uint64(2**BITS - 1)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low.reshape(len(SIG), -1) << shifts, axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        acc = mix(acc) * np.uint64(31) + rows[:, i]
    return mix(acc)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per document: set size, 128-bit digest of the set, band keys, packed signature."""

    def sketch(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_shingles", "d1", "d2", "bands", *SIG)}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            found = shingle_set(text, size)
            digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
            least = minima(found)
            out["doc_id"].append(doc_id)
            out["n_shingles"].append(len(found))
            out["d1"].append(digest[0])
            out["d2"].append(digest[1])
            out["bands"].append(signed(band_keys(least)))
            for name, word in zip(SIG, signed(pack(least))):
                out[name].append(word)
        return out

    packed = ", ".join(f"{s} bigint" for s in SIG)
    schema = f"doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, {packed}"
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), sketch, schema)


def estimate(left: str, right: str) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    unequal = F.lit(0)
    for s in SIG:
        x = F.col(left + s).bitwiseXOR(F.col(right + s))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW))
        unequal = unequal + F.bit_count(either)
    return (1 - unequal / MINIMA - CHANCE) / (1 - CHANCE)


def may_link(similarity: int) -> Column:
    """Set sizes alone allow the threshold, and the estimate is not far below it."""
    sizes = 100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    return sizes & (estimate("a_", "b_") >= similarity / 100 - MARGIN)


def with_sketch(pairs: DataFrame, classes: DataFrame, side: str) -> DataFrame:
    cols = [F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n{side}")]
    return pairs.join(classes.select(*cols, *[F.col(s).alias(f"{side}_{s}") for s in SIG]), side)


def cells(shingles: np.ndarray) -> bytes | None:
    """Shingles per cell (by the top bits of their hash); None where a count does not fit a byte."""
    counts = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def with_cells(members: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``members`` with the cell counts of their sets; each text is read once."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "cells": [cells(shingle_set(t, size)) for t in cols["text"]]}

    wanted = members.select("doc_id").distinct()
    counted = map_rows(texts.join(wanted, "doc_id", "left_semi"), run, "doc_id bigint, cells binary")
    # Rows of one id with several texts have no single count: they are not pruned.
    one = counted.groupBy("doc_id").agg(F.min("cells").alias("cells"), F.max("cells").alias("_other"))
    one = one.select("doc_id", F.when(F.col("cells") == F.col("_other"), F.col("cells")).alias("cells"))
    return members.join(stored(one, "cells"), "doc_id")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: int, size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. ``texts`` holds the documents that share a bucket."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge")
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge")
    # Members are joined with their own text first and written, so both sides of the join on the
    # shared partner have an exchange and a partner with very many members can be split.
    members = stored(pairs.join(a, "a"), "members")

    def check(cols: dict[str, list]) -> dict[str, list]:
        cache: OrderedDict[str, np.ndarray] = OrderedDict()
        out: dict[str, list] = {"a": [], "b": []}
        for ia, ib, ta, tb in zip(cols["a"], cols["b"], cols["ta"], cols["tb"]):
            if tb not in cache:
                cache[tb] = shingle_set(tb, size)
                if len(cache) > 64:
                    cache.popitem(last=False)
            sa, sb = shingle_set(ta, size), cache[tb]
            common = len(np.intersect1d(sa, sb, assume_unique=True))
            if 100 * common >= similarity * (len(sa) + len(sb) - common) and common:
                out["a"].append(ia)
                out["b"].append(ib)
        return out

    return map_rows(members.join(b, "b").select("a", "b", "ta", "tb"), check, "a bigint, b bigint").distinct()


def bucket_members(classes: DataFrame) -> DataFrame:
    return classes.select("doc_id", F.explode("bands").alias("key"))


def block_pairs(members: DataFrame, similarity: int) -> DataFrame:
    """Pairs of different components inside a bucket that may link, found block against block.

    ``members``: key, doc_id, component, n_shingles, packed signature, cells, ``blocks`` (their number in
    the bucket). A block holds about ``BLOCK`` members whatever the size of the bucket.
    """
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("chunk")
    row = F.struct("doc_id", "component", "n_shingles", "cells", *SIG)
    chunks = members.select("key", chunk, row.alias("row")).groupBy("key", "chunk").agg(F.collect_list("row").alias("rows"))
    chunks = stored(chunks, "blocks")
    other = chunks.select("key", F.col("chunk").alias("chunk2"), F.col("rows").alias("rows2"))
    both = chunks.join(other, "key").filter("chunk <= chunk2").select("rows", "rows2")
    floor = (similarity / 100 - MARGIN) * (1 - CHANCE) + CHANCE

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                l, r = (_columns(x.values) for x in (left, right))
                sig_l = np.stack([l[s].view(np.uint64) for s in SIG], axis=1)
                sig_r = np.stack([r[s].view(np.uint64) for s in SIG], axis=1)
                x = sig_l[:, None, :] ^ sig_r[None, :, :]
                equal = 1 - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(LOW)).sum(axis=2) / MINIMA
                na, nb = l["n_shingles"][:, None], r["n_shingles"][None, :]
                keep = (equal >= floor) & (100 * np.minimum(na, nb) >= similarity * np.maximum(na, nb))
                keep &= l["component"][:, None] != r["component"][None, :]
                i, j = np.nonzero(keep)
                possible = np.concatenate([np.zeros(0, bool), *(
                    fits(l, r, i[k : k + 4096], j[k : k + 4096], similarity) for k in range(0, len(i), 4096))])
                i, j = i[possible], j[possible]
                a, b = l["doc_id"][i], r["doc_id"][j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"]
                )

    ship(both.sparkSession)
    return both.mapInArrow(compare, "a bigint, b bigint").distinct()


def fits(l: dict[str, np.ndarray], r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: int) -> np.ndarray:
    """Pairs (i, j) whose cell counts leave room for the threshold; pairs without counts stay."""
    common = np.minimum(l["cells"][i], r["cells"][j]).sum(axis=1, dtype=np.int64)
    union = l["n_shingles"][i] + r["n_shingles"][j] - common
    return (100 * common >= similarity * union) | ~l["counted"][i] | ~r["counted"][j]


def _columns(rows: pa.StructArray) -> dict[str, np.ndarray]:
    out = {f.name: rows.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(rows.type) if f.name != "cells"}
    raw = rows.field("cells").to_pylist()
    out["counted"] = np.array([c is not None for c in raw], bool)
    out["cells"] = np.frombuffer(b"".join(c or bytes(CELLS) for c in raw), np.uint8).reshape(len(raw), CELLS)
    return out


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept, n_links of its class."""
    sketched = stored(sketches(docs, size), "sketches")
    rows = sketched.count()
    named = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    packed = [F.first(c).alias(c) for c in ("n_shingles", "bands", *SIG)]
    classes = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), *packed)
    classes = stored(classes, "classes", rows)
    sketch = classes.drop("bands")

    heads = bucket_members(classes).groupBy("key").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("members"))
    heads = stored(heads.filter("members > 1"), "buckets", BANDS * rows)
    # Members of shared buckets, few of all: found once, by a merge join at every size.
    crowded = stored(bucket_members(classes).hint("merge").join(heads, "key"), "bucket_members", BANDS * rows)
    pairs = crowded.filter("doc_id > b").select(F.col("doc_id").alias("a"), "b").distinct()
    near = with_sketch(with_sketch(pairs, sketch, "a"), sketch, "b").filter(may_link(similarity)).select("a", "b")
    near = stored(near, "near_pairs", BANDS * rows)
    # The texts of all documents that share a bucket with another move once; joins of texts are merges at every
    # size, so what is shuffled grows as the input does.
    shared = crowded.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").hint("merge").join(shared, "doc_id", "left_semi")
    texts = stored(texts, "texts")
    links = stored(confirmed(near, texts, similarity, size), "confirmed", BANDS * rows)
    groups = stored(components(links), "components", rows)

    # A bucket of two was settled by its one pair; others may hold links between members.
    large = crowded.filter("members > 2")
    labelled = large.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"),
        F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
    )
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = stored(mixed.filter("lo < hi").select("key"), "mixed_buckets", BANDS * rows)
    members = with_cells(labelled.join(mixed, "key"), texts, size).join(sketch, "doc_id")
    rest = stored(block_pairs(members, similarity).join(near, ["a", "b"], "left_anti"), "rest_pairs")
    if not rest.isEmpty():
        links = links.unionByName(stored(confirmed(rest, texts, similarity, size), "confirmed_rest"))
        groups = stored(components(links), "components", rows)

    ends = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id")))
    counts = ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"))
    label = (
        classes.select("d1", "d2", "doc_id")
        .join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(counts, "doc_id", "left")
        .select("d1", "d2", F.coalesce("component", "doc_id").alias("component"), "n_links")
    )
    label = stored(label, "class_labels", rows)
    # Rows of one id may have several texts, hence classes; the id takes the smallest label.
    joined = sketched.join(label, ["d1", "d2"], "left")
    return joined.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
