"""Best-fit packing by hierarchical residual rounds.

Documents become token pieces (only those longer than a sequence are cut). Full pieces are sequences at once. The
other pieces are dealt to groups of about ``GROUP`` rows; each group packs longest first into the
bin with the least sufficient room. Nearly full bins are finished; the rest become items of the
next round, where ``FAN_IN`` groups meet, until one group is left. Only (id, length) rows move between rounds.
A group passes on at most ``CARRY`` bins, its emptiest; the others are finished as they are, so every
task has a bound whatever the input and no piece is ever left out.

Token ids come from the tokenizer itself. It encodes each pre-token on its own, so for Latin-1 texts distinct pre-tokens
are encoded once per worker process and then looked up (the cache is bounded); other texts are encoded whole.

Defined results: null text is empty, hence one piece holding only the end id; repeated rows are packed
separately, each on its own; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import map_rows, ship, stored

CAPACITY, END_ID = 4096, 1
GROUP, FAN_IN, CARRY = 40_000, 8, 4_000
SLACK = 16  # a bin with no more room than this is finished
CACHE = 300_000  # some 50 MB, which a worker keeps between tasks
# Split into pre-tokens, a text takes some thirty times its room: a worker encodes about this much at a time.
ENCODE_CHARS = 1_000_000
# Fixed value: the tokenizer file's own pattern, its character classes spelled out for lower-case Latin-1.
PRE_TOKEN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")

_ENCODERS: dict[str, WordEncoder] = {}


class Numbers(dict):
    """Numbers of pre-tokens by first sight; ``new`` lists those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, pre_token: str) -> int:
        number = self[pre_token] = len(self)
        self.new.append(pre_token)
        return number


class WordEncoder:
    """Ids of whole texts from a ``tokenizers`` file whose pre-tokens carry a word end.

    Known pre-tokens are rows of a table: where their ids start in ``flat``, and how many there are. The arrays have
    room to grow, so that new rows are written beside the old ones and no copy of all is made for each slice.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.rows = Numbers()
        self.flat = np.zeros(1024, np.uint32)
        self.starts, self.sizes = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.known = self.used = 0

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def learn(self) -> list[str]:
        """Encode the pre-tokens numbered since. Runs of letters are encoded together: each ends in an end token."""
        new, self.rows.new = self.rows.new, []
        letters = [p for p in new if p.isalpha()]
        of: dict[str, list[int]] = {p: self.whole(p) for p in new if not p.isalpha()}
        for start in range(0, len(letters), 2000):
            part = letters[start : start + 2000]
            found = self.whole(" ".join(part))
            cuts = (np.flatnonzero(self.ends[found]) + 1).tolist()
            assert len(cuts) == len(part)
            of.update(zip(part, (found[a:b] for a, b in zip([0, *cuts], cuts))))
        ids = [of[p] for p in new]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        known, used = self.known + len(ids), self.used + int(sizes.sum())
        self.starts, self.sizes, self.flat = room(self.starts, known), room(self.sizes, known), room(self.flat, used)
        self.starts[self.known : known] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.known : known] = sizes
        self.flat[self.used : used] = np.fromiter(chain.from_iterable(ids), np.uint32, used - self.used)
        self.known, self.used = known, used
        return new

    def forget(self, new: list[str], kept: int) -> None:
        for p in new:
            del self.rows[p]
        self.known, self.used = kept, int(self.sizes[:kept].sum())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [pre_tokens(t) for t in texts]
        every = list(chain.from_iterable(s for s in split if s))
        kept = len(self.rows)
        # One look at every pre-token: an unknown one gets its number there and is encoded afterwards.
        rows = np.fromiter(map(self.rows.__getitem__, every), np.int64, len(every))
        new = self.learn()
        sizes = self.sizes[rows].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *(len(s or ()) for s in split)])]
        if len(self.rows) > CACHE:  # the first ones stay; frequent pre-tokens come early
            self.forget(new, kept)
        return [
            np.array(self.whole(t), np.uint32) if s is None else ids[a:z]
            for t, s, a, z in zip(texts, split, bounds, bounds[1:])
        ]


def room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a copy of twice the length where ``n`` entries do not fit."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def pre_tokens(text: str) -> list[str] | None:
    """The pre-tokens of a Latin-1 text; None for other texts and those that may hold a special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if "<|" in text else PRE_TOKEN.findall(text.lower())


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``uid`` numbers the rows."""

    def cut(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, ids in zip(cols["doc_id"], encoder(tokenizer).encode([t or "" for t in cols["text"]])):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(start)
                out["length"].append(len(part))
                out["ids_crc32"].append(zlib.crc32(part.tobytes()))
        return out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    made = map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), cut, schema, ENCODE_CHARS)
    return made.withColumn("uid", F.monotonically_increasing_id())


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every item: longest first, least sufficient room, else a new bin.

    Rooms are kept by size, and a bit mask says which sizes have a bin.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            rooms[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets


def pack_groups(items: DataFrame, level: int, capacity: int, carry: int, last: bool) -> DataFrame:
    """One round. Items (item, grp, length) get bin, offset, the bin's fill and whether it goes on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        open_ = fill < capacity - SLACK
        if last:
            open_[:] = False
        elif open_.sum() > carry:
            emptiest = np.argsort(fill, kind="stable")[:carry]
            open_[:] = False
            open_[emptiest] = True
        grp = int(pdf["grp"].iat[0])
        base = (level << 58) + (grp << 24)
        return pd.DataFrame({
            "item": pdf["item"], "bin": base + bins, "offset": offsets, "fill": fill[bins], "grp": grp, "open": open_[bins],
        })

    ship(items.sparkSession)
    schema = "item bigint, bin bigint, offset bigint, fill bigint, grp bigint, open boolean"
    return items.groupBy("grp").applyInPandas(run, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan_in: int = FAN_IN, carry: int = CARRY) -> DataFrame:
    """``cut`` (from ``pieces``) with sequence_id and offset."""
    cut = stored(cut, "pieces")
    full = cut.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    rest = cut.filter(F.col("length") < capacity)
    n_groups = max(1, -(-rest.count() // group))
    items = rest.select(F.col("uid").alias("item"), "length", F.pmod(F.xxhash64("uid"), F.lit(n_groups)).alias("grp"))
    level, rounds = 0, []
    while True:
        rounds.append(stored(pack_groups(items, level, capacity, carry, n_groups == 1), f"round{level}"))
        if n_groups == 1:
            break
        # The open bins of ``fan_in`` groups are the items of one group of the next round.
        n_groups = -(-n_groups // fan_in)
        opened = rounds[-1].filter("open").select(F.col("bin").alias("item"), F.col("fill").alias("length"),
                                                  F.floor(F.col("grp") / fan_in).alias("grp"))
        items = opened.distinct()
        level += 1
    placed = rounds[0].select(F.col("item").alias("uid"), F.col("bin").alias("sequence_id"), "offset")
    for up in rounds[1:]:
        parent = up.select(F.col("item").alias("sequence_id"), F.col("bin").alias("_bin"), F.col("offset").alias("_off"))
        placed = placed.join(parent, "sequence_id", "left").select(
            "uid", F.coalesce("_bin", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("_off", F.lit(0))).alias("offset"),
        )
    return full.unionByName(rest.join(placed, "uid")).drop("uid")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences used, the least number possible for the tokens, and the share of room used."""
    totals = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return totals.agg(
        F.count(F.lit(1)).alias("sequences"), F.ceil(F.sum("n") / capacity).alias("least"),
        (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("used"),
    )


