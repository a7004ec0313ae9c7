"""Token counts per section by offsets.

A document is encoded once, as a whole; the tokens' spans are then interval-joined to the spans of its sections, so counts
add up to the document's and no section is encoded on its own (which would give other tokens at the edges).

Spans: byte-level tokens concatenate to the text's bytes, so lengths in the vocabulary give byte spans, and a running count of
first bytes gives character spans. The spans and the sections of one document are both sorted: the join is two binary
searches per token inside the task; no shuffle.

Rule for a token that crosses an edge: ``majority`` gives it to the section holding most of its bytes (the earlier one on a
tie); ``start`` to the section of its first byte. Tokens are never split or counted twice.

``section_counts`` takes a text's lines, each with its line break; ``field_counts`` the columns of a row; ``span_counts``
sections given as (doc_id, name, start, end) character spans, which may leave gaps: tokens there are counted under the name
null. Given sections come to their document by a join on its id; a document's sections are one array.

Defined results: null and empty texts have no token and one empty section; sections of length 0 get none; repeated
rows are counted each; given sections that overlap are refused, those beyond the text end with it, and those with a null
id, start or end are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import map_rows, utf8

_ENCODERS: dict[tuple[str, str], "ByteEncoder"] = {}


class ByteEncoder:
    """A ``tiktoken`` encoding from a rank file, with the byte length of every token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]

    def ends(self, text: str) -> np.ndarray:
        """End of every token in bytes."""
        return np.cumsum(self.sizes[self.model.encode_ordinary(text)]) if text else np.zeros(0, np.int64)


def encoder(path: str, pattern: str) -> ByteEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def line_ends(raw: bytes) -> np.ndarray:
    """End of every line in bytes, its break included; a text without a final break ends its last line."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return breaks if len(breaks) and breaks[-1] == len(raw) else np.append(breaks, len(raw))


def owners(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Section number of every token and whether it crosses an edge. Sections tile the text."""
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = first != last
    own = first.copy()
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            edges = np.concatenate([[starts[t]], section_ends[first[t] : last[t]], [token_ends[t]]])
            own[t] = first[t] + int(np.argmax(np.diff(edges)))
    elif rule != "start":
        raise ValueError(f"unknown rule {rule}")
    return own, crossing


def section_counts(docs: DataFrame, path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """doc_id, section (line number from 0), start and end (characters), n_tokens, n_crossing."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "section", "start", "end", "n_tokens", "n_crossing")}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            raw = utf8(text)
            ends = line_ends(raw)
            own, crossing = owners(encoder(path, pattern).ends(text or ""), ends, rule)
            chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if raw else np.zeros(1, np.int64)
            stops = np.where(ends > 0, chars[ends - 1], 0)
            n = len(ends)
            out["doc_id"].extend([doc_id] * n)
            out["section"].extend(range(n))
            out["start"].extend([0, *stops[:-1].tolist()])
            out["end"].extend(stops.tolist())
            out["n_tokens"].extend(np.bincount(own, minlength=n).tolist())
            out["n_crossing"].extend(np.bincount(own[crossing], minlength=n).tolist())
        return out

    schema = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint"
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def field_counts(docs: DataFrame, fields: list[str], path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """doc_id, field, n_tokens of the fields' texts joined in order without separator and encoded once."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "field": [], "n_tokens": []}
        for i, doc_id in enumerate(cols["doc_id"]):
            texts = [cols[f][i] or "" for f in fields]
            sizes = np.array([len(utf8(t)) for t in texts])
            # A token of no bytes does not exist, so an empty field owns none.
            own, _ = owners(encoder(path, pattern).ends("".join(texts)), np.cumsum(sizes), rule)
            out["doc_id"].extend([doc_id] * len(fields))
            out["field"].extend(fields)
            out["n_tokens"].extend(np.bincount(own, minlength=len(fields)).tolist())
        return out

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), *fields), run, "doc_id bigint, field string, n_tokens bigint")


def tiles(spans: list[dict], n: int) -> list[tuple[str | None, int, int]]:
    """Sorted sections and the gaps between them, as (name, start, end): together a text of ``n`` characters."""
    out: list[tuple[str | None, int, int]] = []
    at = 0
    for s in spans:
        start, end = min(s["start"], n), min(s["end"], n)
        if start < at or s["end"] < s["start"]:
            raise ValueError(f"section {s['name']} at {s['start']} overlaps another or ends before it starts")
        if start > at:
            out.append((None, at, start))
        out.append((s["name"], start, end))
        at = end
    return out if out and at == n else [*out, (None, at, n)]


def span_counts(docs: DataFrame, sections: DataFrame, path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """doc_id, name, start, end (characters), n_tokens, n_crossing of the given sections and of the gaps between them."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "name", "start", "end", "n_tokens", "n_crossing")}
        for doc_id, text, spans in zip(cols["doc_id"], cols["text"], cols["spans"]):
            raw = np.frombuffer(utf8(text), np.uint8)
            # Byte position of every character, and of the end.
            bytes_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            names, starts, ends = zip(*tiles(spans or [], len(bytes_at) - 1))
            own, crossing = owners(encoder(path, pattern).ends(text or ""), bytes_at[list(ends)], rule)
            out["doc_id"].extend([doc_id] * len(names))
            out["name"].extend(names)
            out["start"].extend(starts)
            out["end"].extend(ends)
            out["n_tokens"].extend(np.bincount(own, minlength=len(names)).tolist())
            out["n_crossing"].extend(np.bincount(own[crossing], minlength=len(names)).tolist())
        return out

    span = F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
                    F.col("name").cast("string").alias("name"))
    given = sections.select(F.col("doc_id").cast("bigint").alias("doc_id"), span.alias("span"))
    given = given.filter(F.col("span.start").isNotNull() & F.col("span.end").isNotNull())
    given = given.groupBy("doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(given, "doc_id", "left")
    schema = "doc_id bigint, name string, start bigint, end bigint, n_tokens bigint, n_crossing bigint"
    return map_rows(rows, run, schema)
