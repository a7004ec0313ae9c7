"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what patterns miss.

The field reads the words of a line and tags each as begin, inside or outside of a secret. Its inputs are the
shape of the word (length, character classes, variety, keywords), the shapes of the words before and after it, and features of
the file (shares of lines with an assignment, of digits). Training is maximum likelihood in numpy (forward and
backward sums over all lines of a batch at once) on a bounded sample: at most ``MAX_MARKED`` windows around pattern matches, the same
with the name before the value left out, at most ``MAX_PLAIN`` others, half of them around odd-looking words without a match, each drawn from all texts by lowest hash. Patterns are the labels
(distant supervision): the secret value is marked, not its name.

Decoding is Viterbi over every line of every whole text. A word's scores depend only on its string, so they
are looked up; the recursion runs over all lines of a slice together. Tagged words, without surrounding quotes and
brackets, become spans of kind ``crf`` if they have ``MIN_CHARS`` characters and overlap no pattern match.

Defined results: null text is empty and has no span; without any pattern match in the table there is nothing to
learn and no ``crf`` span; repeated rows are scanned each. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import map_rows, mix, stored, utf8

MAX_MARKED, MAX_PLAIN = 3_000, 3_000
AROUND, PLAIN_WORDS = 12, 30
MIN_CHARS = 8
STEPS, RATE, L2 = 150, 0.1, 1e-4
REMEMBERED = 400_000
MARKS = ".,;!?|#$%&*()[]{}<>"
EDGES = "\"'`,;:()[]{}<>|#$%&*"

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
HEX_MAP = bytes(49 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
MIN_ODD, MIN_RANDOM = 8, 12
CUES = ("pass", "secret", "token", "key", "auth", "akia", "credential", "bearer")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Pattern matches (start, kind, end), and the stretches that hold the secret values.

    A cheap look for the necessary characters goes before each pattern.
    """
    spans: list[Span] = []
    values: list[tuple[int, int]] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        found = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        spans += [(a, 1, b) for a, b in found]
        values += found
    if b"1" * MIN_HEX in text.encode("latin-1", "replace").translate(HEX_MAP):
        found = [m.span() for m in HEX.finditer(text)]
        spans += [(a, 2, b) for a, b in found]
        values += found
    return sorted(spans), sorted(values)


def shape(word: str) -> tuple[int, ...]:
    """Active features of a word's shape, ``N_SHAPE`` in all."""
    n, kinds = len(word), len(set(word))
    low = word.lower()
    cues = tuple(35 + i for i, c in enumerate(CUES) if c in low)
    inner = word.strip(MARKS)
    if inner.isalpha():
        # Nearly all words: letters with punctuation around, told apart by length, variety and capitals.
        upper = 0 if word == low else sum(map(str.isupper, word))
        return _letters(n, kinds, upper, word.isascii(), n >= 8 and not low.strip("abcdef"), inner != word) + cues
    digits = sum(c.isdigit() for c in word)
    core = word.strip(EDGES)
    flags = [
        *_lengths(n), digits > 0, digits * 4 >= n, digits * 2 >= n, digits == n,
        *_capitals(n, sum(c.isupper() for c in word), digits), *_variety(n, kinds),
        word[:1] in "\"'`", word[-1:] in "\"'`", word[-1:] in "=:", word in ("=", ":", "=>", ":="),
        "=" in word, ":" in word, "/" in word or "+" in word, "@" in word, "." in core, "_" in core, "-" in core,
        not word.isascii(), bool(core) and core.strip("0123456789abcdef") == "" and len(core) >= 8,
        bool(core) and core.isalpha(), core != word, core.startswith("AKIA"),
    ]
    return tuple(i for i, f in enumerate(flags) if f) + cues


def _lengths(n: int) -> list[bool]:
    return [True, n >= 4, n >= 8, n >= 12, n >= 16, n >= 20, n >= 24, n >= 32, n >= 48]


def _capitals(n: int, upper: int, digits: int) -> list[bool]:
    return [upper > 0, upper * 4 >= n, upper > 0 and digits > 0]


def _variety(n: int, kinds: int) -> list[bool]:
    return [kinds >= 8, kinds >= 12, kinds * 2 >= n]


@lru_cache(maxsize=100_000)
def _letters(n: int, kinds: int, upper: int, ascii_only: bool, hex_only: bool, marked: bool) -> tuple[int, ...]:
    flags = [*_lengths(n), *[False] * 4, *_capitals(n, upper, 0), *_variety(n, kinds), *[False] * 11,
             not ascii_only, hex_only, True, marked, False]
    return tuple(i for i, f in enumerate(flags) if f)


N_SHAPE = 35 + len(CUES)
N_FILE = 6


def file_features(raw: bytes) -> list[float]:
    """Shares of lines that assign something and of digits, in steps."""
    lines = raw.count(b"\n") + 1
    assigning = sum(b"=" in x or b":" in x for x in raw.split(b"\n")) / lines if b"=" in raw or b":" in raw else 0.0
    digits = (len(raw) - len(raw.translate(None, b"0123456789"))) / max(len(raw), 1)
    return [float(x) for x in (assigning > 0, assigning > 0.1, assigning > 0.5, digits > 0.01, digits > 0.05, digits > 0.2)]


@dataclass
class Field:
    """Weights: own, previous and next word's shape, file features (each by state), and transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    @classmethod
    def zero(cls) -> Field:
        s = (N_SHAPE, 3)
        return cls(np.zeros(s), np.zeros(s), np.zeros(s), np.zeros((N_FILE, 3)), np.zeros((3, 3)), np.zeros(3))

    def parts(self) -> list[np.ndarray]:
        return [self.own, self.before, self.after, self.file, self.moves, self.start]


@dataclass
class Batch:
    """Lines laid out one after another, longest first."""

    sizes: np.ndarray
    starts: np.ndarray
    words: np.ndarray  # row of each token's shape in the shape table
    files: np.ndarray  # file features of each line

    def active(self) -> Iterable[tuple[int, int]]:
        """Step and number of lines that long."""
        if len(self.sizes):
            counts = np.searchsorted(-self.sizes, -np.arange(1, self.sizes[0] + 1), side="right")
            yield from enumerate(counts.tolist())


def batch_of(lines: list[list[int]], files: list) -> tuple[Batch, np.ndarray]:
    """The batch and the original number of each of its lines."""
    sizes = np.array([len(x) for x in lines], np.int64)
    by = np.argsort(-sizes, kind="stable")
    words = np.fromiter(chain.from_iterable(lines[i] for i in by), np.int64, int(sizes.sum()))
    sizes = sizes[by]
    starts = np.cumsum(sizes) - sizes
    return Batch(sizes, starts, words, np.array([files[i] for i in by]).reshape(len(by), N_FILE)), by


def emissions(scores: tuple[np.ndarray, np.ndarray, np.ndarray], f: Field, b: Batch) -> np.ndarray:
    """Score of every token in every state; ``scores`` are the shape table times own, before and after."""
    own, before, after = scores
    e = own[b.words]
    if not len(b.words):
        return e
    inner = np.ones(len(b.words), bool)
    inner[b.starts[b.sizes > 0]] = False
    e[1:][inner[1:]] += before[b.words[:-1]][inner[1:]]
    e[:-1][inner[1:]] += after[b.words[1:]][inner[1:]]
    e += np.repeat(b.files @ f.file, b.sizes, axis=0)
    e[b.starts[b.sizes > 0]] += f.start
    return e


def viterbi(e: np.ndarray, moves: np.ndarray, b: Batch) -> np.ndarray:
    """Best state of every token, all lines together."""
    back = np.zeros((len(e), 3), np.int8)
    score = np.zeros((len(b.sizes), 3))
    ends = np.zeros(len(b.sizes), np.int64)
    for t, m in b.active():
        at = b.starts[:m] + t
        if t == 0:
            score[:m] = e[at]
            continue
        paths = score[:m, :, None] + moves
        back[at] = paths.argmax(axis=1)
        score[:m] = paths.max(axis=1) + e[at]
    ends = score.argmax(axis=1)
    tags = np.zeros(len(e), np.int8)
    state = ends
    for t, m in reversed(list(b.active())):
        at = b.starts[:m] + t
        tags[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return tags


def likelihood(e: np.ndarray, moves: np.ndarray, b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every token's state, and the expected number of each move."""
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    norm = lambda x: x - np.logaddexp.reduce(x, axis=1, keepdims=True)
    steps = list(b.active())
    for t, m in steps:
        at = b.starts[:m] + t
        alpha[at] = norm(e[at] if t == 0 else np.logaddexp.reduce(alpha[at - 1][:, :, None] + moves, axis=1) + e[at])
    expected = np.zeros((3, 3))
    for (t, _), (_, m) in zip(reversed(steps[:-1]), reversed(steps[1:])):
        at = b.starts[:m] + t
        after = e[at + 1] + beta[at + 1]
        both = alpha[at][:, :, None] + moves + after[:, None, :]
        beta[at] = norm(np.logaddexp.reduce(moves + after[:, None, :], axis=2))
        both -= np.logaddexp.reduce(both.reshape(len(at), 9), axis=1)[:, None, None]
        expected += np.exp(both).sum(axis=0)
    return np.exp(norm(alpha + beta)), expected


def shape_rows(shapes: list[tuple[int, ...]]) -> np.ndarray:
    out = np.zeros((len(shapes), N_SHAPE))
    for i, active in enumerate(shapes):
        out[i, list(active)] = 1
    return out


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], axis=1)


def fit(rows: list[tuple[list[str], list[int], list[float]]], steps: int = STEPS) -> Field:
    """Field from (words, states, file features) lines; states: 0 outside, 1 begin, 2 inside."""
    number: dict[tuple[int, ...], int] = {}
    lines = [[number.setdefault(shape(w), len(number)) for w in words] for words, _, _ in rows]
    b, by = batch_of(lines, [f for _, _, f in rows])
    shapes = shape_rows(list(number))
    gold = np.fromiter(chain.from_iterable(rows[i][1] for i in by), np.int64, len(b.words))
    inner = np.ones(len(gold), bool)
    inner[b.starts[b.sizes > 0]] = False
    moved = np.zeros((3, 3))
    np.add.at(moved, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    line_of = np.repeat(np.arange(len(b.sizes)), b.sizes)
    f = Field.zero()
    first = [np.zeros_like(p) for p in f.parts()]
    second = [np.zeros_like(p) for p in f.parts()]
    n = max(len(b.sizes), 1)
    for t in range(1, steps + 1):
        e = emissions((shapes @ f.own, shapes @ f.before, shapes @ f.after), f, b)
        posterior, expected = likelihood(e, f.moves, b)
        miss = posterior
        miss[np.arange(len(gold)), gold] -= 1
        per_shape = (
            summed(b.words, miss, len(number)), summed(b.words[:-1][inner[1:]], miss[1:][inner[1:]], len(number)),
            summed(b.words[1:][inner[1:]], miss[:-1][inner[1:]], len(number)),
        )
        by_line = summed(line_of, miss, len(b.sizes))
        grads = [*(shapes.T @ x for x in per_shape), b.files.T @ by_line, expected - moved, miss[b.starts[b.sizes > 0]].sum(axis=0)]
        for p, g, m, v in zip(f.parts(), grads, first, second):
            g = g / n + L2 * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return f


class Scanner:
    """Decodes slices of texts; remembers the shapes of words (bounded)."""

    def __init__(self, f: Field | None):
        self.field = f
        self.rows: dict[bytes, int] = {}  # word to shape row
        self.shapes: dict[tuple[int, ...], int] = {}
        self.tables = (np.zeros((0, 3)),) * 3

    def shape_ids(self, words: list[bytes]) -> np.ndarray:
        new = set(words) - self.rows.keys()
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows = {}
            new = set(words)
        known = len(self.shapes)
        for w in new:
            self.rows[w] = self.shapes.setdefault(shape(w.decode("utf-8", "replace")), len(self.shapes))
        made = shape_rows(list(self.shapes)[known:])
        weights = (self.field.own, self.field.before, self.field.after)
        self.tables = tuple(np.concatenate([t, made @ m]) for t, m in zip(self.tables, weights))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def hopeful(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, files: np.ndarray) -> np.ndarray:
        """Lines in which some word could leave the outside state on a best path (an upper bound per word).

        A stretch of n words in other states changes at most n + 1 moves, so at most two per word.
        """
        gain = [np.maximum(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) for t in (*self.tables, self.field.file)]
        by_file = (files @ (self.field.file[:, 1:] - self.field.file[:, :1])).max(axis=1)
        bound = gain[0][ids]
        bound[1:] += np.maximum(gain[1][ids[:-1]], 0)
        bound[:-1] += np.maximum(gain[2][ids[1:]], 0)
        start = max(0.0, float((self.field.start[1:] - self.field.start[0]).max()))
        bound += np.repeat(by_file, sizes) + 2 * max(0.0, float((self.field.moves - self.field.moves[0, 0]).max())) + start
        out = np.zeros(len(sizes), bool)
        some = sizes > 0
        if some.any():
            out[some] = np.maximum.reduceat(bound, starts[some]) >= 0
        return out

    def extra(self, texts: list[str], based: list[list[Span]]) -> list[list[Span]]:
        """Spans of kind crf of every text, apart from the pattern matches."""
        out: list[list[Span]] = [[] for _ in texts]
        if self.field is None:
            return out
        raws = [utf8(t) for t in texts]
        lines = [r.split(b"\n") for r in raws]
        sizes = np.fromiter((len(x.split()) for d in lines for x in d), np.int64, sum(map(len, lines)))
        owner = np.repeat(np.arange(len(texts)), [len(d) for d in lines])
        ids = self.shape_ids(list(chain.from_iterable(r.split() for r in raws)))
        starts = np.cumsum(sizes) - sizes
        files = np.array([file_features(r) for r in raws]).reshape(len(raws), N_FILE)
        chosen = np.flatnonzero(self.hopeful(ids, starts, sizes, files[owner]))
        b, by = batch_of([ids[starts[i] : starts[i] + sizes[i]].tolist() for i in chosen], [files[owner[i]] for i in chosen])
        tags = viterbi(emissions(self.tables, self.field, b), self.field.moves, b)
        flat = [x for d in lines for x in d]
        offsets = np.concatenate([np.cumsum([0, *(len(x) + 1 for x in d[:-1])]) for d in lines]) if lines else []
        for r in np.unique(np.searchsorted(b.starts + b.sizes, np.flatnonzero(tags), side="right")):
            i = chosen[by[r]]
            o = owner[i]
            for a, z in tagged(flat[i], tags[b.starts[r] : b.starts[r] + b.sizes[r]]):
                a, z = (len(raws[o][: x + int(offsets[i])].decode("utf-8", "surrogatepass")) for x in (a, z))
                if not any(s < z and a < e for s, _, e in based[o]):
                    out[o].append((a, 3, z))
        return [sorted(x) for x in out]


def places(line: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", line)]


def tagged(line: bytes, states: np.ndarray) -> list[tuple[int, int]]:
    """Trimmed stretches of begin and inside words; an inside word after an outside one begins a stretch."""
    runs: list[list[int]] = []
    for (a, z), s, prior in zip(places(line), states, [0, *states[:-1]]):
        if s == 2 and prior != 0:
            runs[-1][1] = z
        elif s:
            runs.append([a, z])
    out = []
    edges = EDGES.encode()
    for a, z in runs:
        part = line[a:z]
        core = part.strip(edges)
        if len(core) >= MIN_CHARS:
            left = len(part) - len(part.lstrip(edges))
            out.append((a + left, a + left + len(core)))
    return out


def looks_random(value: bytes) -> bool:
    """Letters and digits mixed, and long: no word of a language."""
    return len(value) >= MIN_RANDOM and any(48 <= c < 58 for c in value) and any(chr(c).isalpha() for c in value) and b"." not in value


def looks_odd(word: bytes) -> bool:
    """Words a careless scanner might take for secrets: with digits, or very long."""
    return len(word) >= MIN_ODD and (any(48 <= c < 58 for c in word) or len(word) >= 2 * MIN_ODD)


def around(line: bytes, inside: list[tuple[int, int]]) -> tuple[list[bytes], list[int]]:
    """The words near the marked stretches of a line, and their states."""
    states: list[int] = []
    for p, q in places(line):
        hit = next((a for a, z in inside if a < q and z > p), None)
        states.append(0 if hit is None else 1 if hit >= p or not states or not states[-1] else 2)
    on = np.flatnonzero(states)
    lo, hi = max(0, on[0] - AROUND), on[-1] + AROUND + 1
    return line.split()[lo:hi], states[lo:hi]


def windows_of(text: str) -> list[tuple[str, list[bytes], list[int]]]:
    """All training windows of one text: (kind, words, states).

    ``marked``: around matches. ``bare``: the same without the name and sign before a value that looks random, so that values are learnt
    by their own shape. ``odd``: around words that look a little like secrets but match no pattern. ``plain``: other lines.
    """
    raw = utf8(text)
    spans, values = base_spans(text)
    # Byte positions of the values, and where the match of each begins.
    at = [(len(utf8(text[: v[0]])), len(utf8(text[: v[1]]))) for v in values]
    begins = [max((len(utf8(text[:a])) for a, _, z in spans if a <= v[0] and v[1] <= z), default=p) for v, (p, _) in zip(values, at)]
    out, start = [], 0
    for line in raw.split(b"\n"):
        end = start + len(line)
        inside = [(max(p - start, 0), q - start, b - start) for (p, q), b in zip(at, begins) if p < end and q > start]
        if inside:
            out.append(("marked", *around(line, [(p, q) for p, q, _ in inside])))
            # A value may match several patterns.
            p, q, b = min(x[0] for x in inside), max(x[1] for x in inside), min(x[2] for x in inside)
            one = all(x[0] < y[1] and y[0] < x[1] for x in inside for y in inside)
            if one and 0 <= b < p and looks_random(line[p:q]):
                out.append(("bare", *around(line[:b] + line[p:], [(b, b + q - p)])))
        elif words := line.split():
            odd = [i for i, w in enumerate(words) if looks_odd(w)]
            if odd:
                part = words[max(0, odd[0] - AROUND) : odd[0] + AROUND + 1]
                out.append(("odd", part, [0] * len(part)))
            else:
                out.append(("plain", words[:PLAIN_WORDS], [0] * len(words[:PLAIN_WORDS])))
        start = end + 1
    return out


def train(docs: DataFrame, marked: int = MAX_MARKED, plain: int = MAX_PLAIN) -> Field | None:
    """The field from at most ``marked`` windows around matches (and as many bare ones) and ``plain`` others (half of them odd ones).

    Windows of every kind are drawn from all windows of all texts, lowest hash first; a task sends no more than the bound of each kind.
    """
    bounds = {"marked": marked, "bare": marked, "odd": plain // 2, "plain": plain // 2}

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"kind": [], "hash": [], "words": [], "states": [], "file": []}
        for h, text in zip(cols["hash"], cols["text"]):
            found = windows_of(text or "")
            file = file_features(utf8(text)) if found else []
            own = np.uint64(h & (2**64 - 1))
            keys = mix(own + np.arange(len(found), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if found else []
            # Ordinary lines are most of a text: of these one in sixteen takes part, by its hash.
            for key, (kind, words, states) in zip(keys, found):
                if kind != "plain" or int(key) % 16 == 0:
                    out["kind"].append(kind)
                    out["hash"].append(int(key >> np.uint64(1)))
                    out["words"].append([w.decode("utf-8", "replace") for w in words])
                    out["states"].append(states)
                    out["file"].append(file)
        return out

    schema = "kind string, hash bigint, words array<string>, states array<int>, file array<double>"
    rows = stored(map_rows(docs.select(F.xxhash64("doc_id", "text").alias("hash"), "text"), run, schema), "windows")
    got = []
    for kind, n in bounds.items():
        got += rows.filter(F.col("kind") == kind).orderBy("hash", F.col("words")).limit(n).collect()
    if not any(r["kind"] == "marked" for r in got):
        return None
    return fit([(r["words"], r["states"], r["file"]) for r in got])


def text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def scanned(docs: DataFrame, f: Field | None) -> DataFrame:
    """doc_id, numbers by pattern, base (pattern spans) and spans (all) as kind:start:end lists."""
    scanner = Scanner(f)

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in cols["text"]]
        based = [base_spans(t)[0] for t in texts]
        more = scanner.extra(texts, based)
        counts = [[sum(s[1] == k for s in spans) for spans in based] for k in range(3)]
        return {
            "doc_id": cols["doc_id"], "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
            "base": [text_of(s) for s in based], "spans": [text_of(s + m) for s, m in zip(based, more)],
        }

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)
