"""Secret scans: fixed patterns, and formats inferred from what they label.

The patterns give base spans: assignments to a credential's name, access keys
and long hexadecimal runs.  Their values label formats: for each kind the
values of a bounded sample, written as character classes, form a prefix tree
whose statistically compatible states are merged into a probabilistic
automaton, which knows lengths and positions.  All candidates of every text,
runs of six or more credential characters, or what base spans leave of them,
are scored by the best automaton's likelihood against that of ordinary runs:
fixed shares of classes (words, numbers, dotted names), and the steps between
classes in all texts.  Those that look like a labelled format become spans of
the kind ``format``.

Learning uses at most ``FIT_VALUES`` distinct values a kind, and ``FIT_CHARS``
characters of them, by least hashes; all texts are searched for them, all give
the steps between classes, and all are scanned whole.

Defined cases: null and empty texts have no spans; positions are code points;
repeated rows get equal results; without labelled values there are only base
spans; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.automata import Automaton
from simloom.llm.shared import dropped, written

FIT_VALUES, FIT_CHARS = 1000, 100_000
#: Values a kind that a format needs.
LEAST_VALUES = 8
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Points only inside, equals signs only as padding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-](?:[A-Za-z0-9+/_.-]*[A-Za-z0-9+/_-])?={0,2}")
SHORTEST = 6
#: Character classes and their sizes.
CLASSES = {"a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789", "+": "+/=", "-": "-_."}
_CLASS_OF = str.maketrans({c: k for k, cs in CLASSES.items() for c in cs})
SYMBOLS = "".join(CLASSES)
#: Class of each ASCII character, a blank for all others.
_BYTES = bytes(ord(chr(k).translate(_CLASS_OF)) if any(chr(k) in cs for cs in CLASSES.values()) else 32 for k in range(256))
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = range(1, len(SYMBOLS) + 1)
_STEPS = len(SYMBOLS) + 1
#: Characters of the runs whose score a task remembers.
MOST_KNOWN = 4_000_000
#: Class shares of runs that aren't credentials: words, numbers, dotted names, shouted words.
ORDINARY = (
    {"a": 0.30, "g": 0.64, "A": 0.01, "G": 0.01, "0": 0.02, "+": 0.005, "-": 0.015},
    {"a": 0.005, "g": 0.005, "A": 0.005, "G": 0.005, "0": 0.92, "+": 0.01, "-": 0.05},
    {"a": 0.24, "g": 0.52, "A": 0.01, "G": 0.01, "0": 0.08, "+": 0.02, "-": 0.12},
    {"a": 0.01, "g": 0.01, "A": 0.30, "G": 0.62, "0": 0.03, "+": 0.005, "-": 0.025},
)
#: Least mean and total log likelihood ratio of a format.
LEAST_MEAN, LEAST_TOTAL = 0.1, 6.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and then position."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def value_of(kind: str, matched: str) -> str:
    if kind == "assign":
        return ASSIGN.match(matched)[2]
    return matched


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def left_over(a: int, b: int, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the spans ``taken`` leave of a run."""
    out = []
    for _, x, y in sorted(taken, key=lambda s: s[1]):
        if x < b and a < y:
            out.append((a, x))
            a = max(a, y)
    return [(x, y) for x, y in [*out, (a, b)] if y > x]


@dataclass
class Formats:
    automata: list[Automaton] = field(default_factory=list)
    #: Log probability of a class, or of the end, after another; the first row and column are runs' ends.
    steps: list[list[float]] = field(default_factory=list)
    _known: dict[str, bool] = field(default_factory=dict)
    _held: int = 0

    def ordinary(self, shape: str) -> float:
        out = max(sum(math.log(m[c]) for c in shape) for m in ORDINARY)
        if self.steps:
            codes = [0, *(SYMBOLS.index(c) + 1 for c in shape), 0]
            out = max(out, sum(self.steps[x][y] for x, y in pairwise(codes)))
        return out

    def score(self, value: str) -> float:
        """Log likelihood ratio of the best format to ordinary runs."""
        shape = value.translate(_CLASS_OF)
        return max((a.log_likelihood(shape) for a in self.automata), default=-math.inf) - self.ordinary(shape)

    def fits(self, value: str) -> bool:
        score = self.score(value)
        return score >= LEAST_TOTAL and score >= LEAST_MEAN * len(value)

    def spans(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        if not self.automata:
            return []
        if self._held > MOST_KNOWN:
            self._known.clear()
            self._held = 0
        runs = set(CANDIDATE.findall(text))
        for r in runs.difference(self._known):
            self._known[r] = len(r) >= SHORTEST and self.fits(r)
            self._held += len(r)
        # a run is looked up where it stands only if it fits, or if a base span may take a part of it
        if not taken and not any(map(self._known.get, runs)):
            return []
        out = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if any(x < b and a < y for _, x, y in taken):
                rest = [(a + k.start(), a + k.end()) for a, c in left_over(a, b, taken) for k in CANDIDATE.finditer(text[a:c])]
                out += [("format", x, y) for x, y in rest if y - x >= SHORTEST and self.fits(text[x:y])]
            elif self._known[m[0]]:
                out.append(("format", a, b))
        return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct labelled values of a batch by kind, and how often each class follows each (kind ``step``)."""
    for b in batches:
        seen, steps = set(), np.zeros(_STEPS * _STEPS, np.int64)
        for t in b.column(0).to_pylist():
            if t:
                seen.update((k, value_of(k, t[x:y])) for k, x, y in base_spans(t))
                codes = _CODE[np.frombuffer(b" " + t.encode("ascii", "replace").translate(_BYTES) + b" ", np.uint8)]
                steps += np.bincount(codes[:-1] * _STEPS + codes[1:], minlength=len(steps))
        rows = [(k, v, 0, 1) for k, v in sorted(seen)] + [("step", "", int(k), int(steps[k])) for k in np.flatnonzero(steps)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.record_batch([pa.array(list(c), kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["kind", "value", "step", "n"])


def learn(docs: DataFrame, text: str = "text", fit_values: int = FIT_VALUES) -> Formats:
    found = docs.select(text).mapInArrow(_found, "kind string, value string, step int, n long").groupBy("kind", "value", "step").agg(F.sum("n").alias("n"))
    found = written(found, "labelled-values")
    counts = np.zeros((_STEPS, _STEPS))
    for r in found.where("kind = 'step'").collect():  # a row per pair of classes
        counts[r["step"] // _STEPS, r["step"] % _STEPS] = r["n"]
    counts[0, 0] = 0  # between runs
    steps = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).tolist() if counts.any() else []
    shares = {r["kind"]: min(1.0, 2 * fit_values / r["n"]) for r in found.where("kind <> 'step'").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    automata, used = [], set()
    for kind in KINDS:
        if kind not in shares:
            continue
        h = F.pmod(F.xxhash64("value"), F.lit(1 << 30))
        chosen = found.where((F.col("kind") == kind) & (F.length("value") <= FIT_CHARS) & (h < math.ceil(shares[kind] * (1 << 30))))
        rows = chosen.orderBy(h, "value").limit(fit_values).select("value").collect()
        values, room = [], FIT_CHARS
        for r in rows:
            if r["value"] not in used and len(r["value"]) <= room:
                room -= len(r["value"])
                values.append(r["value"])
        used.update(values)  # a value of two kinds counts for the first
        if len(values) >= LEAST_VALUES:
            automata.append(Automaton((plain(v) for v in values), SYMBOLS))
    dropped(found)
    return Formats(automata, steps)


def plain(value: str) -> str:
    return value.translate(_CLASS_OF)


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def report(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans and all spans of every text."""
    formats = learn(docs)

    def describe(text: str) -> tuple:
        base = base_spans(text)
        n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
        return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + formats.spans(text, base)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        names = [c.split()[0] for c in REPORT.split(", ")]
        for b in batches:
            rows = [describe(t or "") for t in b.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([b.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, REPORT)
