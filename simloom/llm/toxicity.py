"""Toxicity from a learned lexicon, misspelled terms and their context.

Learning, from labelled rows that aren't held out: counts of words and of
their prefixes in toxic and other texts, outside of quotations, give a lexicon
of whole words and stems, each weighted by the log ratio of its rates.  Evidence must come from
texts of their own: of near copies with the same label (by sketches of their
five-word shingles) one counts, else a passage that a group of copies shares
would pass for a term.
The lexicon's Levenshtein automata, intersected with its trie, also match
misspelled forms; a term's forms at each distance get a weight of their own.
A window around each match tells quotation (quotation marks around it, a word
of reporting before it) from direct use.  A logistic model of the summed
weights, their rate among all words and the number of distinct matches gives
the score.  How much misspelled and quoted matches count beside plain ones is
chosen by the cross-validated loss on the rows of the fit; where that can't
tell, ``FUZZY_PRIOR`` and ``QUOTED_PRIOR`` stay.

The fit uses at most ``FIT_ROWS`` labelled rows (those of the least hashes);
the lexicon has all terms whose evidence and lift suffice.  Every text is
scored as a whole.

Defined cases: null and empty texts are scored as texts without matches; null
ids count as held in (their remainder is that of no text); labels that are
null are skipped, of repeated ones the greatest counts; repeated rows get
equal results; without labels of both kinds every score is 0; an empty table
gives no rows; labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from simloom.llm.levenshtein import MOST_STATES, STEM, WORD, Lexicon
from simloom.llm.shared import dropped, free_name, lean, slices, written
from simloom.llm.shingle_join import shingles

FIT_ROWS = 20_000
THRESHOLD = 0.3
PREFIXES = range(3, 11)
#: Least documents, evidence (G squared) and lift of a term.
MIN_DOCS, MIN_EVIDENCE, MIN_LIFT = 3, 16.0, 3.0
WINDOW = 60
#: Values of a labelled row's sketch, those of a band, and the share of equal ones that tells a near copy.
SKETCH, BAND, NEAR_COPY = 64, 4, 0.6
#: Words whose match a task remembers.
MOST_KNOWN = 200_000
#: Terms that a task counts before it hands them on to be summed.
MOST_TERMS = 100_000
#: Shares of a match's weight that a quoted one, and a misspelled one, keep; the choices that are held against the prior.
QUOTED_PRIOR, QUOTED = 0.35, (0.0, 0.15, 0.35, 0.6, 1.0)
FUZZY_PRIOR, FUZZY = 1.0, (0.0, 0.5, 1.0)
#: Weight of a misspelled form by its distance, until so many uses show another.
FORM_PRIOR, EVIDENCE = 0.7, 8
#: Least gain of mean log loss over the prior.
GAIN, FOLDS = 1e-4, 4
_TOKEN = re.compile(r"[^\W_]+")
_MARK = re.compile(r"[\"“”„«»‘’\n]")
#: Closing marks by opening one; other opening marks inside are part of the quotation.
_CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
_REPORT = re.compile(r"\b(?:said|says|wrote|writes|called|quoted|quote|the word|the term|sagte|schrieb|nannte|das wort|a dit|écrit|le mot|appelé|dijo|escribió|la palabra|llamó)\b")


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks that open and close on one line, in order."""
    out, begun, closing = [], 0, ""
    for m in _MARK.finditer(text):
        c = m[0]
        if c == "\n":
            closing = ""
        elif closing:
            if c in closing:
                out.append((begun, m.end()))
                closing = ""
        else:
            begun, closing = m.start(), _CLOSING.get(c, "")
    return out


def unquoted(text: str) -> str:
    """A text without its quotations, whose words tell nothing of who quotes them."""
    spans = quotations(text)
    ends = [0, *(b for _, b in spans)]
    return " ".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)], strict=True)) if spans else text


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    #: Weight by term and distance.
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    quoted: float = QUOTED_PRIOR
    fuzzy: float = FUZZY_PRIOR
    coefficients: list[float] | None = None

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.terms)
        self.known: dict[str, tuple[int, int] | None] = {}

    def _found(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """Words that match, with term and distance."""
        if len(self.lexicon.states) > MOST_STATES:
            self.lexicon.reset()
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        known, start = self.known, self.lexicon.start
        for w in words.difference(known):
            state = start
            for c in w:
                state = state[c]
                if state is None:
                    break
            known[w] = state.found if state is not None else None
        return {w: f for w in words if (f := known[w]) is not None}

    def matches(self, text: str) -> tuple[int, list[tuple[str, tuple[int, int], bool]]]:
        """Number of words; of each match the word, its term and distance, and whether it is quoted."""
        low = text.lower()
        words = _TOKEN.findall(low)
        memo = self._found(set(words)) if self.model.terms else {}
        if not memo:
            return len(words), []
        spans, out = quotations(low), []
        starts = [a for a, _ in spans]
        for m in _TOKEN.finditer(low):
            found = memo.get(m[0])
            if found:
                a, b = m.span()
                k = bisect_left(starts, a) - 1
                quoted = (k >= 0 and b < spans[k][1]) or bool(_REPORT.search(low, max(0, a - WINDOW), a))
                out.append((m[0], found, quoted))
        return len(words), out

    def counted(self, text: str) -> tuple[int, list[tuple[int, int, int, int, int]]]:
        """Number of words; of each term, distance and quotation that match the uses and distinct words."""
        n, found = self.matches(text)
        uses = Counter((*f, int(q)) for _, f, q in found)
        words = Counter((*f, int(q)) for _, f, q in set(found))
        return n, [(*k, c, words[k]) for k, c in uses.items()]

    def score(self, text: str) -> float:
        if self.model.coefficients is None:
            return 0.0
        x = features(np.array([_parts(*self.counted(text), self.model.weights)], float), self.model.quoted, self.model.fuzzy)[0]
        z = float(sum(a * b for a, b in zip(self.model.coefficients, x.tolist(), strict=True)))
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


def features(parts: np.ndarray, quoted: float, fuzzy: float) -> np.ndarray:
    """Inputs of the logistic model from rows of ``_parts``."""
    shares = np.array([1.0, fuzzy, quoted, quoted * fuzzy])
    n, weight, kinds = parts[:, 0], parts[:, 1:5] @ shares, parts[:, 5:9] @ shares
    rate = 100.0 * weight / np.maximum(n, 20)
    return np.stack([np.ones(len(n)), np.log1p(weight), np.minimum(rate, 30.0) / 10.0, np.log1p(rate), np.log1p(kinds), np.log1p(n) / 10.0], axis=1)


# learning


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences, toxic and other, of words (ending in a blank) and prefixes."""
    docs, uses = (Counter(), Counter()), (Counter(), Counter())

    def flush():
        terms = list(docs[0].keys() | docs[1].keys())
        columns = [pa.array([c[t] for t in terms], pa.int64()) for c in (docs[1], docs[0], uses[1], uses[0])]
        for c in (*docs, *uses):
            c.clear()
        return pa.record_batch([pa.array(terms, pa.string()), *columns], names=["term", "d1", "d0", "f1", "f0"])

    for b in slices(batches):
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tf = Counter()
            for w, n in Counter(_TOKEN.findall(unquoted((text or "").lower()))).items():
                tf[w + " "] += n
                for k in PREFIXES:
                    if k > len(w):
                        break
                    tf[w[:k]] += n
            docs[toxic].update(tf.keys())
            uses[toxic].update(tf)
            if len(docs[0]) + len(docs[1]) > MOST_TERMS:
                yield flush()
    yield flush()


def _copies(rows: DataFrame) -> DataFrame:
    """``id`` of rows that are near copies of another with the same label, for which it counts.

    Near copies are joined by sketches: least values of the hashes of five-word
    shingles under ``SKETCH`` maps.  Rows meet if a band of four is equal and
    link to the first of the band if enough values are; few short rows, so the
    driver joins them.
    """
    scale, shift = (np.random.default_rng(7).integers(0, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sketches = []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                h, least = shingles(t).view(np.uint64), np.full(SKETCH, (1 << 64) - 1, np.uint64)
                for start in range(0, len(h), 4096):
                    mixed = h[start : start + 4096, None] * scale + shift
                    least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
                sketches.append(least.tobytes())
            yield pa.record_batch([b.column(2), b.column(1), pa.array(sketches, pa.binary())], names=["id", "y", "sketch"])

    table = rows.select("text", "y", "id").mapInArrow(lean(run), "id long, y int, sketch binary").toArrow()  # at most fit_rows short rows
    ids, y = (table.column(k).to_numpy() for k in ("id", "y"))
    order = np.lexsort((ids, y))
    ids, y = ids[order], y[order]
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH)[order]
    parent = np.arange(len(ids))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for band in range(0, SKETCH, BAND):
        part = np.concatenate([sketch[:, band : band + BAND], y[:, None].astype(np.uint64)], axis=1)
        _, first, same = np.unique(part, axis=0, return_index=True, return_inverse=True)
        head = first[same.ravel()]
        near = (sketch == sketch[head]).mean(axis=1) >= NEAR_COPY
        for k in np.flatnonzero(near & (head != np.arange(len(ids)))).tolist():
            a, b = sorted((root(k), root(int(head[k]))))
            parent[b] = a
    repeats = [(int(ids[k]),) for k in range(len(ids)) if root(k) != k]
    return rows.sparkSession.createDataFrame(repeats, "id long")


def _g2(d1: Column, d0: Column, n1: int, n0: int) -> Column:
    n, total = n1 + n0, F.lit(0.0)
    for seen, expected in ((d1, (d1 + d0) * (n1 / n)), (d0, (d1 + d0) * (n0 / n)), (n1 - d1, (n - d1 - d0) * (n1 / n)), (n0 - d0, (n - d1 - d0) * (n0 / n))):
        total = total + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    return total


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, quoted: tuple[float, ...] = QUOTED, fuzzy: tuple[float, ...] = FUZZY) -> Model:
    """The model; ``quoted`` and ``fuzzy`` are the shares of weight that it may choose for such matches."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    n_known = known.count()
    share = min(1.0, 1.2 * fit_rows / max(n_known, 1))
    chosen = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("k"), "k").limit(fit_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select(F.coalesce("text", F.lit("")).alias("text"), "y").groupBy("text").agg(F.max("y").alias("y"))
    spread = max(2, docs.sparkSession.sparkContext.defaultParallelism)  # few rows, much work each
    every = written(rows.repartition(spread).withColumn("id", F.xxhash64("text")), "labelled")
    rows = written(every.join(F.broadcast(_copies(every)), "id", "left_anti").select("text", "y").repartition(spread), "labelled-once")
    dropped(every)
    n1, n0 = (rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first())
    if not n1 or not n0:
        return Model()
    counts = rows.mapInArrow(lean(_term_counts), "term string, d1 long, d0 long, f1 long, f0 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("d1", "d0", "f1", "f0")])
    lift = (F.col("d1") / n1) / ((F.col("d0") + 0.5) / (n0 + 1))
    good = counts.where((F.col("d1") >= MIN_DOCS) & (lift >= MIN_LIFT)).withColumn("g2", _g2(F.col("d1"), F.col("d0"), n1, n0)).where(F.col("g2") >= MIN_EVIDENCE)
    top = good.orderBy(F.desc("g2"), F.desc(F.length("term")), "term").collect()
    words1, words0 = rows.agg(F.sum(F.when(F.col("y") == 1, F.length("text"))), F.sum(F.when(F.col("y") == 0, F.length("text")))).first()
    ratio = math.log((words0 + 1) / (words1 + 1))
    model, plain, begun = Model(), set(), set()
    for r in top:
        term = r["term"].rstrip(" ")
        starts = [term[:k] for k in range(1, len(term) + 1)]
        if term in begun or not plain.isdisjoint(starts):
            continue
        plain.add(term)
        begun.update(starts)
        model.terms.append((term, WORD if r["term"].endswith(" ") else STEM))
        model.weights[len(plain) - 1, 0] = max(0.05, math.log((r["f1"] + 0.5) / (r["f0"] + 0.5)) + ratio)
    if not model.terms:
        return Model()
    found = _matched(rows, model)
    _weigh_forms(found, model, ratio)
    _fit(found, model, quoted, fuzzy)
    dropped(rows, found)
    return model


def _matched(rows: DataFrame, model: Model) -> DataFrame:
    """Of each row the label, words, and of each term, distance and quotation its uses and distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches):
            sizes, found = [], []
            for text in b.column(0).to_pylist():
                n, each = scorer.counted(text)
                sizes.append(n)
                found.append([x for m in each for x in m])
            yield pa.record_batch([b.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["y", "n", "found"])

    return written(rows.mapInArrow(lean(run), "y int, n long, found array<int>"), "matched")


def _weigh_forms(found: DataFrame, model: Model, ratio: float) -> None:
    """Weights of misspelled forms."""
    each = found.where("size(found) > 0").select("y", F.explode(F.expr("transform(sequence(0, cast(size(found) div 5 as int) - 1), i -> slice(found, i * 5 + 1, 5))")).alias("m"))
    each = each.select("y", F.col("m")[0].alias("k"), F.col("m")[1].alias("e"), F.col("m")[3].alias("c")).where("e > 0")
    forms = Counter()
    for r in each.groupBy("k", "e", "y").agg(F.sum("c").alias("n")).collect():  # at most four a term
        forms[r["k"], r["e"], r["y"]] = r["n"]
    for k in range(len(model.terms)):
        exact = model.weights[k, 0]
        for e in (1, 2):
            f1, f0 = forms[k, e, 1], forms[k, e, 0]
            learned = math.log((f1 + 0.5) / (f0 + 0.5)) + ratio
            model.weights[k, e] = max(0.0, min(exact, learned)) if f1 + f0 >= EVIDENCE else FORM_PRIOR**e * exact


def _parts(n: int, found: Iterable[tuple[int, int, int, int, int]], weights: dict[tuple[int, int], float]) -> list[float]:
    """Words; weight and distinct words of matches that are exact, misspelled, quoted, quoted and misspelled.

    ``found``: of each term, distance and quotation the uses and distinct words.
    """
    total, kinds = [0.0] * 4, [0] * 4
    for k, e, q, uses, words in sorted(found):
        weight = weights.get((k, e), 0.0)
        total[2 * q + (e > 0)] += uses * weight
        kinds[2 * q + (e > 0)] += words * (weight > 0)
    return [n, *total, *kinds]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss of rows by models fitted on the other folds."""
    fold, total = np.arange(len(y)) % FOLDS, 0.0
    for k in range(FOLDS):
        z = x[fold == k] @ _logistic(x[fold != k], y[fold != k])
        total += float(np.logaddexp(0, np.where(y[fold == k] > 0, -z, z)).sum())
    return total / len(y)


def _fit(found: DataFrame, model: Model, quoted: tuple[float, ...], fuzzy: tuple[float, ...]) -> None:
    weights = model.weights
    model.quoted, model.fuzzy = (prior if prior in of else of[0] for prior, of in ((QUOTED_PRIOR, quoted), (FUZZY_PRIOR, fuzzy)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_parts(n, zip(*[iter(f)] * 5, strict=True), weights) for n, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), b.column(0)], names=["x", "y"])

    table = found.mapInArrow(run, "x array<double>, y int").toArrow()  # at most fit_rows short rows
    parts = np.array(table.column("x").to_pylist()).reshape(table.num_rows, -1)
    y = np.array(table.column("y").to_pylist(), float)
    order = np.lexsort([*parts.T, y])  # sums don't depend on the order of rows
    parts, y = parts[order], y[order]
    if len(y) >= 8 * FOLDS:
        best = _loss(features(parts, model.quoted, model.fuzzy), y) - GAIN
        for q, f in product(quoted, fuzzy):
            loss = _loss(features(parts, q, f), y)
            if loss < best:
                best, model.quoted, model.fuzzy = loss, q, f
    model.coefficients = [float(round(c, 9)) for c in _logistic(features(parts, model.quoted, model.fuzzy), y)]


# scoring


def scored(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the score of each row's text."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches):
            s = [scorer.score(t or "") for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, score])

    return df.mapInArrow(lean(run), StructType([*df.schema.fields, StructField(score, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = learn(docs, labels)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches):
            s = [scorer.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = narrow.mapInArrow(lean(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    model = learn(docs, labels, key, text)
    name = free_name(docs, "toxicity")
    return scored(docs, model, text, name).where(F.col(name) < threshold).drop(name)
