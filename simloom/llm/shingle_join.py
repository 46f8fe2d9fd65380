"""Exact join of texts whose sets of shingles are similar (Jaccard).

Shingles are brought into one order, the rarer first.  Sets of a similarity of
t share at least t times the size of either, so both have one of the same
shingles among their first ``n - ceil(t n) + 1``; no such pair is missed.  Only
these prefixes are shuffled.  What meets is held against the bounds that sizes
and places give, and against a parity bitmap: a set's bitmap has a bit for each
residue of hashes that an odd number of its shingles fall on, so bitmaps differ
in at most as many bits as sets differ in shingles.  Pairs that pass are held
against bitmaps that are as wide as the sets are large, which rule out nearly
all others; only what is left is verified on the whole sets, by the texts.

The order is by counts of shingles in a sample of texts, then by how often the
sample has their words (then by hash), so that shingles which meet by chance
come last, however large the table.  It decides how many pairs meet and never
which are found.  Pairs that are given (those of SimHash) are verified first.
Then members of a bucket are verified against one of them; then each against the
few of other components whose bitmaps are nearest, which joins most of a group;
last, all pairs whose ends are still in different components.  So a group of
copies costs about as much as its rows, and no pair that could join components
is left out.

Shingles and sets are known by hashes of 64 bits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.components import roots
from simloom.llm.shared import dropped, lean, released, slices, written

#: Texts of the sample, least uses in it of a common shingle, and how many of those are kept apart.
SAMPLE, COMMON, MOST_COMMON = 20_000, 3, 500_000
#: Most words whose use in the sample is known; steps in which it is measured, to a doubling.
MOST_WORDS, _STEPS = 200_000, 8
#: Most identifiers that are sent to executors to keep other texts out of a shuffle.
SENT = 4_000_000
#: Rows of postings and pairs in a batch.
ROWS = 65_536
#: Nearest members that a bucket's member is verified against before all others.
NEAREST = 4
_PLACE = 1 << 31
#: Bits of a bitmap, as columns of 64.
BITMAP, _WORDS = 256, ("b0", "b1", "b2", "b3")
_BITMAP_TYPES = ", ".join(f"{c} long" for c in _WORDS)


def _hashes(found: list[bytes], words: int) -> np.ndarray:
    """Hashes of all shingles of a text's words, in the text's order."""
    if not found:
        return np.zeros(0, np.int64)
    grams = zip(*(found[k:] for k in range(words)), strict=False) if len(found) > words else [found]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, map(b" ".join, grams), repeat(42))), np.int64)


def shingles(raw: bytes, words: int = 5) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    return np.unique(_hashes(raw.lower().split(), words))


def set_id(held: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(held.tobytes()), "little", signed=True)


def bitmap(held: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as four long integers."""
    odd = np.bincount(held & (BITMAP - 1), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_bitmap(held: np.ndarray) -> bytes:
    """The parity bitmap of at least two bits a shingle; its halves, one upon the other, give the next narrower."""
    width = max(BITMAP, 1 << (2 * len(held) - 1).bit_length()) if len(held) else BITMAP
    odd = np.bincount(held & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_apart(a: bytes, b: bytes) -> int:
    """Bits in which wide bitmaps differ, at the narrower's width."""
    narrow = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(w, np.uint64).reshape(-1, narrow // 8), axis=0) for w in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1) >= similarity


def _texts(b: pa.RecordBatch, k: int) -> list[bytes]:
    return [t or b"" for t in b.column(k).cast(pa.binary()).to_pylist()]


def _counted(words: int):
    """Counts of shingles (``word`` is null) and of words, of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [t.lower().split() for t in _texts(b, 0)]
            h, c = np.unique(np.concatenate([np.unique(_hashes(f, words)) for f in found]), return_counts=True)
            used = Counter(chain.from_iterable(found))
            yield pa.record_batch([pa.array(h), pa.nulls(len(h), pa.binary()), pa.array(c)], names=["h", "word", "c"])
            yield pa.record_batch([pa.nulls(len(used), pa.int64()), pa.array(list(used), pa.binary()), pa.array(list(used.values()), pa.int64())], names=["h", "word", "c"])

    return run


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Hashes, ascending, and counts of the shingles that a sample of the
    distinct texts holds often; and of its words, a measure of how often."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    counts = some.mapInArrow(lean(_counted(words)), "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))
    counts = written(counts.where(F.when(F.col("word").isNull(), F.col("c") >= COMMON).otherwise(F.col("c") > 1)), "counts")
    top = counts.where("word is null").orderBy(F.desc("c"), "h").limit(MOST_COMMON).toArrow()
    h, c = (top.column(k).to_numpy().astype(np.int64) for k in ("h", "c"))
    used = counts.where("word is not null").orderBy(F.desc("c"), "word").limit(MOST_WORDS).toArrow()
    often = np.rint(_STEPS * np.log2(used.column("c").to_numpy().astype(np.float64))).astype(int).tolist()
    uses = dict(zip(used.column("word").to_pylist(), often, strict=True))
    dropped(counts)
    order = np.argsort(h)
    return h[order], c[order], uses


def _weights(found: list[bytes], uses: dict[bytes, int], words: int) -> np.ndarray:
    """Of each shingle, the logarithm of how often its words would meet by chance."""
    each = np.fromiter(map(uses.get, found, repeat(0)), np.int64, len(found))
    return np.lib.stride_tricks.sliding_window_view(each, words).sum(axis=1) if len(found) > words else each.sum(keepdims=True)[: len(found)]


def _prefix(held: np.ndarray, weights: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    if len(common) and len(held):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        weights = weights + (np.where(common[at] == held, counts[at], 0) << 32)
    held = held[np.argsort(weights, kind="stable")]
    return held[: len(held) - math.ceil(similarity * len(held) - 1e-9) + 1]


def marked_sets(df: DataFrame, key: str, text: str, words: int, similarity: float, majority: Callable[[np.ndarray], int]) -> DataFrame:
    """``key``, ``text_hash``, ``fp`` (a set's identifier), ``simhash`` (``majority``
    of the hashes, repeats included), ``n`` (the set's size), ``prefix`` and bitmaps."""
    common, counts, uses = common_shingles(df.select(F.col(text).alias("text")), words)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps, marks, sizes, prefixes, wide, bits = [], [], [], [], [], []
            for t in _texts(b, 1):
                found = t.lower().split()
                hashes = _hashes(found, words)
                held, at = np.unique(hashes, return_index=True)
                fps.append(set_id(held))
                marks.append(majority(hashes))
                sizes.append(len(held))
                prefixes.append(_prefix(held, _weights(found, uses, words)[at], common, counts, similarity).tobytes())
                wide.append(wide_bitmap(held))
                bits.append(bitmap(held))
            words_of = np.array(bits, np.int64).reshape(-1, len(_WORDS)).T.copy()
            longs = [pa.array(x, pa.int64()) for x in (fps, marks, sizes)]
            yield pa.record_batch([b.column(0), b.column(2), *longs, pa.array(prefixes, pa.binary()), pa.array(wide, pa.binary()), *map(pa.array, words_of)], names=["k", "text_hash", "fp", "simhash", "n", "prefix", "wide", *_WORDS])

    given = df.select(F.col(key).alias("k"), text, F.xxhash64(text).alias("text_hash"))
    return given.mapInArrow(lean(run), f"k {kind}, text_hash long, fp long, simhash long, n long, prefix binary, wide binary, {_BITMAP_TYPES}").withColumnRenamed("k", key)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shingle of the prefixes with the set, its size and the shingle's place as one number, and its bitmap."""
    for b in batches:
        fp, first = np.unique(b.column(0).to_numpy(), return_index=True)
        n = b.column(1).to_numpy()[first]
        raw = b.column(2).take(pa.array(first)).to_pylist()
        sizes = np.array([len(x) // 8 for x in raw], np.int64)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bits = [pa.array(np.repeat(b.column(c).to_numpy()[first], sizes)) for c in _WORDS]
        yield pa.record_batch([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(np.repeat(fp, sizes)), pa.array(np.repeat(n, sizes) * _PLACE + place), *bits], names=["h", "fp", "at", *_WORDS])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which bitmaps differ; the last axis has their words."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _possible(x: np.ndarray, y: np.ndarray, apart: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may be similar that share a shingle, by their sizes, its places and the bitmaps."""
    (n, i), (m, j) = np.divmod(x, _PLACE), np.divmod(y, _PLACE)
    most = np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1
    least = similarity / (1 + similarity) * (n + m) - 1e-6
    return (most >= least) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (apart <= n + m - 2 * least)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets: rows that are sorted by the first column."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or (held and held[-1][0][-1] != now[0][0]):
            if not cut:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = [now]
                continue
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in now], strict=True)]
            held = [[c[cut:] for c in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _met(similarity: float):
    """Postings of shingles that several sets have, with the bucket's first set where it may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, fp, at, *words in _buckets(batches):
            new = (np.diff(h, prepend=h[0]) != 0) | (np.diff(fp, prepend=fp[0]) != 0)
            new[0] = True
            h, fp, at, bits = h[new], fp[new], at[new], np.stack(words, axis=1)[new]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(starts, len(h)))
            lead, many = np.repeat(starts, sizes), np.repeat(sizes, sizes) > 1
            near = _possible(at, at[lead], _apart(bits, bits[lead]), similarity) & (lead != np.arange(len(h)))
            head = pa.array(fp[lead][many], mask=~near[many])
            yield pa.record_batch([pa.array(h[many]), pa.array(fp[many]), pa.array(at[many]), *map(pa.array, bits[many].T.copy()), head], names=["h", "fp", "at", *_WORDS, "head"])

    return run


def _across(similarity: float, nearest: int | None):
    """Pairs of a bucket in different components that may be similar: of each
    member the ``nearest`` ones by bitmaps, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, fp, at, *words, root in _buckets(batches):
            bits = np.stack(words, axis=1)
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            stops = np.append(starts[1:], len(h))
            us, vs, n = [], [], 0
            for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
                for k in range(s, e - 1 if nearest is None else e):
                    rest = np.arange(k + 1 if nearest is None else s, e)
                    rest = rest[root[rest] != root[k]]
                    apart = _apart(bits[rest], bits[k])
                    may = _possible(at[rest], at[k], apart, similarity)
                    rest, apart = rest[may], apart[may]
                    if nearest is not None and len(rest) > nearest:
                        rest = rest[np.argsort(apart, kind="stable")[:nearest]]
                    if len(rest):
                        us.append(np.minimum(fp[rest], fp[k]))
                        vs.append(np.maximum(fp[rest], fp[k]))
                        n += len(rest)
                    if n > ROWS:
                        yield pa.record_batch([np.concatenate(us), np.concatenate(vs)], names=["u", "v"])
                        us, vs, n = [], [], 0
            if n:
                yield pa.record_batch([np.concatenate(us), np.concatenate(vs)], names=["u", "v"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, wide: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``u``, ``v``) that are similar, by the whole sets of ``texts`` (``text``).

    ``wide`` has the hash of a text of each set.
    """
    need = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    n = need.count()
    sent = np.sort(need.join(wide, "fp").select("text_hash").toArrow().column(0).to_numpy()) if n <= SENT else None

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if sent is not None:
                b = b.filter(pa.array(np.isin(b.column(1).to_numpy(), sent)))
            ids = [set_id(shingles(t, words)) for t in _texts(b, 0)]
            yield pa.record_batch([pa.array(ids, pa.int64()), b.column(0)], names=["fp", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in slices(batches):
            keep = []
            for k, (v, a, c) in enumerate(zip(b.column(1).to_pylist(), _texts(b, 2), _texts(b, 3), strict=True)):
                if v != last:
                    last, held = v, shingles(c, words)
                if similar(shingles(a, words), held, similarity):
                    keep.append(k)
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))

    some = texts.select("text", F.xxhash64("text")).mapInArrow(lean(named), "fp long, text string")
    if sent is None:
        some = some.join(need, "fp", "left_semi")
    some = written(some.groupBy("fp").agg(F.first("text").alias("text")), "texts")
    both = pairs.join(some.select(F.col("fp").alias("u"), F.col("text").alias("a")), "u").join(some.select(F.col("fp").alias("v"), F.col("text").alias("b")), "v")
    out = written(both.select("u", "v", "a", "b").mapInArrow(lean(run), "u long, v long"), "verified")
    dropped(some)
    return out


def _by_bitmaps(similarity: float):
    """Pairs that may be similar by their sizes and wide bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 4))
            least = similarity / (1 + similarity) * (n + m) - 1e-6
            apart = np.fromiter(map(wide_apart, b.column(3).to_pylist(), b.column(5).to_pylist()), np.int64, len(n))
            may = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (apart <= n + m - 2 * least)
            yield b.select([0, 1]).filter(pa.array(may))

    return run


def likely(pairs: DataFrame, wide: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` that wide bitmaps don't rule out; written."""
    ends = [wide.select(F.col("fp").alias(e), F.col("n").alias(f"n{e}"), F.col("wide").alias(f"w{e}")) for e in "uv"]
    both = pairs.join(ends[0], "u").join(ends[1], "v").select("u", "v", "nu", "wu", "nv", "wv")
    return written(both.mapInArrow(lean(_by_bitmaps(similarity)), "u long, v long"), "likely")


def similar_links(marked: DataFrame, texts: DataFrame, words: int, similarity: float, given: DataFrame) -> list[DataFrame]:
    """Written tables of ``u``, ``v``: links that join all similar sets of ``marked_sets``, directly or through others.

    The first table has those of the pairs ``given``.
    """
    wide = written(marked.groupBy("fp").agg(F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("text_hash").alias("text_hash")), "wide")
    tried, near = [], []

    def tell(pairs: DataFrame) -> None:
        for before in tried:
            pairs = pairs.join(before, ["u", "v"], "left_anti")
        tried.append(written(pairs, "pairs"))
        may = likely(tried[-1], wide, similarity)
        near.append(verified(may, texts, wide, words, similarity))
        dropped(may)
        released(marked.sparkSession)

    tell(given.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    postings = marked.select("fp", "n", "prefix", *_WORDS).mapInArrow(lean(_postings), f"h long, fp long, at long, {_BITMAP_TYPES}")
    met = written(postings.repartition("h").sortWithinPartitions("h", "fp").mapInArrow(lean(_met(similarity)), f"h long, fp long, at long, {_BITMAP_TYPES}, head long"), "met")
    released(marked.sparkSession)
    tell(met.where("head is not null").select(F.least("fp", "head").alias("u"), F.greatest("fp", "head").alias("v")).distinct())
    for nearest in (NEAREST, None):
        tops = roots(reduce(DataFrame.unionAll, near))
        member = met.join(tops.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("h", "fp", "at", *_WORDS, F.coalesce("root", "fp").alias("root"))
        mixed = member.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
        rest = member.join(mixed, "h").repartition("h").sortWithinPartitions("h", "fp")
        tell(rest.mapInArrow(lean(_across(similarity, nearest)), "u long, v long").distinct())
        dropped(tops)
    dropped(met, wide, *tried)
    return near
