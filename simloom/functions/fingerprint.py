"""64-bit SimHash of short texts.

Features are windows of three characters and words, each hashed by 64-bit
FNV-1a over its UTF-8 bytes; a bit is set if more features have it than not.
Hashes are longs of the same bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of FNV-1a, 64 bits.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{WHITE_SPACE}]+")
_MEMO = 1_000_000


def fnv1a(text: str) -> int:
    h = FNV_START
    for byte in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def features(text: str) -> list[str]:
    """Of up to two characters each one; else windows of three, then words."""
    if len(text) <= 2:
        return list(text)
    return [text[i : i + 3] for i in range(len(text) - 2)] + _WORD.findall(text)


#: Characters of the texts that are hashed together.
_TOGETHER = 250_000
#: Most cells of a table of uses.
_DENSE = 1 << 23


def _fnv_of(codes: np.ndarray) -> np.ndarray:
    """FNV-1a of the UTF-8 bytes of rows of code points, all rows at once, byte by byte."""
    size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    marks = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint64)
    h = np.full(len(codes), FNV_START, np.uint64)
    for k in range(codes.shape[1]):
        c, n = codes[:, k].astype(np.uint64), size[:, k]
        for byte in range(int(n.max(initial=0))):
            shift = ((n - 1 - byte) * 6).clip(0).astype(np.uint64)
            part = c >> shift
            value = np.where(n == 1, c, marks[n] | part) if byte == 0 else np.uint64(0x80) | (part & np.uint64(0x3F))
            h = np.where(n > byte, (h ^ value) * np.uint64(FNV_PRIME), h)
    return h


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 bits of each hash, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _sums(table: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of ``table``, of runs of ``counts`` rows."""
    n, width = len(counts), len(table)
    if n * width <= _DENSE:  # how often each run has each row, times the table; exact in floats
        kind = np.float32 if counts.max(initial=0) < 1 << 24 else np.float64
        uses = np.bincount(np.repeat(np.arange(n), counts) * width + at, minlength=n * width).reshape(n, width)
        return (uses.astype(kind) @ table.astype(kind)).astype(np.int64)
    out = np.zeros((len(counts), table.shape[1]), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(table[at], starts, axis=0, dtype=np.int32)
    return out


def _hash_together(texts: list[str], memo: dict[str, int]) -> np.ndarray:
    """Hashes of small texts of three characters or more."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    keys = codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False  # a window begins at all but the last two characters of a text
    distinct, at = np.unique(keys[inside[:-2]], return_inverse=True)
    windows = np.stack([distinct >> np.uint64(21 * k) & np.uint64(0x1FFFFF) for k in range(3)], axis=1)
    votes = _sums(_bits(_fnv_of(windows)), at, sizes - 2)
    words = [_WORD.findall(t) for t in texts]
    for w in {w for each in words for w in each}.difference(memo):
        memo[w] = fnv1a(w)
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    places = {w: k for k, w in enumerate({w for each in words for w in each})}
    every = np.fromiter((places[w] for each in words for w in each), np.int64, int(n_words.sum()))
    votes += _sums(_bits(np.fromiter(map(memo.__getitem__, places), np.uint64, len(places))), every, n_words)
    return np.packbits(2 * votes > (sizes - 2 + n_words)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def simhash_texts(texts: list[str], memo: dict[str, int] | None = None) -> np.ndarray:
    """Hashes of texts as unsigned integers; 0 of an empty text."""
    memo = {} if memo is None else memo
    out = np.zeros(len(texts), np.uint64)
    low = [t.lower() for t in texts]
    group: list[int] = []
    room = _TOGETHER
    for k, t in enumerate(low):
        if len(t) < 3:
            votes = 2 * _bits(np.array([fnv1a(c) for c in t], np.uint64)).sum(axis=0, dtype=np.int64) - len(t)
            out[k] = int.from_bytes(np.packbits(votes > 0).tobytes(), "big") if t else 0
            continue
        if group and len(t) > room:
            out[group] = _hash_together([low[i] for i in group], memo)
            group, room = [], _TOGETHER
            if len(memo) > _MEMO:
                memo.clear()
        group.append(k)
        room -= len(t)
    if group:
        out[group] = _hash_together([low[i] for i in group], memo)
    return out


def simhash_text(text: str) -> int:
    """The hash as an unsigned integer; 0 of an empty text."""
    return int(simhash_texts([text])[0])


def simhash(text: Column | str) -> Column:
    """SimHash of a text column as a long."""

    def run(a: pa.Array) -> pa.Array:
        memo: dict[str, int] = {}
        known = a.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(a), np.int64)
        out[known] = simhash_texts(a.filter(pa.array(known)).to_pylist(), memo).view(np.int64)
        return pa.array(out, mask=~known)

    return F.arrow_udf(run, "long")(text)


def simhash_distance(a: Column | str, b: Column | str) -> Column:
    """Bits that differ."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column | str, b: Column | str) -> Column:
    return 1.0 - simhash_distance(a, b) / 64.0


def simhash_similarity(a: Column | str, b: Column | str) -> Column:
    return hash_similarity(simhash(a), simhash(b))


def unsigned(h: Column | str) -> Column:
    """The hash as a decimal of 20 digits, for ranges and display."""
    return F.conv(F.hex(h), 16, 10).cast("decimal(20,0)")


def bit_string(h: Column | str) -> Column:
    """64 bits, the highest first."""
    return F.lpad(F.bin(h), 64, "0")


def differing_bits(a: Column | str, b: Column | str) -> Column:
    """Positions of the bits that differ, from 0 for the lowest."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(a.bitwiseXOR(b), i) == 1)


def find_similar_hashes(df: DataFrame, query: int, most: int, column: str = "hash") -> DataFrame:
    """Rows whose hash is within ``most`` bits of ``query``, inclusive."""
    return df.where(F.bit_count(F.col(column).bitwiseXOR(F.lit(query - (1 << 64) if query >> 63 else query))) <= most)


def similar_positions(hashes: Column | str, query: Column, most: int) -> Column:
    """Positions, from 0, of the array's hashes within ``most`` bits of ``query``."""
    hashes = F.col(hashes) if isinstance(hashes, str) else hashes
    found = F.transform(hashes, lambda h, i: F.when(F.bit_count(h.bitwiseXOR(query)) <= most, i))
    return F.filter(found, lambda i: i.isNotNull())
