"""Token counts without token ids.

Documents are cut into pre-tokens exactly as the tokenizer's file says, and a
block of documents keeps its distinct pre-tokens once, with each document's
frequencies as a sparse row.  The blocks' pre-tokens are dealt out by ranges of
their hash, so a pre-token of any number of blocks and documents meets itself
in one range and its pieces are counted once.  The counts go back to their
blocks and each document's count is the sum of frequency times pieces.

What is shuffled grows with distinct pre-tokens of blocks, not with text: a
word that is in every document is one entry of each block.

Special strings inside a text count as one token each and cut it, as the
library does by default; none are added, nothing is truncated or padded.

Defined cases: a null text is empty and has no tokens; a null id stays null;
whole texts count whatever their length; repeated rows get equal counts; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import lean, slices, written

BLOCK_BYTES = 8 << 20
RANGE_WORDS = 200_000
LIMIT = 2048
#: Below this code point normal form C changes nothing, and classes are listed here.
_PLAIN = "ɐ"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_BLANKS = "\t-\r\x20\x85\xa0"
_OTHER_TEXT = re.compile(f"[^\x00-{chr(ord(_PLAIN) - 1)}]")
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
#: The layout of tokenizer files that ``pre_tokens`` knows.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def pre_tokenizer(path: str) -> Callable[[str], tuple[list[str], int]]:
    """A function from a text to its pre-tokens and its number of special strings."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        layout = json.load(f)
    steps = layout["pre_tokenizer"]["pretokenizers"]
    known = [x["type"] for x in layout["normalizer"]["normalizers"]] == _NORMALIZERS and steps[0]["pattern"] == {"Regex": _SPLIT} and [x["type"] for x in steps] == ["Split", "ByteLevel"]
    added = layout["added_tokens"]
    if not known or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        raise ValueError(f"{path}: a tokenizer of another layout")
    library = Tokenizer.from_file(path)
    special = re.compile("|".join(re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None
    marker = "<|" if all(x["content"].startswith("<|") for x in added) else ""

    def cut(text: str) -> list[str]:
        if _OTHER_TEXT.search(text):
            normal = library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(normal)]
        return _PRE_TOKEN.findall(text.lower())

    def run(text: str) -> tuple[list[str], int]:
        if special is None or marker not in text:
            return cut(text), 0
        parts = special.split(text)
        return [w for p in parts for w in cut(p)], len(parts) - 1

    return run


def _planes(x: np.ndarray) -> bytes:
    """Integers below 2**32 as byte planes, which compress well."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _from_planes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Documents so far, their rows over the block's distinct pre-tokens."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.special: list[int] = []
        self.words = _Ids()
        self.index: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bytes = 0

    def add(self, key: int | None, text: str, cut: Callable[[str], tuple[list[str], int]]) -> None:
        found, special = cut(text)
        index, times = np.unique(np.fromiter(map(self.words.__getitem__, found), np.int64, len(found)), return_counts=True)
        size = len(text) if text.isascii() else len(text.encode())
        self.ids.append(key)
        self.sizes.append(size)
        self.special.append(special)
        self.index.append(index)
        self.times.append(times)
        self.bytes += size

    def row(self, block: int) -> pa.RecordBatch:
        """Words in order of their hash; rows as steps between word positions."""
        words = [w.encode() for w in self.words]
        hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        steps, times = [], []
        for index, n in zip(self.index, self.times, strict=True):
            at = place[index]
            by = np.argsort(at, kind="stable")
            steps.append(np.diff(at[by], prepend=0))
            times.append(n[by])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.record_batch(
            [
                pa.array([block], pa.int64()),
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([self.sizes], pa.list_(pa.int64())),
                pa.array([self.special], pa.list_(pa.int64())),
                pa.array([[len(x) for x in self.index]], pa.list_(pa.int64())),
                pa.array([_planes(join(steps))], pa.binary()),
                pa.array([_planes(join(times))], pa.binary()),
                pa.array([len(words)], pa.int64()),
                pa.array([b"\n".join(words[k] for k in order.tolist())], pa.binary()),
            ],
            names=["block", "ids", "sizes", "special", "lengths", "steps", "times", "n_words", "words"],
        )


BLOCK_SCHEMA = "block long, ids array<long>, sizes array<long>, special array<long>, lengths array<long>, steps binary, times binary, n_words long, words binary"


def _to_blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block, n = pre_tokenizer(path), _Block(), 0
        first = TaskContext.get().partitionId() << 32
        for b in slices(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                block.add(key, text or "", cut)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(first + n)
                    block, n = _Block(), n + 1
        if block.ids:
            yield block.row(first + n)

    return run


def _deal(ranges: int):
    """A block's words by range of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not packed:
                    continue
                words = packed.split(b"\n")
                hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
                which = (hashes * np.uint64(ranges)) >> np.uint64(32)
                starts = np.flatnonzero(np.diff(which, prepend=np.uint64(ranges)))
                ends = np.append(starts[1:], len(words))
                parts = [b"\n".join(words[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(which[starts].astype(np.int64)), pa.array([block] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["range", "block", "words"])

    return run


def _count_pieces(path: str):
    held: dict = {}

    def run(t: pa.Table) -> pa.Table:
        if not held:
            from tokenizers import Tokenizer

            held["library"] = Tokenizer.from_file(path)
        parts = [x.split(b"\n") for x in t.column("words").to_pylist()]
        distinct = list({w for p in parts for w in p})
        pieces: dict[bytes, int] = {}
        for i in range(0, len(distinct), 4096):
            some = distinct[i : i + 4096]
            encoded = held["library"].encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            pieces.update(zip(some, map(len, encoded), strict=True))
        counts = [_planes(np.fromiter(map(pieces.__getitem__, p), np.int64, len(p))) for p in parts]
        return pa.table([t.column("range"), t.column("block"), pa.array(counts, pa.binary())], names=["range", "block", "pieces"])

    return run


def _sum(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_tokens"]
    if not blocks.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    order = np.argsort(counts.column("range").to_numpy())
    packed = counts.column("pieces").to_pylist()
    pieces = np.concatenate([np.zeros(0, np.int64), *[_from_planes(packed[k]) for k in order]])
    get = lambda c: blocks.column(c)[0].as_py()
    lengths = np.array(get("lengths"), np.int64)
    steps, times = _from_planes(get("steps")), _from_planes(get("times"))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    run = np.cumsum(steps)
    starts = np.cumsum(lengths) - lengths  # each row's steps start anew
    before = np.concatenate([[0], run])[starts]
    at = run - before[doc]
    tokens = np.bincount(doc, weights=(times * pieces[at]).astype(np.float64), minlength=len(lengths)).astype(np.int64)
    return pa.table([pa.array(get("ids"), pa.int64()), pa.array(get("sizes"), pa.int64()), pa.array(tokens + np.array(get("special"), np.int64))], names=names)


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of each text.

    ``path`` is a tokenizers file that every executor can read.
    """
    blocks = written(df.select(F.col(key).cast("long"), text).mapInArrow(lean(_to_blocks(path)), BLOCK_SCHEMA), "pre-tokens")
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(1, -(-n_words // RANGE_WORDS))
    dealt = blocks.select("block", "words").mapInArrow(_deal(ranges), "range long, block long, words binary")
    counts = dealt.groupBy("range").applyInArrow(_count_pieces(path), "range long, block long, pieces binary")
    rows = blocks.drop("words", "n_words")
    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")


def report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
