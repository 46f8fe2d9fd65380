"""Exact top-k inner-product search by distributed histogram selection.

Every query scores every candidate, in tiles of a block of queries times a
block of candidates.  A first pass counts each query's scores in 512 equal
ranges; the counts of all tasks are added per query and tell which range holds
the kth highest score.  Each further pass counts only that range, 512 times
finer, until ranges hold a single integer.  The last pass keeps the scores
above the kth value, which are fewer than k, and of those that equal it the
smallest ids that are still needed, so ties are broken the same way each time.

Memory is bounded by tiles and by one histogram per query of the blocks that a
task sees; no pass emits more than a histogram per query and task, or k rows
per query and task.  Query blocks are broadcast only under ``BROADCAST_BYTES``;
beyond that queries are dealt out in groups of blocks, which each copy of the
candidates meets.  Quantised vectors are written once for all passes.

Defined cases: vectors that are null, or hold a null or a non-finite
component, and rows with a null id take no part; vectors only meet vectors of
their own length; a repeated candidate row counts each time; of a repeated
query id the greatest vector asks; a query never meets rows of its own id; a
query with fewer than k candidates gets them all; components and scores beyond
the range of a long are held at its ends; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.shared import written

BINS_LOG2 = 9
BINS = 1 << BINS_LOG2
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Query blocks that a copy of the candidates meets.
GROUP = 32
BROADCAST_BYTES = 8 << 20
_MAX = (1 << 63) - 1
_BLOCK = "dim int, ids binary, data binary"


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Columns ``id`` and ``v``: floor(scale * x) of each component as double."""
    x = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return x.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite).select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _blocks(dims: np.ndarray, ids: np.ndarray, flat: np.ndarray, rows: int) -> Iterator[tuple[int, bytes, bytes]]:
    ends = np.cumsum(dims)
    for dim in np.unique(dims):
        which = np.flatnonzero(dims == dim)
        for i in range(0, len(which), rows):
            part = which[i : i + rows]
            at = (ends[part] - dim)[:, None] + np.arange(dim)
            yield int(dim), ids[part].tobytes(), flat[at.ravel()].tobytes()


def _vectors(b: pa.RecordBatch | pa.Table, column: str = "v") -> tuple[np.ndarray, np.ndarray]:
    lists = b.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64), flat


def _pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims, flat = _vectors(b)
        ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        for dim, i, d in _blocks(dims, ids, flat, CANDIDATE_BLOCK):
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([i], pa.binary()), pa.array([d], pa.binary())], names=["dim", "ids", "data"])


def _pack_queries(t: pa.Table) -> pa.Table:
    dims, flat = _vectors(t)
    ids = t.column("id").to_numpy().astype(np.int64)
    lo, need = (t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("lo", "need"))
    return pa.table([pa.array([int(dims[0])], pa.int32()), t.column("qb")[:1], pa.array([ids.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary()), pa.array([lo], pa.binary()), pa.array([need], pa.binary())], names=["dim", "qb", "q_ids", "q_data", "q_lo", "q_need"])


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where all sums are exact, else in integers."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    reach = lambda a: max(abs(int(a.min())), abs(int(a.max())))
    bound = reach(queries) * reach(candidates) * queries.shape[1]
    if bound < 1 << 24:
        return (queries.astype(np.float32) @ candidates.astype(np.float32).T).astype(np.int32)
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    if bound <= _MAX:
        return queries @ candidates.T
    exact = queries.astype(object) @ candidates.astype(object).T
    return np.clip(exact, -_MAX, _MAX).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Query block key, ids, lower ends, needs, candidate ids and scores of each tile; own rows masked."""
    for b in batches:
        for r in range(b.num_rows):
            get = lambda c, b=b, r=r: np.frombuffer(b.column(c)[r].as_buffer(), np.int64)
            dim, qb = b.column("dim")[r].as_py(), b.column("qb")[r].as_py()
            q_ids, c_ids = get("q_ids"), get("ids")
            s = scores(get("q_data").reshape(len(q_ids), dim), get("data").reshape(len(c_ids), dim))
            yield (dim, qb), q_ids, get("q_lo"), get("q_need"), c_ids, s, q_ids[:, None] != c_ids[None, :]


def _bins(s: np.ndarray, lo: np.ndarray, shift: int, wide: bool) -> np.ndarray:
    if wide:  # differences might not fit in 64 bits
        return (s.astype(object) - lo.astype(object)[:, None]) >> shift
    if s.dtype == np.int32 and np.abs(lo).max(initial=0) < 1 << 30:
        lo = lo.astype(np.int32)
    return (s - lo[:, None]) >> shift


def _count(shift: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for key, q_ids, lo, need, _, s, other in _tiles(batches):
            held = sums.setdefault(key, [q_ids.copy(), lo.copy(), need.copy(), np.zeros((len(q_ids), BINS), np.int64)])
            bins = _bins(s, lo, shift, wide)
            row, col = np.nonzero(other & (bins >= 0) & (bins < BINS))
            held[3] += np.bincount(row * BINS + bins[row, col].astype(np.int64), minlength=held[3].size).reshape(held[3].shape)
        for q_ids, lo, need, h in sums.values():
            for i in range(0, len(q_ids), 256):
                part = [pa.array(x[i : i + 256]) for x in (q_ids, lo, need)]
                yield pa.record_batch([*part, pa.array([x.tobytes() for x in h[i : i + 256]], pa.binary())], names=["id", "lo", "need", "h"])

    return run


def _locate(shift: int, last: bool):
    def run(t: pa.Table) -> pa.Table:
        lo, need = t.column("lo")[0].as_py(), t.column("need")[0].as_py()
        h = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("h"))
        above = np.cumsum(h[::-1])[::-1]
        holding = np.flatnonzero(above >= need)
        if len(holding):
            b = int(holding[-1])
            lo, need = lo + (b << shift), need - (int(above[b + 1]) if b + 1 < BINS else 0)
        elif last:  # fewer than k in all: everything is kept
            lo = -_MAX
        return pa.table([t.column("id")[:1], pa.array([lo], pa.int64()), pa.array([need], pa.int64())], names=["id", "lo", "need"])

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ties: dict[tuple[int, int], np.ndarray] = {}
    names = ["id", "vec_id", "score"]
    for _, q_ids, lo, need, c_ids, s, other in _tiles(batches):
        row, col = np.nonzero(other & (s > lo[:, None]))
        if len(row):
            yield pa.record_batch([pa.array(q_ids[row]), pa.array(c_ids[col]), pa.array(s[row, col].astype(np.int64))], names=names)
        equal = other & (s == lo[:, None])
        for r in np.flatnonzero(equal.any(axis=1)):
            key = (int(q_ids[r]), int(lo[r]))
            found = c_ids[equal[r]]
            held = np.concatenate([ties[key], found]) if key in ties else found
            ties[key] = np.sort(held)[: int(need[r])]
    if ties:
        n = [len(x) for x in ties.values()]
        q, v = (np.repeat(np.array([k[i] for k in ties], np.int64), n) for i in (0, 1))
        yield pa.record_batch([pa.array(q), pa.array(np.concatenate(list(ties.values()))), pa.array(v)], names=names)


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k highest integer inner products, ties to smaller ids.

    Both inputs have columns ``id`` and ``v`` as from ``quantised``.  Returns
    query_id, rank (from 1), vec_id and score.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n_queries, q_norm, q_dim = queries.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    n_rows, c_norm = candidates.agg(F.count("*"), F.max(norm)).first()
    reach = min(_MAX, int(math.sqrt((q_norm or 0.0) * (c_norm or 0.0)) * (1 + 1e-9)) + 1)
    rounds = max(1, -(-(2 * reach + 1).bit_length() // BINS_LOG2))
    n_blocks = -(-n_queries // QUERY_BLOCK) or 1
    small = n_queries * (8 * (q_dim or 0) + 24) <= BROADCAST_BYTES
    n_splits = 1 if small else -(-n_rows // (64 * CANDIDATE_BLOCK)) or 1

    packed = written(candidates.mapInArrow(_pack_candidates, _BLOCK), "candidates")  # every round reads them
    n_groups = -(-n_blocks // GROUP)
    dealt = packed.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).withColumn("split", F.pmod(F.xxhash64("ids"), F.lit(n_splits)))
    asked = written(queries.groupBy("id").agg(F.max("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")), "asked")

    def tiles(state: DataFrame) -> DataFrame:
        blocks = state.groupBy(F.size("v").alias("d"), "qb").applyInArrow(_pack_queries, "dim int, qb int, q_ids binary, q_data binary, q_lo binary, q_need binary")
        blocks = blocks.withColumn("qg", F.floor(F.col("qb") / GROUP).cast("int")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)).cast("array<bigint>")))
        return dealt.join(F.broadcast(blocks) if small else blocks, ["dim", "qg", "split"])

    state = asked.select("id", "v", "qb", F.lit(-reach).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))
    for r in range(rounds):
        shift = BINS_LOG2 * (rounds - 1 - r)
        counts = tiles(state).mapInArrow(_count(shift, reach >= 1 << 61), "id long, lo long, need long, h binary")
        found = counts.groupBy("id").applyInArrow(_locate(shift, r == rounds - 1), "id long, lo long, need long")
        state = asked.join(found, "id")
    kept = tiles(state).mapInArrow(_keep, "id long, vec_id long, score long")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
