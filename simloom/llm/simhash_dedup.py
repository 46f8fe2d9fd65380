"""Near duplicates by SimHash and the generalised pigeonhole principle.

A fingerprint has 64 bits, each set if it is in over half of the XXH64 values
of the text's word shingles.  Texts link where at most ``threshold`` bits
differ; components of links are groups of near duplicates.

Search: bits are grouped into partitions, correlated bits together, so that
values of other partitions stay spread out.  If partition i is given threshold
t_i and the sum of all t_i + 1 is threshold + 1, any pair that links is within
t_i in some partition (a partition with t_i = -1 isn't searched).  The number
of pairs within t of each other in a partition is estimated from the joint
counts of all bit pairs over all fingerprints, by a tree of the strongest
dependences; dynamic programming over the partitions then allocates the
thresholds with the least estimated candidates and probes.  Each fingerprint
probes its partitions with all flips of up to t_i bits, and what meets is
verified on all bits.

Only distinct fingerprints are searched, so a group of copies is one node.  A
bucket of over ``HOT`` fingerprints isn't paired off: its members are dealt
out again by their values with some bits flipped, up to half of the threshold,
and once more rounded up where it is odd.  Any two within the threshold share a
value of these two kinds, and any two that do are within it, so linking each to
the least of its value (of the first kind) loses no link, adds none, and gives
at most as many as values.

Defined cases: null and empty texts have fingerprint zero and link like any
other; texts of fewer words than a shingle are one shingle; null ids take part
but never name a component unless all its ids are null; repeated rows get
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.components import roots
from simloom.llm.shared import dropped, free_name, lean, slices, written
from simloom.llm.shingle_join import marked_sets, similar_links

BITS = 64
HOT = 64
#: A probe's cost in verified candidates.
PROBE_COST = 4.0
_FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(raw: bytes, words: int = 3) -> int:
    """SimHash of a text's bytes; ASCII letters lower, ASCII white space between words."""
    found = raw.lower().split()
    if not found:
        return 0
    grams = zip(*(found[k:] for k in range(words)), strict=False) if len(found) > words else [found]
    digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, grams), repeat(42)))
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(votes).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """SimHash, signed, of digests that are given as longs; of none, zero."""
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(votes).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a long of the same bits."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", words) for t in raw], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["k", "fp"])

    return df.select(F.col(key).alias("k"), text).mapInArrow(lean(run), f"k {kind}, fp long").withColumnRenamed("k", key)


# planning


def joint_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and of those in which bits i and j are both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
            n += len(fp)
        flat = np.append(total.ravel(), n)
        yield pa.record_batch([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.int64))], names=["at", "n"])

    rows = nodes.select("fp").mapInArrow(lean(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlations(n: int, both: np.ndarray) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width, grown from their most correlated bits."""
    left, parts = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        c = corr[np.ix_(left, left)] - 2 * np.eye(len(left))
        part = [left.pop(int(c.sum(axis=1).argmax()))]
        while len(part) < width:
            near = corr[np.ix_(left, part)].sum(axis=1)
            part.append(left.pop(int(near.argmax())))
        parts.append(sorted(part))
    return parts


def near_probability(bits: list[int], n: int, both: np.ndarray, corr: np.ndarray, most: int) -> np.ndarray:
    """Chance that two independent fingerprints differ in exactly 0..most of ``bits``.

    The bits' joint distribution is a tree of the strongest correlations;
    messages carry, for each pair of values of a bit in the two fingerprints,
    the chance of each number of differences below it.
    """
    p1 = (np.diag(both) + 0.5) / (n + 1)
    children: dict[int, list[int]] = {b: [] for b in bits}
    inside, order = [bits[0]], []
    while len(inside) < len(bits):
        outside = [b for b in bits if b not in inside]
        c = corr[np.ix_(inside, outside)]
        i, j = np.unravel_index(int(c.argmax()), c.shape)
        children[inside[i]].append(outside[j])
        order.append((inside[i], outside[j]))
        inside.append(outside[j])

    def given(parent: int, child: int) -> np.ndarray:
        """Row: parent's value; column: child's."""
        a, b, ab = p1[parent], p1[child], min(both[parent, child] / max(n, 1), p1[parent], p1[child])
        joint = np.maximum([[1 - a - b + ab, b - ab], [a - ab, ab]], 1e-12)
        return joint / joint.sum(axis=1, keepdims=True)

    up: dict[int, np.ndarray] = {}
    for b in reversed(inside):
        m = np.zeros((2, 2, most + 1))
        m[0, 0, 0] = m[1, 1, 0] = 1
        if most:
            m[0, 1, 1] = m[1, 0, 1] = 1
        for c in children[b]:
            g = given(b, c)
            below = np.einsum("xu,yv,uvt->xyt", g, g, up[c])
            joined = np.zeros_like(m)
            for t in range(most + 1):
                for s in range(most + 1 - t):
                    joined[:, :, t + s] += m[:, :, t] * below[:, :, s]
            m = joined
        up[b] = m
    root = np.array([1 - p1[bits[0]], p1[bits[0]]])
    return np.einsum("x,y,xyt->t", root, root, up[bits[0]])


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i from -1 with sum of t_i + 1 = total and least cost.

    ``costs[i][t + 1]`` is the cost of threshold t in partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t, extra in enumerate(cost):
                if spent + t <= total:
                    step[spent + t] = min(step.get(spent + t, (float("inf"), [])), (c + extra, [*chosen, t - 1]))
        best = step
    return best[total]


def plan(n: int, both: np.ndarray, threshold: int) -> list[tuple[list[int], int]]:
    """Partitions to search, each with its threshold."""
    corr, found = correlations(n, both), []
    for m in range(1, threshold + 3):
        parts, costs = group_bits(corr, m), []
        for bits in parts:
            near = np.cumsum(near_probability(bits, n, both, corr, threshold)) * n * max(n - 1, 0) / 2
            probes = np.cumsum([len(list(combinations(range(len(bits)), t))) for t in range(threshold + 1)])
            costs.append([0.0, *(float(near[t] + PROBE_COST * n * probes[t]) for t in range(threshold + 1))])
        cost, chosen = allocate(costs, threshold + 1)
        found.append((cost, m, [(b, t) for b, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


# search


def _flips(bits: list[int], most: int) -> list[int]:
    return [signed(sum(1 << b for b in c)) for t in range(most + 1) for c in combinations(bits, t)]


def _bucket_links(threshold: int):
    """Verified links of whole small buckets, as a forest of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for bucket in b.column(0).to_pylist():
                fp = np.unique(np.array(bucket, np.int64)).view(np.uint64)
                near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= threshold
                unseen = set(range(len(fp)))
                while unseen:
                    todo = [unseen.pop()]
                    while todo:
                        k = todo.pop()
                        for j in np.flatnonzero(near[k]).tolist():
                            if j in unseen:
                                unseen.discard(j)
                                todo.append(j)
                                us.append(fp[k])
                                vs.append(fp[j])
            yield pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return run


def links(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """``u``, ``v``: links that join all fingerprints ``fp`` within ``threshold``
    bits of each other, directly or through others."""
    n, both = joint_counts(nodes)
    chosen = plan(n, both, threshold)
    probes = None
    for i, (bits, t) in enumerate(chosen):
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        flips = F.array(*[F.lit(f).cast("long") for f in _flips(bits, t)])
        one = nodes.select(F.lit(i).alias("part"), "fp", F.explode(flips).alias("flip")).select("part", "fp", own.bitwiseXOR(F.col("flip")).alias("sig"))
        probes = one if probes is None else probes.unionAll(one)
    sizes = probes.groupBy("part", "sig").agg(F.count("*").alias("c")).where("c > 1")
    met = written(probes.join(sizes, ["part", "sig"]), "buckets")
    small = met.where(F.col("c") <= HOT).groupBy("part", "sig").agg(F.collect_list("fp").alias("bucket")).select("bucket")
    found = small.mapInArrow(_bucket_links(threshold), "u long, v long")
    for i, (bits, t) in enumerate(chosen):
        other = [b for b in range(BITS) if t or b not in bits]
        hot = met.where((F.col("c") > HOT) & (F.col("part") == i)).select("fp")

        def dealt(most: int, hot: DataFrame = hot, other: list[int] = other) -> DataFrame:
            flips = F.array(*[F.lit(f).cast("long") for f in _flips(other, most)])
            return hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")).distinct()

        keys = dealt(-(-threshold // 2))
        fewer = keys if threshold % 2 == 0 else dealt(threshold // 2)
        least = fewer.groupBy("near").agg(F.min("fp").alias("m"), F.count("*").alias("c"))
        least = least.where("c > 1").select("near", "m") if threshold % 2 == 0 else least.select("near", "m")
        found = found.unionAll(keys.join(least, "near").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct())
    return found


def _named(marked: DataFrame, nodes: DataFrame, stars: DataFrame, key: str) -> DataFrame:
    member = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = member.select("fp", "root").join(names, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(key, "fp", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 2, words: int = 3) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the least key reachable over links."""
    marked = written(fingerprints(df, key, text, words), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    return _named(marked, nodes, roots(links(nodes, threshold)), key)


def probable(marked: DataFrame, threshold: int) -> DataFrame:
    """``u``, ``v``: pairs of sets that join all whose SimHashes are within
    ``threshold`` bits, found as ``links`` finds them."""
    firsts = written(marked.groupBy("simhash").agg(F.min("fp").alias("first")), "firsts")
    near = links(firsts.select(F.col("simhash").alias("fp")), threshold)
    first = [firsts.select(F.col("simhash").alias(e), F.col("first").alias(f"first_{e}")) for e in "uv"]
    across = near.join(first[0], "u").join(first[1], "v").select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))
    return across.unionAll(marked.select("simhash", "fp").join(firsts, "simhash").where("fp <> first").select("fp", "first").distinct())


def similar_texts(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, threshold: int = 2) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` of texts whose shingle sets are at least that similar (Jaccard).

    SimHash finds the pairs within ``threshold`` bits, which are checked on the
    whole sets; similar sets that are further apart are joined by their rarer
    shingles, see ``shingle_join``, which leaves out none.  ``fp`` names the set.
    """
    marked = written(marked_sets(df, key, text, words, similarity, majority), "sets")
    nodes = written(marked.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    near = similar_links(marked, df.select(F.col(text).alias("text")), words, similarity, probable(marked, threshold))
    tops = roots(reduce(DataFrame.unionAll, near))
    dropped(*near)
    return _named(marked, nodes, tops, key)


def report(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    found = near_duplicates(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` that name their component: one document of each group.

    Of rows that repeat that key one stays.  All columns are returned.
    """
    k, n, r = (free_name(df, name) for name in ("head", "copies", "row"))
    found = similar_texts(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", words, similarity)
    heads = found.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy(F.col("key").alias(k)).agg(F.count("*").alias(n))
    kept = df.join(heads, df[key].eqNullSafe(heads[k]))
    once = kept.where(F.col(n) == 1).drop(k, n)
    row = F.struct(*[df[c] for c in df.columns])
    again = kept.where(F.col(n) > 1).groupBy(k).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(r))
    return once.unionAll(again.select(*[F.col(r)[c].alias(c) for c in df.columns]))
