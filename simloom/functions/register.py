"""The functions under SQL names.

Parameters are arguments as in the column functions; rows are worked on in
groups of equal parameters, so constant ones cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from simloom.functions import base32, codec, pairs, rng
from simloom.functions.fingerprint import simhash_texts
from simloom.functions.profiles import SEED_HASH, FullProfile, HashProfile, HilbertProfile, MortonProfile, Precision, Profile, compressed, cross_dimensional, lossless, max_length
from simloom.functions.vectors import BAND_COUNTS, _id_rows, _rows, hash_bytes

#: Name: parameters, result and body of functions that are plain SQL.
SQL = {
    "normalized_levenshtein": ("a string, b string", "double", "case when greatest(length(a), length(b)) = 0 then 1d else 1d - levenshtein(a, b) / greatest(length(a), length(b)) end"),
    "levenshtein_with_opts": (
        "a string, b string, case_sensitive boolean, trim_whitespace boolean",
        "int",
        r"levenshtein(case when trim_whitespace then regexp_replace(case when case_sensitive then a else lower(a) end, '^\\p{IsWhite_Space}+|\\p{IsWhite_Space}+$', '') else case when case_sensitive then a else lower(a) end end, case when trim_whitespace then regexp_replace(case when case_sensitive then b else lower(b) end, '^\\p{IsWhite_Space}+|\\p{IsWhite_Space}+$', '') else case when case_sensitive then b else lower(b) end end)",
    ),
    "hamming_distance": ("a string, b string", "int", "case when length(a) = length(b) then aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> cast(x <> y as int)), 0, (s, x) -> s + x) end"),
    "normalized_hamming": ("a string, b string", "double", "case when length(a) = 0 and length(b) = 0 then 1d when length(a) = length(b) then 1d - aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> cast(x <> y as int)), 0, (s, x) -> s + x) / length(a) end"),
    "simhash_distance": ("a bigint, b bigint", "int", "bit_count(a ^ b)"),
    "hash_similarity": ("a bigint, b bigint", "double", "1d - bit_count(a ^ b) / 64d"),
    "find_similar_hashes": ("query bigint, hashes array<bigint>, most int", "array<int>", "filter(transform(hashes, (h, i) -> case when bit_count(h ^ query) <= most then i end), i -> i is not null)"),
    "vector_hash_distance": ("a struct<hi: bigint, lo: bigint>, b struct<hi: bigint, lo: bigint>", "int", "bit_count(a.hi ^ b.hi) + bit_count(a.lo ^ b.lo)"),
    "cosine_linear": ("distance int", "float", "cast(1 - distance / 128d * pi() as float)"),
    "cosine_estimate": ("distance int", "double", "cos(distance / 128d * pi())"),
    "shared_bands": ("a array<string>, b array<string>", "int", "size(filter(a, x -> array_contains(b, x)))"),
    "is_reversible_id": ("t string", "boolean", "coalesce(t rlike '^[0-9a-v]{4,}$' and pmod(floor(cast(conv(substr(t, 1, 2), 32, 10) as int) / 4), 16) = 4, false)"),
}
_SCORED = StructType([StructField("index", IntegerType()), StructField("score", DoubleType())])
_METADATA = "original_dims int, encoded_dims int, is_lossless boolean, has_dimension_reduction boolean, precision string, precision_bits int, dimension_mode string"


def _best(a: list, b: list) -> np.ndarray:
    """Greater of normalised Levenshtein and Jaro-Winkler; NaN for null pairs."""
    longest = np.array([max(len(x), len(y)) if x is not None and y is not None else 1 for x, y in zip(a, b, strict=True)], float)
    d = pairs.levenshtein_distances(a, b)
    nl = np.where(longest == 0, 1.0, 1 - d / np.maximum(longest, 1))
    return np.where(d < 0, np.nan, np.fmax(nl, pairs.prefix_bonus(pairs.jaro_scores(a, b), a, b, 0.1)))


def _groups(*parameters: pa.Array) -> Iterator[tuple[tuple, np.ndarray]]:
    """Equal parameters and the rows that have them; rows with a null one are left out."""
    rows: dict[tuple, list[int]] = {}
    for k, p in enumerate(zip(*(c.to_pylist() for c in parameters), strict=True)):
        if None not in p:
            rows.setdefault(p, []).append(k)
    for p, at in rows.items():
        yield p, np.array(at)


def _encoder(profile_of: Callable[..., Profile]) -> Callable:
    """IDs under the profile that a size and further arguments give; null where there is none."""

    def run(vectors: pa.Array, *parameters: pa.Array) -> pa.Array:
        out = np.full(len(vectors), None, object)
        for p, at in _groups(*parameters) if parameters else [((), np.arange(len(vectors)))]:
            for some, m in _rows(vectors.take(pa.array(at)), True, False):
                profile = profile_of(m.shape[1], *p)
                if isinstance(profile, FullProfile):
                    profile.dimensions.check(m.shape[1])
                out[at[some]] = base32.encode_rows(_id_rows(m, profile))
        return pa.array(out, pa.string())

    return run


def precision_of(name: str) -> Precision:
    """``full32``, ``half16``, ``quant8`` or ``bits`` with a number."""
    return Precision("bits", int(name[4:])) if name.startswith("bits") else Precision(name)


class ExplodeBands:
    """band_idx and band of a vector: a table function for lateral joins."""

    def eval(self, vector: list, bands: int = 4, seed: int = SEED_HASH):
        if vector is None or bands not in BAND_COUNTS:
            return
        data, size = hash_bytes(np.asarray([vector], np.float32), seed)[0].tobytes(), 16 // bands
        for k in range(bands):
            yield k, base32.encode(data[k * size : (k + 1) * size])


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to ``spark.sql``; returns their names."""
    for name, (parameters, result, body) in SQL.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")

    def scores(work: Callable[[list, list], np.ndarray]) -> Callable:
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            found = work(a.to_pylist(), b.to_pylist()).astype(float)
            return pa.array(found, mask=np.isnan(found))

        return run

    def osa_distance(a: pa.Array, b: pa.Array) -> pa.Array:
        d = pairs.osa_distances(a.to_pylist(), b.to_pylist())
        return pa.array(d, pa.int32(), mask=d < 0)

    def normalized_osa(a: list, b: list) -> np.ndarray:
        d = pairs.osa_distances(a, b)
        longest = np.array([max(len(x or ""), len(y or "")) for x, y in zip(a, b, strict=True)], float)
        return np.where(d < 0, np.nan, np.where(longest == 0, 1.0, 1 - d / np.maximum(longest, 1)))

    def winkler_with(a: pa.Array, b: pa.Array, scale: pa.Array) -> pa.Array:
        x, y = a.to_pylist(), b.to_pylist()
        jaro, out = pairs.jaro_scores(x, y), np.full(len(a), np.nan)
        for (s,), at in _groups(scale):
            out[at] = pairs.prefix_bonus(jaro[at], [x[k] for k in at], [y[k] for k in at], s)
        return pa.array(out, mask=np.isnan(out))

    def simhash(a: pa.Array) -> pa.Array:
        known = a.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(a), np.int64)
        out[known] = simhash_texts(a.filter(pa.array(known)).to_pylist()).view(np.int64)
        return pa.array(out, mask=~known)

    def simhash_similarity(a: list, b: list) -> np.ndarray:
        x, y = (simhash_texts([t or "" for t in side]) for side in (a, b))
        missing = np.array([s is None or t is None for s, t in zip(a, b, strict=True)], bool)
        return np.where(missing, np.nan, 1 - np.bitwise_count(x ^ y) / 64.0)

    def each_of(query: pa.Array, candidates: pa.Array) -> list:
        """Scores of every query's candidates, null where either is."""
        asked, lists = query.to_pylist(), candidates.to_pylist()
        flat = [(q, c) for q, cs in zip(asked, lists, strict=True) if q is not None and cs is not None for c in cs]
        found, at, out = _best([q for q, _ in flat], [c for _, c in flat]), 0, []
        for q, cs in zip(asked, lists, strict=True):
            if q is None or cs is None:
                out.append(None)
                continue
            out.append(found[at : at + len(cs)])
            at += len(cs)
        return out

    def find_best_match(query: pa.Array, candidates: pa.Array) -> pa.Array:
        """Of equal scores the last candidate; index null and score 0 without any."""
        rows = []
        for s in each_of(query, candidates):
            known = [] if s is None else np.flatnonzero(~np.isnan(s))
            k = max(known, key=lambda i: (s[i], i)) if len(known) else None
            rows.append(None if s is None else {"index": None if k is None else int(k), "score": 0.0 if k is None else float(s[k])})
        return pa.array(rows, pa.struct([("index", pa.int32()), ("score", pa.float64())]))

    def find_matches_above_threshold(query: pa.Array, candidates: pa.Array, least: pa.Array) -> pa.Array:
        rows = [None if s is None or t is None else [{"index": int(k), "score": float(s[k])} for k in np.flatnonzero(s >= t)] for s, t in zip(each_of(query, candidates), least.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("index", pa.int32()), ("score", pa.float64())])))

    def decode_id(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else base32.decode(x) for x in t.to_pylist()], pa.binary())

    def decode_vector(t: pa.Array) -> pa.Array:
        found = [None if x is None else codec.decoded(base32.decode(x)) for x in t.to_pylist()]
        return pa.array([None if x is None else x.tolist() for x in found], pa.list_(pa.float32()))

    def id_distance(a: pa.Array, b: pa.Array) -> pa.Array:
        """Null unless both are hash IDs."""
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            u, v = (None if t is None else base32.decode(t) for t in (x, y))
            good = all(d is not None and len(d) == 18 and d[0] & 15 == HashProfile.type_id for d in (u, v))
            out.append((int.from_bytes(u[2:], "big") ^ int.from_bytes(v[2:], "big")).bit_count() if good else None)
        return pa.array(out, pa.int32())

    def id_metadata(s: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in _METADATA.split(", ")]
        rows = [(None if t is None else codec.metadata(base32.decode(t))) or dict.fromkeys(names) for t in s]
        return pd.DataFrame(rows, columns=names).astype("object")

    def vector_bands(vectors: pa.Array, bands: pa.Array, seed: pa.Array) -> pa.Array:
        out = np.full(len(vectors), None, object)
        for (n, s), at in _groups(bands, seed):
            for some, m in _rows(vectors.take(pa.array(at)), False, False):
                size = 16 // n if n in BAND_COUNTS else 0
                texts = [base32.encode_rows(hash_bytes(m, s)[:, k * size : (k + 1) * size]) for k in range(n if size else 0)]
                for i, k in enumerate(at[some].tolist()):
                    out[k] = [t[i] for t in texts]
        return pa.array(out.tolist(), pa.list_(pa.string()))

    def best_match_agg(query: pd.Series, candidate: pd.Series) -> str:
        """Of a group's candidates the one that matches best; of equal ones the greatest."""
        s = _best(query.tolist(), candidate.tolist())
        known = [k for k in range(len(s)) if s[k] == s[k]]
        return max(((s[k], candidate.iloc[k]) for k in known), default=(0.0, None))[1]

    rng.hyperplanes(HashProfile().seed, 64)
    batched = {
        "osa_distance": (osa_distance, "int"),
        "normalized_osa": (scores(normalized_osa), "double"),
        "jaro": (scores(pairs.jaro_scores), "double"),
        "jaro_winkler": (scores(lambda a, b: pairs.prefix_bonus(pairs.jaro_scores(a, b), a, b, 0.1)), "double"),
        "jaro_winkler_with_prefix": (winkler_with, "double"),
        "best_match": (scores(_best), "double"),
        "find_best_match": (find_best_match, _SCORED),
        "find_matches_above_threshold": (find_matches_above_threshold, ArrayType(_SCORED)),
        "simhash": (simhash, "long"),
        "simhash_similarity": (scores(simhash_similarity), "double"),
        "encode_hash": (_encoder(lambda n: HashProfile()), "string"),
        "encode_morton": (_encoder(lambda n, dims, bits: MortonProfile(dims, bits)), "string"),
        "encode_hilbert": (_encoder(lambda n, dims, bits: HilbertProfile(dims, bits)), "string"),
        "encode_lossless": (_encoder(lambda n: lossless()), "string"),
        "encode_full": (_encoder(lambda n, precision: FullProfile(precision_of(precision))), "string"),
        "encode_compressed": (_encoder(lambda n, retention: compressed(retention, n)), "string"),
        "encode_max_length": (_encoder(lambda n, chars: max_length(chars, n)), "string"),
        "encode_cross_dimensional": (_encoder(lambda n, target: cross_dimensional(target)), "string"),
        "decode_id": (decode_id, "binary"),
        "decode_vector": (decode_vector, "array<float>"),
        "id_distance": (id_distance, "int"),
        "vector_bands": (vector_bands, "array<string>"),
    }
    for name, (f, kind) in batched.items():
        spark.udf.register(name, F.arrow_udf(f, kind))
    spark.udf.register("id_metadata", F.pandas_udf(id_metadata, _METADATA))
    spark.udf.register("best_match_agg", F.pandas_udf(best_match_agg, "string"))
    spark.udtf.register("explode_bands", F.udtf(ExplodeBands, returnType="band_idx int, band string"))
    return [*SQL, *batched, "id_metadata", "best_match_agg", "explode_bands"]
