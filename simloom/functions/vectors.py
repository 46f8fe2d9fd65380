"""Vector hashes, sortable IDs, bands and vector arithmetic as columns.

A 128-bit hash is a struct of two longs, ``hi`` and ``lo``, so distances are
built-in expressions.  Rows that can't be encoded (null, wrong size, a
component that isn't finite) give null, or an error with ``strict``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from simloom.functions import base32, codec, curves, rng
from simloom.functions.profiles import MAX_DIMS, MIN_DIMS, SEED_HASH, CurveProfile, FullProfile, HashProfile, MortonProfile, Profile

BAND_COUNTS = (1, 2, 4, 8, 16)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_floats(v: Column | str) -> Column:
    return _col(v).cast("array<float>")


def is_vector(v: Column | str) -> Column:
    """64 to 2048 finite components; null is none."""
    v = _col(v)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(v).between(MIN_DIMS, MAX_DIMS) & ~odd, F.lit(False))


def norm(v: Column | str) -> Column:
    """Euclidean length, summed as floats in order."""
    squares = F.aggregate(as_floats(v), F.lit(0.0).cast("float"), lambda s, x: (s + x * x).cast("float"))
    return F.sqrt(squares).cast("float")


def normalized(v: Column | str) -> Column:
    """To length one; a zero vector stays as it is."""
    return F.element_at(
        F.transform(F.array(F.struct(as_floats(v).alias("v"), norm(v).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: (x / s["n"]).cast("float"))).otherwise(s["v"])), 1
    )


def dot(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of normalised vectors."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def truncated(v: Column | str, n: int) -> Column:
    """The first n components, normalised again."""
    return normalized(F.slice(as_floats(v), 1, n))


def coordinates(v: Column | str, dims: int = 10, bits: int = 10) -> Column:
    """The first components of a normalised vector from [-1, 1] to integers, halves up."""
    most = float((1 << bits) - 1)
    scaled = lambda x: (((x + F.lit(1.0).cast("float")) / F.lit(2.0).cast("float")).cast("float") * F.lit(most).cast("float")).cast("float")
    return F.transform(F.slice(as_floats(v), 1, dims), lambda x: F.greatest(F.lit(0), F.least(F.lit(int(most)), F.floor(scaled(x).cast("double") + 0.5).cast("int"))))


def morton_id(v: Column | str, dims: int = 10, bits: int = 10) -> Column:
    """The Z-order ID in built-in expressions only."""
    MortonProfile(dims, bits)
    n_bytes = -(-dims * bits // 8)
    header = "".join(f"{x:08b}" for x in MortonProfile(dims, bits).header(dims))
    n_chars = -(-(len(header) + 8 * n_bytes) // 5)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  computed once, used often

    def planes(rows: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.lit(bits)), lambda b: F.array_join(F.transform(rows, lambda s: s.substr(b, F.lit(1))), ""))
        return F.concat(F.lit(header), F.lpad(F.array_join(each, ""), 8 * n_bytes, "0"))

    def chars(whole: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_chars - 1)), lambda k: F.lower(F.conv(F.rpad(whole.substr(k * 5 + 1, F.lit(5)), 5, "0"), 2, 32))), "")

    # the length of the vector once, then its first components, their bits and the text
    scaled = let(norm(v), lambda n: F.transform(F.slice(as_floats(v), 1, dims), lambda x: F.when(n > 0, (x / n).cast("float")).otherwise(x)))
    rows = F.reverse(F.transform(coordinates(scaled, dims, bits), lambda x: F.lpad(F.bin(x), bits, "0")))
    return F.when(is_vector(v), let(let(rows, planes), chars))


# kernels over vectors of any size


def _rows(column: pa.Array, check: bool, strict: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of an Arrow column by size: positions and a matrix; null and, with ``check``, bad ones are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    good = np.ones(len(column), bool) if not column.null_count else ~column.is_null().to_numpy(zero_copy_only=False)
    values = column.values.cast(pa.float32()).to_numpy(zero_copy_only=False)  # null components become NaN
    if check:
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        fits = (sizes >= MIN_DIMS) & (sizes <= MAX_DIMS)
        finite = odd[offsets[1:]] == odd[offsets[:-1]]
        if strict and not (fits & finite)[good].all():
            raise ValueError("a vector of wrong size" if not fits[good].all() else "a component that isn't finite")
        good &= fits & finite
    out = []
    for size in np.unique(sizes[good]).tolist():
        at = np.flatnonzero(good & (sizes == size))
        out.append((at, values[offsets[at][:, None] + np.arange(size)]))
    return out


def _texts(column: pa.Array, work: Callable[[np.ndarray], np.ndarray], strict: bool = False) -> pa.Array:
    """Base32 of the bytes that ``work`` makes of vectors of one size."""
    out = np.full(len(column), None, object)
    for at, m in _rows(column, True, strict):
        out[at] = base32.encode_rows(work(m))
    return pa.array(out, pa.string())


def _unit(v: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v), np.float32)
    for j in range(v.shape[1]):
        total += v[:, j] * v[:, j]
    length = np.sqrt(total)
    return np.where(length[:, None] > 0, v / np.where(length > 0, length, 1)[:, None], v).astype(np.float32)


def _unit_start(v: np.ndarray, dims: int) -> np.ndarray:
    """The first components of ``_unit``."""
    total = np.zeros(len(v), np.float32)
    for j in range(v.shape[1]):
        total += v[:, j] * v[:, j]
    length = np.sqrt(total)
    return (v[:, :dims] / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def hash_bytes(v: np.ndarray, seed: int = SEED_HASH) -> np.ndarray:
    """16 bytes each; bit i, from the lowest, is the sign of projection i."""
    positive = rng.sequential_dot(v, rng.hyperplanes(seed, v.shape[1])) > 0
    return np.packbits(positive[:, ::-1], axis=1)


def id_bytes(v: np.ndarray, profile: Profile) -> list[bytes]:
    """Header and payload of each vector."""
    if isinstance(profile, FullProfile):
        return codec.encoded(v, profile)
    return [r.tobytes() for r in _id_rows(v, profile)]


def _id_rows(v: np.ndarray, profile: Profile) -> np.ndarray:
    """Rows of bytes: header and payload; all IDs of a profile and size are equally long."""
    if isinstance(profile, FullProfile):
        found = codec.encoded(v, profile)
        return np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1)
    head = profile.header(v.shape[1])
    if isinstance(profile, HashProfile):
        data = hash_bytes(_unit(v), profile.seed)
    else:
        points = curves.quantised(_unit_start(v, profile.dims), profile.dims, profile.bits_per_dim)
        make = curves.morton_bits if isinstance(profile, MortonProfile) else curves.hilbert_bits
        data = curves.to_bytes(make(points, profile.bits_per_dim))
    return np.concatenate([np.broadcast_to(np.frombuffer(head, np.uint8), (len(v), len(head))), data], axis=1)


def encode_id(v: Column | str, profile: Profile | None = None, strict: bool = False) -> Column:
    """The ID of a vector under a profile."""
    profile = profile or HashProfile()
    if isinstance(profile, HashProfile):
        rng.hyperplanes(profile.seed, MIN_DIMS)

    def run(a: pa.Array) -> pa.Array:
        return _texts(a, lambda m: _id_rows(m, profile), strict)

    return F.arrow_udf(run, "string")(as_floats(v))


def decode_id(text: Column | str) -> Column:
    """Header and payload bytes; null if it isn't base32."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else base32.decode(t) for t in s], dtype="object")

    return F.pandas_udf(run, "binary")(text)


def decode_vector(text: Column | str) -> Column:
    """The vector of a reversible ID, null of others."""

    def run(s: pd.Series) -> pd.Series:
        found = [None if t is None else codec.decoded(base32.decode(t)) for t in s]
        return pd.Series([None if x is None else x.tolist() for x in found], dtype="object")

    return F.pandas_udf(run, "array<float>")(text)


def id_metadata(text: Column | str) -> Column:
    schema = "original_dims int, encoded_dims int, is_lossless boolean, has_dimension_reduction boolean, precision string, precision_bits int, dimension_mode string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None if t is None else codec.metadata(base32.decode(t))) or dict.fromkeys(names) for t in s]
        return pd.DataFrame(rows, columns=names).astype("object")

    found = F.pandas_udf(run, schema)(text)
    return F.when(is_reversible(text), found)


def is_reversible(text: Column | str) -> Column:
    """Whether the header's type is the full vector; null and what isn't base32 are not."""
    text = _col(text)
    # 16 header bits are three characters and the top bit of the fourth; the type is the low half of byte 0
    kind = F.conv(F.substring(text, 1, 2), 32, 10).cast("int")
    return F.coalesce(base32.is_valid(text) & (F.length(text) >= 4) & (F.pmod(F.floor(kind / 4), F.lit(16)) == 4), F.lit(False))


def id_profile(text: Column | str) -> Column:
    """The profile's name by the header: hash, morton, hilbert or full; null of what is no ID.

    Lengths are checked: 18 bytes of a hash, at least three of a curve, at
    least 12 of a full vector.
    """
    text = _col(text)
    size = F.floor(F.length(text) * 5 / 8)
    kind = F.pmod(F.floor(F.conv(F.substring(text, 1, 2), 32, 10).cast("int") / 4), F.lit(16))
    name = F.when((kind == 1) & (size == 18), "hash").when((kind == 2) & (size >= 3), "morton").when((kind == 3) & (size >= 3), "hilbert").when((kind == 4) & (size >= 12), "full")
    return F.when(base32.is_valid(text) & (F.length(text) >= 4) & ~F.pmod(F.length(text), F.lit(8)).isin(1, 3, 6), name)


def profile_prefix(profile: Profile) -> str:
    """What all IDs of a profile begin with; prefix scans put it before their own."""
    head = profile.header(MIN_DIMS)[:2]
    return base32.encode(head)[:3]


def vector_hash(v: Column | str, seed: int = SEED_HASH, checked: bool = False, unit: bool = False) -> Column:
    """struct(hi, lo) of the hash of the vector as it is, any size."""

    def run(a: pa.Array) -> pa.Array:
        words, none = np.zeros((len(a), 2), np.int64), np.ones(len(a), bool)
        for at, m in _rows(a, checked, False):
            found = np.ascontiguousarray(hash_bytes(_unit(m) if unit else m, seed))
            words[at], none[at] = found.view(">i8"), False
        return pa.StructArray.from_arrays([pa.array(words[:, k].copy(), mask=none) for k in (0, 1)], ["hi", "lo"])

    return F.arrow_udf(run, "hi long, lo long")(as_floats(v))


def hash_of_id(text: Column | str) -> Column:
    """struct(hi, lo) of a hash profile's ID, null of other IDs."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            data = None if t is None else base32.decode(t)
            good = data is not None and len(data) == 18 and data[0] & 15 == HashProfile.type_id
            rows.append(tuple(np.frombuffer(data[2:], ">i8").tolist()) if good else (None, None))
        return pd.DataFrame(rows, columns=["hi", "lo"]).astype("Int64")

    return F.pandas_udf(run, "hi long, lo long")(text)


def hash_distance(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))


def id_distance(a: Column | str, b: Column | str) -> Column:
    return hash_distance(hash_of_id(a), hash_of_id(b))


def hash_to_bytes(h: Column | str) -> Column:
    h = _col(h)
    return F.unhex(F.concat(F.lpad(F.hex(h["hi"]), 16, "0"), F.lpad(F.hex(h["lo"]), 16, "0")))


def hash_from_bytes(b: Column | str) -> Column:
    """Null unless it has 16 bytes."""
    b = _col(b)
    word = lambda start: F.conv(F.hex(F.substring(b, start, 8)), 16, -10).cast("long")
    return F.when(F.length(b) == 16, F.struct(word(1).alias("hi"), word(9).alias("lo")))


def cosine_linear(distance: Column | str) -> Column:
    """1 - pi * share of differing bits: a straight line from 1 down to 1 - pi."""
    return (1 - _col(distance) / 128.0 * math.pi).cast("float")


def cosine_estimate(distance: Column | str) -> Column:
    """The cosine of the angle that the share of differing bits estimates."""
    return F.cos(_col(distance) / 128.0 * math.pi)


def hash_bands(h: Column | str, bands: int = 4) -> Column:
    """Equal slices of the hash's bytes in base32; none for other numbers of bands."""
    if bands not in BAND_COUNTS:
        return F.expr("cast(array() as array<string>)")
    size = 16 // bands
    raw = hash_to_bytes(h)
    parts = F.array(*[base32.encode_column(F.substring(raw, k * size + 1, size), size) for k in range(bands)])
    return F.when(_col(h)["hi"].isNotNull(), parts)


def vector_bands(v: Column | str, bands: int = 4, seed: int = SEED_HASH) -> Column:
    return hash_bands(vector_hash(v, seed), bands)


def shared_bands(a: Column | str, b: Column | str) -> Column:
    """How many of a's bands are anywhere among b's."""
    b = _col(b)
    return F.size(F.filter(_col(a), lambda x: F.array_contains(b, x)))


def suggest_bands(distance: int, recall: float) -> int | None:
    """The fewest bands that meet a pair at that distance with that chance."""
    for n in BAND_COUNTS:
        if 1 - (1 - (1 - distance / 128) ** (128 // n)) ** n >= recall:
            return n
    return None


def _code(v: Column | str, make: Callable, bits: int, n_out: str = "string") -> Column:
    def run(a: pa.Array) -> pa.Array:
        out = np.full(len(a), None, object)
        for at, m in _rows(a, False, False):
            data = curves.to_bytes(make(m.astype(np.int64), bits))
            out[at] = np.frombuffer(data.tobytes().hex().encode(), f"S{2 * data.shape[1]}").astype(str) if data.shape[1] else ""
        return pa.array(out, pa.string())

    return F.arrow_udf(run, n_out)(as_floats(v))


def morton_encode(coords: Column | str, bits: int) -> Column:
    """Hexadecimal code of integer coordinates."""
    return _code(coords, curves.morton_bits, bits)


def hilbert_encode(coords: Column | str, bits: int) -> Column:
    return _code(coords, curves.hilbert_bits, bits)


def _points(code: Column | str, make: Callable, dims: int, bits: int) -> Column:
    CurveProfile(dims, bits)

    def run(s: pd.Series) -> pd.Series:
        known = [k for k, t in enumerate(s) if t is not None]
        out: list = [None] * len(s)
        if known:
            found = make(curves.from_ints([int(s.iloc[k], 16) for k in known], dims * bits), dims, bits)
            for k, row in zip(known, found.tolist(), strict=True):
                out[k] = row
        return pd.Series(out, dtype="object")

    return F.pandas_udf(run, "array<int>")(code)


def morton_decode(code: Column | str, dims: int, bits: int) -> Column:
    return _points(code, curves.morton_points, dims, bits)


def hilbert_decode(code: Column | str, dims: int, bits: int) -> Column:
    return _points(code, curves.hilbert_points, dims, bits)


def common_similarity(a: Column | str, b: Column | str) -> Column:
    """Vectors of any two sizes compared in a common space, from 0 to 1; takes reversible IDs."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(decode_vector(a), decode_vector(b)) + 1) / 2))


def parse_vector(text: Column | str) -> Column:
    """A vector from a JSON array or from numbers between commas or blanks."""
    text = F.trim(_col(text))
    listed = F.transform(F.filter(F.split(text, r"[,\s]+"), lambda x: x != ""), lambda x: x.try_cast("float"))
    found = F.when(text.startswith("["), F.from_json(text, "array<float>")).otherwise(F.when(F.exists(listed, lambda x: x.isNull()), F.lit(None)).otherwise(listed))
    return F.when(is_vector(found), found)
