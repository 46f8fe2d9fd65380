"""IDs, hashes, bands, curves and codecs: known values and round trips."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simloom.functions import base32, codec, curves, rng, vectors
from simloom.functions import profiles as pf

CYCLE = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
GOLDEN = (CYCLE + [-x for x in CYCLE]) * 48


def frame(spark, *rows):
    return spark.createDataFrame([(k, list(map(float, r)) if r is not None else None) for k, r in enumerate(rows)], "i int, v array<float>")


def test_vector_hash_known_value(spark):
    h = vectors.hash_bytes(np.array([GOLDEN], np.float32))[0]
    assert h.tobytes().hex() == "9f52baea6db62f9b250de36caf8f0b13"
    r = frame(spark, GOLDEN).select(vectors.hash_to_bytes(vectors.vector_hash("v")).alias("b")).first()
    assert r["b"].hex() == "9f52baea6db62f9b250de36caf8f0b13"


def test_rows_share_prefixes():
    assert (rng.hyperplanes(5, 64) == rng.hyperplanes(5, 128)[:, :64]).all()
    assert rng.blake3_short(b"").hex().startswith("af1349b9f5f9a1a6a0404dea36dcc949")


def test_base32():
    assert base32.encode(bytes.fromhex("0123456789abcdef")) == "04hkaps9lf6uu"
    assert len(base32.encode(bytes(16))) == 26 and len(base32.encode(bytes(13))) == 21
    assert base32.decode("xyz123") is None and base32.decode("0") is None and base32.decode("01") is None


@given(st.binary(max_size=40))
def test_base32_round_trip_and_order(data):
    assert base32.decode(base32.encode(data)) == data
    if data:
        smaller = bytes([data[0] // 2]) + data[1:]
        assert (smaller < data) == (base32.encode(smaller) < base32.encode(data))


def test_base32_column(spark):
    rows = [bytes(range(k, k + 16)) for k in range(0, 240, 7)]
    df = spark.createDataFrame([(r,) for r in rows], "b binary").select("b", base32.encode_column(F.col("b"), 16).alias("t"))
    assert all(r["t"] == base32.encode(bytes(r["b"])) for r in df.collect())


@pytest.mark.parametrize("coords,bits,code", [([5, 3], 3, 27), ([1, 2, 3], 2, 53), ([7, 7], 3, 63), ([0, 0], 3, 0)])
def test_morton(coords, bits, code):
    assert curves.to_ints(curves.morton_bits(np.array([coords]), bits)) == [code]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 12), st.integers(1, 10), st.randoms())
def test_curves_round_trip(dims, bits, random):
    points = np.array([[random.randrange(1 << bits) for _ in range(dims)] for _ in range(5)])
    for make, back in ((curves.morton_bits, curves.morton_points), (curves.hilbert_bits, curves.hilbert_points)):
        code = make(points, bits)
        assert (back(curves.from_bytes(curves.to_bytes(code), dims * bits), dims, bits) == points).all()


def test_hilbert_codes_are_distinct():
    every = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    assert len(set(curves.to_ints(curves.hilbert_bits(every, 3)))) == 512


def test_quantised():
    assert curves.quantised(np.array([[0.0, -1.0, 1.0, 2.0]], np.float32), 4, 10).tolist() == [[512, 0, 1023, 1023]]


def test_coordinates_column(spark):
    r = frame(spark, [0.0, -1.0, 1.0] + [0.25] * 61).select(vectors.coordinates("v", 4).alias("c")).first()
    assert r["c"] == [512, 0, 1023, 639]


def test_id_lengths_and_invalid(spark):
    df = frame(spark, [0.1] * 128, [0.1] * 32, [float("nan")] * 64, None, [0.0] * 64)
    rows = df.select("i", vectors.encode_id("v").alias("h"), vectors.encode_id("v", pf.MortonProfile()).alias("m"), vectors.morton_id("v").alias("n"), vectors.encode_id("v", pf.HilbertProfile()).alias("c")).orderBy("i").collect()
    assert len(rows[0]["h"]) == 29 and len(rows[0]["m"]) == 24 == len(rows[0]["c"])
    assert rows[0]["h"].startswith("040") and rows[0]["m"].startswith("0800") and rows[0]["c"].startswith("0c00")
    assert all(rows[k][c] is None for k in (1, 2, 3) for c in "hmnc")
    assert all(r["m"] == r["n"] for r in rows)
    with pytest.raises(Exception, match="wrong size"):
        df.where("i = 1").select(vectors.encode_id("v", strict=True)).collect()


def test_opposite_vectors_and_distance(spark):
    df = frame(spark, [1.0] * 128, [-1.0] * 128).select("i", vectors.encode_id("v").alias("id"))
    a, b = df.where("i = 0").select(F.col("id").alias("a")), df.where("i = 1").select(F.col("id").alias("b"))
    r = a.crossJoin(b).select(vectors.id_distance("a", "b").alias("d"), vectors.id_distance("a", "a").alias("s"), vectors.cosine_linear(F.lit(128)).alias("l"), vectors.cosine_estimate(F.lit(128)).alias("e")).first()
    assert r["d"] == 128 and r["s"] == 0 and math.isclose(r["l"], 1 - math.pi, rel_tol=1e-6) and math.isclose(r["e"], -1)


@pytest.mark.parametrize("n,width", [(1, 26), (2, 13), (4, 7), (8, 4), (16, 2)])
def test_bands(spark, n, width):
    raw = bytes(range(1, 17))
    df = spark.createDataFrame([(raw,)], "b binary").select(vectors.hash_bands(vectors.hash_from_bytes("b"), n).alias("x"))
    bands = df.first()["x"]
    assert len(bands) == n and all(len(b) == width for b in bands)
    assert bands == [base32.encode(raw[k * 16 // n : (k + 1) * 16 // n]) for k in range(n)]


def test_no_bands(spark):
    df = spark.createDataFrame([(bytes(16),)], "b binary")
    assert all(df.select(vectors.hash_bands(vectors.hash_from_bytes("b"), n).alias("x")).first()["x"] == [] for n in (0, 3, 5, 32))
    assert vectors.suggest_bands(8, 0.9) == 8 and vectors.suggest_bands(64, 0.99) is None


RAMP = [k / 128 - 1 for k in range(256)]


@pytest.mark.parametrize("profile,error", [(pf.lossless(), 0), (pf.FullProfile(pf.HALF16), 0.01), (pf.FullProfile(pf.QUANT8), 0.02), (pf.FullProfile(pf.bits(4)), 0.14), (pf.FullProfile(pf.bits(12)), 0.001)])
def test_codec_round_trip(profile, error):
    data = codec.encoded(np.array([RAMP], np.float32), profile)[0]
    assert np.abs(codec.decoded(data) - np.array(RAMP, np.float32)).max() <= error
    assert len(data) == 12 + profile.precision.payload_bytes(256)


def test_codec_edges():
    constant = np.full((1, 64), 0.25, np.float32)
    for p in (pf.QUANT8, pf.bits(1), pf.bits(32)):
        assert (codec.decoded(codec.encoded(constant, pf.FullProfile(p))[0]) == constant[0]).all()
    assert codec.decoded(b"\x04\0\0\0") is None and codec.decoded(b"\x01\0") is None and codec.decoded(None) is None
    with pytest.raises(ValueError):
        codec.encoded(constant, pf.FullProfile(pf.FULL32, pf.reduce_to(64)))


def test_projection_keeps_angles():
    r = np.random.default_rng(1)
    x = r.normal(size=(2, 256)).astype(np.float32)
    y = codec.projected(x, pf.common(128), 9)
    cos = lambda m: float(m[0] @ m[1] / np.linalg.norm(m[0]) / np.linalg.norm(m[1]))
    assert y.shape == (2, 128) and abs(cos(x) - cos(y)) < 0.3
    padded = np.pad(x, ((0, 0), (0, 100)))
    assert np.array_equal(codec.projected(padded, pf.common(128), 9), y)


def test_headers():
    assert pf.read_header(bytes([0x12, 0, 0, 0xFF])) == pf.Header(1, 2, 255)
    assert pf.Header(1, 3, 0x1234).pack() == bytes([0x13, 0, 0x12, 0x34])
    h = pf.Header(0, 4, None, 768, pf.HALF16, pf.reduce_to(256), 0x12345678)
    assert len(h.pack()) == 12 and pf.read_header(h.pack()) == h
    assert pf.read_header(b"\x01") is None and pf.read_header(bytes([4, 0, 0, 0])) is None
    assert pf.read_header(bytes([4, 0, 1, 0, 35, 0, 0, 0, 0, 0, 0, 0])) is None


def test_profile_sizes():
    assert pf.HashProfile().string_length() == 29 and pf.MortonProfile().string_length() == 24
    assert pf.compressed(1.0, 768) == pf.lossless()
    assert pf.compressed(0.5, 768) == pf.FullProfile(pf.FULL32, pf.reduce_to(384), pf.SEED_COMPRESSED)
    assert pf.compressed(0.1, 768).precision == pf.QUANT8 or pf.compressed(0.1, 768).precision == pf.HALF16
    assert pf.max_length(20, 768).dimensions == pf.reduce_to(1) and pf.max_length(10_000, 64) == pf.lossless()
    for chars in range(24, 400, 9):
        try:
            p = pf.max_length(chars, 256, strict=True)
        except ValueError:
            assert chars < 34
            continue
        data = codec.encoded(np.array([RAMP], np.float32), p)[0]
        assert len(base32.encode(data)) <= chars
    with pytest.raises(ValueError):
        pf.MortonProfile(10, 13)
    with pytest.raises(ValueError):
        pf.MortonProfile(transform=3)
    with pytest.raises(ValueError):
        pf.bits(33)


def test_reversible_and_metadata(spark):
    df = frame(spark, RAMP).select(vectors.encode_id("v", pf.cross_dimensional(128)).alias("full"), vectors.encode_id("v").alias("plain"))
    r = df.select(vectors.is_reversible("full").alias("a"), vectors.is_reversible("plain").alias("b"), vectors.id_metadata("full").alias("m"), vectors.id_metadata("plain").alias("n"), vectors.decode_vector("plain").alias("d"), vectors.decode_vector("full").alias("f")).first()
    assert r["a"] and not r["b"] and r["n"] is None and r["d"] is None and len(r["f"]) == 128
    assert r["m"]["original_dims"] == 256 and r["m"]["encoded_dims"] == 128 and r["m"]["dimension_mode"] == "common" and r["m"]["has_dimension_reduction"]


def test_vector_columns(spark):
    df = frame(spark, [3.0, 4.0] + [0.0] * 62, [0.0] * 64)
    rows = df.select(vectors.normalized("v").alias("n"), vectors.norm("v").alias("l"), vectors.is_vector("v").alias("ok"), vectors.truncated("v", 2).alias("t")).collect()
    assert rows[0]["l"] == 5.0 and math.isclose(rows[0]["n"][0], 0.6, rel_tol=1e-6) and rows[1]["n"] == [0.0] * 64 and rows[0]["ok"] and len(rows[0]["t"]) == 2


def test_parse(spark):
    nums = [k / 10 for k in range(64)]
    texts = ["[" + ",".join(map(str, nums)) + "]", " ".join(map(str, nums)), ", ".join(map(str, nums)), "1,2,3", "a,b", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string").select("i", vectors.parse_vector("t").alias("v")).orderBy("i")
    rows = [r["v"] for r in df.collect()]
    assert all(len(rows[k]) == 64 for k in (0, 1, 2)) and rows[3] is None and rows[4] is None and rows[5] is None


def test_shared_bands(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["x", "a"])], "a array<string>, b array<string>")
    assert df.select(vectors.shared_bands("a", "b").alias("n")).first()["n"] == 2
