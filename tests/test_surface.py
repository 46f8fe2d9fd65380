"""SQL names with parameters, images, models from files, and all queries against their SQL."""

import json
import os
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions import embed, vectors
from simloom.functions.profiles import compressed, max_length
from simloom.functions.register import register
from simloom.plans.oracles import ORACLES
from simloom.plans.queries import QUERIES


def png(pixels, kind, filters):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    height, width, channels = pixels.shape
    lines, above = [], np.zeros((width, channels), np.int64)
    for row, f in zip(pixels.astype(np.int64), filters, strict=True):
        left = np.vstack([np.zeros((1, channels), np.int64), row[:-1]])
        corner = np.vstack([np.zeros((1, channels), np.int64), above[:-1]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (0, left, above, (left + above) // 2, near)[f]
        lines.append(bytes([f]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("kind", "channels"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_files_are_read(kind, channels):
    pixels = np.random.default_rng(kind).integers(0, 256, (10, 7, channels), dtype=np.uint8)
    back = embed.read_png(png(pixels, kind, [0, 1, 2, 3, 4] * 2))
    want = np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]
    assert (back == want).all()
    with pytest.raises(ValueError):
        embed.read_png(b"no image")


def test_images_are_scaled_and_cropped():
    flat = np.full((300, 500, 3), 77, np.uint8)
    assert embed.cropped(flat).shape == (224, 224, 3) and (embed.cropped(flat) == 77).all()
    ramp = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 256, axis=0).repeat(3, axis=2)
    assert (embed.cropped(ramp)[0, :, 0] == np.arange(16, 240)).all()  # nothing to scale


def test_images_embed_through_the_default_decoder(spark):
    data = png(np.full((30, 40, 3), 128, np.uint8), 2, [0] * 30)
    df = spark.createDataFrame([(bytearray(data),), (None,)], "c binary")
    rows = df.select(embed.embed_image("c", None, lambda: lambda x: x.mean(axis=(2, 3))).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-5 and rows[1]["v"] is None


def test_text_model_from_files(spark, tmp_path):
    vocab = {"red": 0, "blue": 1, "[UNK]": 2}
    tokenizer = json.dumps({"version": "1.0", "model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}, "pre_tokenizer": {"type": "Whitespace"}}).encode()
    head = json.dumps({"embeddings": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}}).encode()
    weights = len(head).to_bytes(8, "little") + head + np.eye(2, dtype="<f4").tobytes()
    model = embed.text_model_from_bytes(weights, tokenizer, b'{"normalize": false}')
    assert model.embed("red blue").tolist() == [0.5, 0.5] and model.embed("green") is None
    folder = tmp_path / "toy_model"
    folder.mkdir()
    (folder / "tokenizer.json").write_bytes(tokenizer)
    (folder / "model.safetensors").write_bytes(weights)
    load = embed.shipped_text_model(spark, str(folder))
    v = spark.createDataFrame([("red red blue",)], "t string").select(embed.embed_text("t", load).alias("v")).first()["v"]
    assert abs(v[0] / v[1] - 2) < 1e-5


def test_sql_names_take_parameters(spark):
    assert {"best_match", "find_best_match", "find_matches_above_threshold", "levenshtein_with_opts", "simhash_similarity", "find_similar_hashes", "id_distance", "id_metadata", "decode_id", "explode_bands"} <= set(register(spark))
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(20)
    df.createOrReplaceTempView("surface_vectors")
    got = spark.sql("select encode_compressed(embedding, 0.5d) a, encode_max_length(embedding, case when vec_id % 2 = 0 then 100 else 80 end) b, vec_id from surface_vectors").collect()
    want = df.select(vectors.encode_id("embedding", compressed(0.5, 64)).alias("a"), F.when(F.col("vec_id") % 2 == 0, vectors.encode_id("embedding", max_length(100, 64))).otherwise(vectors.encode_id("embedding", max_length(80, 64))).alias("b"), "vec_id").collect()
    assert got == want
    r = spark.sql("select find_best_match('recieve', array('receive', 'believe', 'receive')) a, find_best_match('x', array()) b, find_matches_above_threshold('app', array('apple', null), 0.5d) c, find_best_match(null, array('a')) d").first()
    assert r["a"]["index"] == 2 and r["b"]["index"] is None and r["b"]["score"] == 0.0 and [x["index"] for x in r["c"]] == [0] and r["d"] is None


def rows_of(columns, rows):
    def same(x):
        if isinstance(x, float):
            return round(x, 9) + 0.0
        return tuple(map(same, x)) if isinstance(x, (list, tuple)) else x

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(same(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_the_rows_of_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    df = QUERIES[name](spark, sf)
    sql = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(sql.columns, sql.fetchall())
