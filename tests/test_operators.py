"""Searches, joins, sources and streams against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from simloom.functions import fingerprint, metrics, pairs, register, vectors
from simloom.functions.embed import TextModel, crop_box, embed_image, embed_text, image_tensor, read_safetensors
from simloom.functions.profiles import MortonProfile
from simloom.operators import blocking, scan, search
from simloom.sources import tables
from simloom.streaming import streams


def names(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, name string")


def test_best_match_takes_the_last_of_equals(spark):
    known = names(spark, ["receive", "believe", "achieve", "receive", "ceiling", "deceive"])
    asked = search.literals(known, ["recieve", "beleive", "achive", "cieling"])
    got = {r["query"]: r["id"] for r in search.best_matches(asked, known, "query", "name", "id").collect()}
    assert got == {"recieve": 3, "beleive": 1, "achive": 2, "cieling": 4}


def test_best_match_without_candidates(spark):
    r = search.best_matches(search.literals(names(spark, ["x"]), ["a"]), names(spark, ["x"]).where("false"), "query", "name", "id").first()
    assert r["id"] is None and r["score"] == 0.0


def test_thresholds_are_inclusive(spark):
    known = names(spark, ["apple", "application", "apply", "apricot", "banana", None])
    rows = search.matches_above(known, "app", "name", "id", 0.5).collect()
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows) and len(rows) >= 2
    exact = search.matches_above(known, "apple", "name", "id", 1.0).collect()
    assert [r["name"] for r in exact] == ["apple"]


def test_fuzzy_search(spark):
    known = names(spark, ["iPhone 14 Pro", "iPhone 14", "iPhone 13 Pro", "Samsung Galaxy"])
    rows = search.fuzzy_search(known, "iphone 14 pro", "name", "id").collect()
    assert rows[0]["name"] == "iPhone 14 Pro" and rows[0]["score"] == 1.0
    top = search.top_matches(search.literals(known, ["galaxy", "iphone"]), known, "query", "name", "id", 2)
    assert {r["query"]: r["rank"] for r in top.orderBy("rank").collect()} == {"galaxy": 2, "iphone": 2}


def test_live_search_of_a_blank_query_is_empty(spark):
    assert search.live_search(names(spark, ["a"]), "  ", "name").count() == 0


def test_hash_search(spark):
    df = names(spark, ["red iron", "red irons", "blue sky", None]).withColumn("hash", fingerprint.simhash("name"))
    rows = search.hash_search(df, "red iron", "hash", "id", 30).collect()
    assert rows[0]["id"] == 0 and rows[0]["distance"] == 0 and rows[0]["similarity"] == 1.0
    assert search.text_hash_search(names(spark, ["", None]), "", "name", most=0).count() == 2


def words(n, seed):
    r = random.Random(seed)
    return sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(n)} | {""})


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_edit_join_is_exact(spark, most):
    values = words(60, most)
    plain = lambda a, b: min(len(a), len(b)) if not a or not b else None  # noqa: E731, F841
    got = {(r["value_a"], r["value_b"]) for r in blocking.edit_pairs(names(spark, values), "id", "name", most).collect()}
    pairs = spark.createDataFrame([p for p in itertools.combinations(values, 2)], "a string, b string")
    want = {(r["a"], r["b"]) for r in pairs.where(F.levenshtein("a", "b") <= most).collect()}
    assert got == want


@pytest.mark.parametrize("most", [0, 3, 9])
def test_hash_join_is_exact(spark, most):
    r = random.Random(most)
    base = [r.getrandbits(64) for _ in range(6)]
    hashes = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(12))) for b in base for _ in range(6)]
    df = spark.createDataFrame([(k, h - (1 << 64) if h >> 63 else h) for k, h in enumerate(hashes)], "id int, hash long")
    got = {(x["key_a"], x["key_b"], x["distance"]) for x in blocking.similar_hashes(df, None, "id", "hash", most).collect()}
    want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a, b in itertools.combinations(range(len(hashes)), 2) if (hashes[a] ^ hashes[b]).bit_count() <= most}
    assert got == want


def test_band_join_meets_near_pairs(spark):
    df = spark.createDataFrame([(0, [0.5] * 64), (1, [0.5] * 63 + [0.501]), (2, [-0.5] * 64)], "id int, v array<float>")
    h = df.select("id", vectors.vector_hash("v").alias("hash")).withColumn("bands", vectors.hash_bands("hash", 16))
    pairs = blocking.band_pairs(h, None, "id", "bands", "hash")
    assert {(r["key_a"], r["key_b"]) for r in pairs.collect()} == {(0, 1)}
    assert [r["id"] for r in blocking.without_match(df, pairs, "id").collect()] == [2]
    assert sorted(r["id"] for r in blocking.with_match(df, pairs, "id").collect()) == [0, 1]


def test_similar_names(spark):
    df = names(spark, ["John Smith", "Jon Smith", "Jane Doe", "Jon Smith"])
    rows = blocking.similar_names(df, "name").collect()
    assert {(r["value_a"], r["value_b"]) for r in rows} == {("John Smith", "Jon Smith")}


@pytest.mark.parametrize("above", [0.82, 0.85, 0.9, 0.95])
def test_similar_names_are_those_of_all_pairs(spark, above):
    r = random.Random(2)
    values = ["", "a", "b", "ab", "é" * 70, "é" * 71 + "a", "xé" * 40]
    for _ in range(60):
        w = "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 14)))
        values.append(w)
        c = list(w)
        c[r.randrange(len(c))] = r.choice("abcxyz")
        values += ["".join(c), w[1:], w + r.choice("abc"), r.choice("xyz") + w]
    values = sorted(set(values))
    score = lambda a, b: pairs.prefix_bonus(pairs.jaro_scores([a], [b]), [a], [b], 0.1)[0]
    want = {(a, b) for a, b in itertools.combinations(values, 2) if score(a, b) > above}
    got = {(x["value_a"], x["value_b"]) for x in blocking.similar_names(names(spark, values), "name", above).collect()}
    assert got == {tuple(sorted(p, key=lambda x: x.encode())) for p in want}


def test_hash_layouts_cover_all_bits():
    for most in (0, 1, 3, 6, 8, 12, 20, 40, 63):
        layout = blocking.hash_layout(most)
        assert sorted(b for places, _ in layout for b in places) == list(range(64))
        assert sum(t + 1 for _, t in layout) >= most + 1


def test_near_duplicate_texts_tell_class_and_links(spark):
    df = names(spark, ["the quick brown fox jumps over it", "the quick brown fox jumps over it", "the quick brown fox jumps over it!", "something else", None, ""])
    rows = {r["id"]: r for r in blocking.near_duplicate_texts(df, "id", "name", 0.8).collect()}
    assert [rows[k]["class_id"] for k in range(6)] == [0, 0, 2, 3, 4, 4] and rows[1]["class_size"] == 2
    assert [rows[k]["n_links"] for k in range(4)] == [1, 1, 1, 0]
    links = blocking.similar_classes(df, "id", "name", 0.8).collect()
    assert [(r["key_a"], r["key_b"]) for r in links] == [(0, 2)]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_matched_stream_is_exact(spark, tmp_path, most):
    values = words(40, most + 7)
    names(spark, values).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(v,) for v in words(40, most + 8)], "k string")
    stream = spark.readStream.schema("id int, name string").parquet(str(tmp_path / "in"))
    q = streams.matched_stream(stream, known, "name", "k", most).writeStream.format("memory").queryName(f"m{most}").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["name"], r["k"], r["distance"]) for r in spark.table(f"m{most}").collect())
    every = names(spark, values).join(known, F.levenshtein("name", "k") <= most).select("name", "k", F.levenshtein("name", "k").alias("d")).collect()
    assert got == sorted(tuple(r) for r in every)


def test_scans_are_pushed_down(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", vectors.encode_id("embedding", MortonProfile()).alias("id"))
    tables.write_by_id(df, str(tmp_path / "ids"), files=2)
    stored = spark.read.parquet(str(tmp_path / "ids"))
    some = scan.by_prefix(stored, "08007")
    plan = some._jdf.queryExecution().toString()
    assert "StringStartsWith(id,08007)" in plan
    assert [r["id"] for r in some.collect()] == sorted(r["id"] for r in stored.collect() if r["id"].startswith("08007"))
    assert scan.of_profile(stored, MortonProfile()).count() == stored.count()
    assert scan.by_range(stored, "08006", "08008", limit=3).count() == 3


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "[" + ",".join(["0.5"] * 64) + "]")], "i int, t string")
    df.write.json(str(tmp_path / "j"))
    back = tables.vectors_from_text(tables.read(spark, str(tmp_path / "j"), "json", "i int, t string"), "t")
    assert len(back.first()["embedding"]) == 64
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    assert tables.images(spark, str(tmp_path)).count() == 1


def test_streams(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' as ts, 'red iron' as t union all select timestamp'2024-01-01 00:01:00', 'Red Iron' union all select timestamp'2024-01-01 00:02:00', 'blue'").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, t string").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("red irom",)], "k string")
    for name, df, n in (("s1", streams.scored_stream(stream(), "red iron", "t", least=0.9), 1), ("s2", streams.deduplicated_stream(stream(), "t", "ts"), 2), ("s3", streams.matched_stream(stream(), known, "t", "k"), 1)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n


def test_registered_names(spark):
    assert "jaro_winkler" in register.register(spark)
    r = spark.sql("select jaro_winkler('martha', 'marhta') j, osa_distance('ca', 'ac') o, hamming_distance('ab', 'cb') h, simhash_distance(1L, 2L) d, is_reversible_id('0g00') r").first()
    assert round(r["j"], 4) == 0.9611 and r["o"] == 1 and r["h"] == 1 and r["d"] == 2 and r["r"]


def test_toy_models(spark):
    import json

    import numpy as np

    matrix = np.eye(3, dtype="<f4")
    head = json.dumps({"embeddings": {"dtype": "F32", "shape": [3, 3], "data_offsets": [0, 36]}}).encode()
    data = len(head).to_bytes(8, "little") + head + matrix.tobytes()
    vectors_ = read_safetensors(data)
    model = TextModel(vectors_, lambda t: [len(w) - 1 for w in t.split()])
    df = names(spark, ["a bb", "", "a aaaa", None]).select("id", embed_text("name", lambda: model).alias("v")).orderBy("id")
    rows = [r["v"] for r in df.collect()]
    assert [round(x, 4) for x in rows[0]] == [0.7071, 0.7071, 0.0] and rows[1] is None and rows[2] == [1.0, 0.0, 0.0] and rows[3] is None
    assert crop_box(512, 256) == (512, 256, 144, 16) and image_tensor(np.zeros((224, 224, 3), np.uint8)).shape == (1, 3, 224, 224)
    img = spark.createDataFrame([(bytearray(b"x"),)], "c binary").select(embed_image("c", lambda b: np.zeros((224, 224, 3), np.uint8), lambda: lambda x: np.array([3.0, 4.0])).alias("v"))
    assert [round(x, 4) for x in img.first()["v"]] == [0.6, 0.8]


def test_metrics_reject_unknown_names(spark):
    with pytest.raises(ValueError):
        search.scored(names(spark, ["a"]), "a", "name", "cosine")
    assert set(metrics.METRICS) >= {"jaro", "best_match"}
