"""Metrics and text hashes: known values, properties and agreement with plain versions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simloom.functions import fingerprint, metrics, pairs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a,b,d",
    [("kitten", "sitting", 3), ("saturday", "sunday", 3), ("book", "back", 2), ("", "abc", 3), ("café", "cafe", 1), ("你好", "您好", 1), ("🎉🎊", "🎉", 1), ("receive", "recieve", 2), ("", "", 0)],
)
def test_levenshtein(spark, a, b, d):
    assert one(spark, metrics.levenshtein(F.lit(a), F.lit(b))) == d


def test_levenshtein_share(spark):
    assert one(spark, metrics.normalized_levenshtein(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, metrics.normalized_levenshtein(F.lit("hello"), F.lit("hello"))) == 1.0
    assert one(spark, metrics.normalized_levenshtein(F.lit(None).cast("string"), F.lit("a"))) is None


@pytest.mark.parametrize("a,b,case,trim,d", [("HELLO", "hello", False, False, 0), ("  hello  ", "hello", True, True, 0), ("\thello\n", "hello", True, True, 0), ("  HELLO  ", "hello", False, True, 0), ("HELLO", "hello", True, False, 5)])
def test_options(spark, a, b, case, trim, d):
    o = metrics.SimilarityOptions(case_sensitive=case, trim_whitespace=trim)
    assert one(spark, metrics.levenshtein_with_options(F.lit(a), F.lit(b), o)) == d


@pytest.mark.parametrize("a,b,d", [("ca", "ac", 1), ("abcd", "acbd", 1), ("abc", "bca", 2), ("ca", "abc", 3), ("", "", 0), ("", "ab", 2), ("ab", "", 2)])
def test_osa(a, b, d):
    assert pairs.osa_distances([a], [b])[0] == d


@pytest.mark.parametrize("a,b,d", [("karolin", "kathrin", 3), ("1011101", "1001001", 2), ("2173896", "2233796", 3), ("hello", "world!", None), ("ACGTACGT", "ACGTACCT", 1), ("你好", "您好", 1), ("", "", 0)])
def test_hamming(spark, a, b, d):
    assert one(spark, metrics.hamming(F.lit(a), F.lit(b))) == d


def test_normalized_hamming(spark):
    assert math.isclose(one(spark, metrics.normalized_hamming(F.lit("hello"), F.lit("world"))), 0.2)
    assert one(spark, metrics.normalized_hamming(F.lit(""), F.lit(""))) == 1.0


def test_jaro_known_values():
    j = pairs.jaro_scores(["", "x", "martha", "DIXON", "a" * 100], ["", "", "marhta", "DICKSON", "a" * 99 + "b"])
    assert j[0] == 1.0 and j[1] == 0.0 and math.isclose(j[2], 0.9444444444444445) and j[3] > 0.7 and j[4] > 0.95
    w = pairs.prefix_bonus(pairs.jaro_scores(["martha"], ["marhta"]), ["martha"], ["marhta"], 0.1)
    assert math.isclose(w[0], 0.9611111111111111)


def test_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("ab", "ba")], "a string, b string")
    rows = df.select(metrics.osa_distance("a", "b").alias("o"), metrics.jaro("a", "b").alias("j"), metrics.jaro_winkler("a", "b").alias("w"), metrics.best_match("a", "b").alias("m")).collect()
    assert rows[0]["o"] is None and rows[1]["j"] is None and rows[2]["o"] == 1


def plain_osa(a, b):
    d = {}
    for i in range(-1, len(a)):
        for j in range(-1, len(b)):
            if i < 0 or j < 0:
                d[i, j] = max(i, j) + 1
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def plain_jaro(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == c:
                taken.add(j)
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(left, [b[j] for j in sorted(taken)], strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


words = st.text("abcdé你", max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=30))
def test_kernels_agree_with_plain_versions(rows):
    a, b = map(list, zip(*rows, strict=True))
    assert pairs.osa_distances(a, b).tolist() == [plain_osa(x, y) for x, y in rows]
    assert pairs.jaro_scores(a, b).tolist() == [plain_jaro(x, y) for x, y in rows]
    assert pairs.osa_distances(a, b).tolist() == pairs.osa_distances(b, a).tolist()


def test_length_bounds_lose_nothing(spark):
    values = [("a" * i + "b" * j) for i in range(5) for j in range(5)]
    df = spark.createDataFrame([(x, y) for x in values for y in values], "a string, b string")
    for metric, least in (("normalized_levenshtein", 0.6), ("jaro", 0.8), ("jaro_winkler", 0.9), ("best_match", 0.85)):
        scored = df.withColumn("s", metrics.METRICS[metric]("a", "b")).where(F.col("s") >= least)
        assert scored.where(~metrics.may_reach(metric, "a", "b", least)).count() == 0


def test_simhash():
    h = fingerprint.simhash_text
    assert h("") == 0 and h("Hello World") == h("hello world")
    d = lambda a, b: (h(a) ^ h(b)).bit_count()
    assert d("iPhone 14", "iPhone 15") == 5
    assert d("iPhone 14", "iPhone 15") < d("iPhone 14", "Galaxy S23")
    assert fingerprint.features("ab") == ["a", "b"] and fingerprint.features("abc") == ["abc", "abc"]
    assert fingerprint.features("a bc") == ["a b", " bc", "a", "bc"]


@settings(max_examples=40, deadline=None)
@given(st.text("ab é你🎉\u2003ß", min_size=60, max_size=120))
def test_long_texts_hash_as_short_ones(text):
    low, votes = text.lower(), [0] * 64
    for f in fingerprint.features(low):
        for k in range(64):
            votes[k] += 1 if fingerprint.fnv1a(f) >> k & 1 else -1
    assert fingerprint.simhash_text(text) == sum(1 << k for k in range(64) if votes[k] > 0)


def test_simhash_columns(spark):
    df = spark.createDataFrame([("hello", "help"), (None, "x"), ("", "")], "a string, b string")
    rows = df.select(fingerprint.simhash("a").alias("a"), fingerprint.simhash("b").alias("b"), fingerprint.simhash_similarity("a", "b").alias("s")).collect()
    assert rows[1]["a"] is None and rows[1]["s"] is None and rows[2]["a"] == 0 and rows[2]["s"] == 1.0
    bits = spark.createDataFrame([(-1, 1)], "a long, b long").select(fingerprint.bit_string("a").alias("t"), fingerprint.differing_bits("a", "b").alias("d"), fingerprint.unsigned("a").alias("u")).first()
    assert bits["t"] == "1" * 64 and bits["d"] == list(range(1, 64)) and int(bits["u"]) == (1 << 64) - 1


def test_find_similar_hashes(spark):
    names = ["iPhone 14 Pro", "iPhone 13", "Galaxy S23", "iPhone 14"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string").withColumn("hash", fingerprint.simhash("name"))
    found = {r["i"] for r in fingerprint.find_similar_hashes(df, fingerprint.simhash_text("iPhone 14"), 15).collect()}
    assert 3 in found and 2 not in found
