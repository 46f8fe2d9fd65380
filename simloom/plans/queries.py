"""One query per operator over the standard tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.functions import base32, fingerprint, metrics, vectors
from simloom.functions.embed import TextModel, crop_box, embed_text, models_dir, read_safetensors
from simloom.functions.profiles import QUANT8, FullProfile, HashProfile, HilbertProfile, MortonProfile, bits, compressed, cross_dimensional, lossless, max_length
from simloom.operators import blocking, scan, search
from simloom.sources.tables import read, table, with_stored_hash, workspace, write_by_band, write_by_id
from simloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Literal queries of the search operators.
WORDS = ["misty rose", "blue stell", "red", "grean iron", "almond brass", "tin"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_name").where("p_name is not null").distinct()


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All ordered pairs of the few distinct part names."""
    n = names(spark, d)
    return n.select(F.col("p_name").alias("a")).join(n.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.vector_hash("embedding").alias("hash"))


def rounded(c) -> object:
    return F.round(c, 9)


# string metrics


@query
def levenshtein_topk(spark: SparkSession, d: str) -> DataFrame:
    """The names nearest a misspelled one."""
    q = F.lit("misty rose")
    return names(spark, d).select("p_name", metrics.levenshtein("p_name", q).alias("distance"), rounded(metrics.normalized_levenshtein("p_name", q)).alias("score")).orderBy(F.desc("score"), "p_name").limit(10)


@query
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", metrics.levenshtein("a", "b").alias("distance"), rounded(metrics.normalized_levenshtein("a", "b")).alias("score"))


@query
def levenshtein_options(spark: SparkSession, d: str) -> DataFrame:
    o = metrics.SimilarityOptions(case_sensitive=False, trim_whitespace=True)
    padded = F.concat(F.lit("\t "), F.upper("p_name"), F.lit(" \n"))
    return names(spark, d).select("p_name", metrics.levenshtein_with_options(padded, F.col("p_name"), o).alias("prepared"), metrics.levenshtein(F.upper("p_name"), "p_name").alias("plain"))


@query
def osa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", metrics.osa_distance("a", "b").alias("distance"), rounded(metrics.normalized_osa("a", "b")).alias("score"))


@query
def jaro_pairs(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", rounded(metrics.jaro("a", "b")).alias("score"))


@query
def jaro_winkler_pairs(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", rounded(metrics.jaro_winkler("a", "b")).alias("score"), rounded(metrics.jaro_winkler("a", "b", 0.2)).alias("score_20"))


@query
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", metrics.hamming("a", "b").alias("distance"), rounded(metrics.normalized_hamming("a", "b")).alias("score"))


@query
def best_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", rounded(metrics.best_match("a", "b")).alias("score"))


# text hashes


@query
def text_simhash(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_name", fingerprint.simhash("p_name").alias("hash"))


@query
def simhash_distances(spark: SparkSession, d: str) -> DataFrame:
    n = names(spark, d).select("p_name", fingerprint.simhash("p_name").alias("h"))
    p = n.select(F.col("p_name").alias("a"), F.col("h").alias("ha")).join(n.select(F.col("p_name").alias("b"), F.col("h").alias("hb")), F.col("a") < F.col("b"))
    return p.select("a", "b", fingerprint.simhash_distance("ha", "hb").alias("distance"), fingerprint.hash_similarity("ha", "hb").alias("similarity"))


@query
def similar_hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names within 24 bits of a query's hash."""
    n = names(spark, d).select("p_name", fingerprint.simhash("p_name").alias("hash"))
    return search.hash_search(n, "red brass", "hash", "p_name", 24, None).select("p_name", "distance", "similarity")


@query
def simhash_bits(spark: SparkSession, d: str) -> DataFrame:
    n = names(spark, d).select("p_name", fingerprint.simhash("p_name").alias("h"))
    return n.select("p_name", fingerprint.bit_string("h").alias("bits"), fingerprint.unsigned("h").cast("string").alias("unsigned"), F.size(fingerprint.differing_bits("h", F.lit(0).cast("long"))).alias("n_set"))


@query
def document_hash_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text hash and the first document that shares it."""
    return blocking.hash_classes(table(spark, d, "documents"), "doc_id", "text")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("key", F.concat_ws("-", F.col("conv_id"), F.lpad(F.col("turn").cast("string"), 6, "0")))


@query
def conversation_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's class of equal hashes and how many classes are over 0.9 similar."""
    return blocking.near_duplicate_texts(_turns(spark, d), "key", "text", 0.9)


@query
def conversation_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of those classes."""
    return blocking.similar_classes(_turns(spark, d), "key", "text", 0.9)


@query
def benchmark_hash_matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose hash is within 8 bits of a benchmark item's."""
    docs = blocking.class_heads(table(spark, d, "documents"), "doc_id", "text").select(F.col("class_id").alias("id"), "hash")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), fingerprint.simhash(F.coalesce("text", F.lit(""))).alias("hash"))
    return blocking.similar_hashes(docs, items, "id", "hash", 8)


# candidate search


@query
def best_match_per_query(spark: SparkSession, d: str) -> DataFrame:
    found = search.best_matches(search.literals(table(spark, d, "part"), WORDS), table(spark, d, "part"), "query", "p_name", "p_partkey")
    return found.withColumn("score", rounded("score"))


@query
def matches_above_threshold(spark: SparkSession, d: str) -> DataFrame:
    return search.matches_above(table(spark, d, "part").select("p_partkey", "p_name"), "blue", "p_name", "p_partkey", 0.6).withColumn("score", rounded("score"))


@query
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.fuzzy_search(table(spark, d, "part").select("p_partkey", "p_name"), "Red Bras", "p_name", "p_partkey", "best_match", 0.5, 10)
    return found.withColumn("score", rounded("score"))


@query
def fuzzy_search_table(spark: SparkSession, d: str) -> DataFrame:
    """Customers named nearly so; no limit."""
    found = search.fuzzy_search(table(spark, d, "customer").select("c_custkey", "c_name"), "customer#000000042", "c_name", "c_custkey", "normalized_levenshtein", 0.9, None)
    return found.withColumn("score", rounded("score"))


@query
def top3_per_query(spark: SparkSession, d: str) -> DataFrame:
    found = search.top_matches(search.literals(table(spark, d, "part"), WORDS), table(spark, d, "part"), "query", "p_name", "p_partkey")
    return found.withColumn("score", rounded("score"))


@query
def live_search(spark: SparkSession, d: str) -> DataFrame:
    return search.live_search(names(spark, d), " Blue ", "p_name", 0.3).withColumn("score", rounded("score"))


@query
def compare_all_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = search.compare_all(name_pairs(spark, d), "a", "b")
    return out.select(*[rounded(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query
def hash_search_texts(spark: SparkSession, d: str) -> DataFrame:
    return search.text_hash_search(names(spark, d), "blue tin", "p_name", "p_name", 28, 20).select("p_name", "distance", "similarity")


@query
def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Back-fill of a hash column."""
    return search.with_hashes(table(spark, d, "part").select("p_partkey", "p_name"), "p_name")


# joins


@query
def edit_distance_join(spark: SparkSession, d: str) -> DataFrame:
    return blocking.edit_pairs(table(spark, d, "part"), "p_partkey", "p_name", 2)


@query
def customer_name_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers within one edit of a supplier's number."""
    c = table(spark, d, "customer").select(F.regexp_replace("c_name", "^Customer", "").alias("value"))
    s = table(spark, d, "supplier").select(F.regexp_replace("s_name", "^Supplier", "").alias("value"))
    return blocking.edit_pairs(c.union(s), "value", "value", 1)


@query
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    return blocking.similar_names(table(spark, d, "part"), "p_name", 0.85).withColumn("score", rounded("score"))


@query
def hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = names(spark, d).select("p_name", fingerprint.simhash("p_name").alias("hash"))
    return blocking.similar_hashes(n, None, "p_name", "hash", 12)


@query
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that share one of eight bands of 16 bits, within 40 bits."""
    h = hashed(spark, d).withColumn("bands", vectors.hash_bands("hash", 8))
    return blocking.band_pairs(h, None, "vec_id", "bands", "hash", 40)


@query
def rows_without_partner(spark: SparkSession, d: str) -> DataFrame:
    p = blocking.edit_pairs(table(spark, d, "part"), "p_partkey", "p_name", 1).select(F.col("value_a").alias("key_a"), F.col("value_b").alias("key_b"))
    return blocking.without_match(names(spark, d), p, "p_name")


@query
def rows_with_partner(spark: SparkSession, d: str) -> DataFrame:
    p = blocking.edit_pairs(table(spark, d, "part"), "p_partkey", "p_name", 1).select(F.col("value_a").alias("key_a"), F.col("value_b").alias("key_b"))
    return blocking.with_match(names(spark, d), p, "p_name")


# vectors


@query
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", vectors.is_vector("embedding").alias("valid"), F.size("embedding").alias("dims"), F.round(vectors.norm("embedding"), 4).cast("double").alias("norm"))


@query
def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", vectors.normalized(F.transform("embedding", lambda x: (x * 3).cast("float"))).alias("v"))
    return e.select("vec_id", F.round(F.element_at("v", 1).cast("double"), 5).alias("first"), F.round(vectors.dot("v", "v"), 4).alias("square"))


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", F.round(vectors.cosine("embedding", "q"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@query
def quantised_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.coordinates("embedding").alias("coords"))


@query
def truncated_vectors(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select("vec_id", vectors.truncated("embedding", 32).alias("v"))
    return t.select("vec_id", F.size("v").alias("dims"), F.round(F.element_at("v", 1).cast("double"), 4).alias("first"))


@query
def morton_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.encode_id("embedding", MortonProfile()).alias("id"))


@query
def morton_ids_native(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.morton_id("embedding").alias("id"))


@query
def morton_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.by_range(morton_ids(spark, d), "08006", "0800b", "id", 10)


@query
def id_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.by_prefix(morton_ids(spark, d), "08007", "id")


@query
def hilbert_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.encode_id("embedding", HilbertProfile()).alias("id"))


@query
def curve_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").select("vec_id", vectors.coordinates("embedding").alias("coords"))
    c = c.select("*", vectors.morton_encode("coords", 10).alias("morton"), vectors.hilbert_encode("coords", 10).alias("hilbert"))
    return c.select("vec_id", "morton", (vectors.morton_decode("morton", 10, 10) == F.col("coords")).alias("morton_back"), (vectors.hilbert_decode("hilbert", 10, 10) == F.col("coords")).alias("hilbert_back"))


@query
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.encode_id("embedding").alias("id"))


@query
def vector_hashes(spark: SparkSession, d: str) -> DataFrame:
    return hashed(spark, d).select("vec_id", F.col("hash.hi").alias("hi"), F.col("hash.lo").alias("lo"))


@query
def id_distances(spark: SparkSession, d: str) -> DataFrame:
    i = hash_ids(spark, d)
    q = i.where("vec_id = 0").select(F.col("id").alias("q"))
    out = i.join(F.broadcast(q)).withColumn("distance", vectors.id_distance("id", "q"))
    return out.select("vec_id", "distance", F.round(vectors.cosine_linear("distance").cast("double"), 4).alias("linear"), F.round(vectors.cosine_estimate("distance"), 6).alias("estimate"))


@query
def band_values(spark: SparkSession, d: str) -> DataFrame:
    b = blocking.band_table(hashed(spark, d).withColumn("bands", vectors.hash_bands("hash", 4)), "vec_id")
    return b.groupBy("band_idx").agg(F.count("*").alias("n"), F.countDistinct("band").alias("n_distinct"), F.min("band").alias("least"))


@query
def shared_band_counts(spark: SparkSession, d: str) -> DataFrame:
    h = hashed(spark, d).select("vec_id", vectors.hash_bands("hash", 16).alias("bands"))
    q = h.where("vec_id = 0").select(F.col("bands").alias("q"))
    return h.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", vectors.shared_bands("bands", "q").alias("n_shared"))


def _coded(spark: SparkSession, d: str, profile) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", vectors.encode_id("embedding", profile).alias("id"))
    e = e.withColumn("back", vectors.decode_vector("id"))
    worst = F.array_max(F.zip_with("embedding", "back", lambda x, y: F.abs(x - y)))
    return e.select("vec_id", "id", F.size("back").alias("dims"), worst.alias("worst"), F.round(F.element_at("back", 1).cast("double"), 5).alias("first"))


@query
def lossless_codec(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, lossless()).select("vec_id", "id", "dims", "first", (F.col("worst") == 0).alias("exact"))


@query
def quantised_codec(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, FullProfile(QUANT8)).select("vec_id", "id", "dims", "first", (F.col("worst") < 0.02).alias("near"))


@query
def reduced_codec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", vectors.encode_id("embedding", compressed(0.5, 64)).alias("id"))
    return e.select("vec_id", "id", F.size(vectors.decode_vector("id")).alias("dims"))


@query
def length_bounded_codec(spark: SparkSession, d: str) -> DataFrame:
    """IDs of at most 100 characters."""
    e = table(spark, d, "embeddings").select("vec_id", vectors.encode_id("embedding", max_length(100, 64)).alias("id"))
    return e.select("vec_id", "id", F.size(vectors.decode_vector("id")).alias("dims"))


@query
def id_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", vectors.encode_id("embedding", compressed(0.25, 64)).alias("id"), vectors.encode_id("embedding").alias("plain"))
    m = e.select("vec_id", vectors.id_metadata("id").alias("m"), vectors.is_reversible("id").alias("reversible"), vectors.is_reversible("plain").alias("plain_reversible"))
    return m.select("vec_id", "m.original_dims", "m.encoded_dims", "m.is_lossless", "m.has_dimension_reduction", "m.precision", "m.dimension_mode", "reversible", "plain_reversible")


@query
def bits_codec(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, FullProfile(bits(4))).select("vec_id", "id", "dims", "first", (F.col("worst") < 0.06).alias("near"))


@query
def common_space(spark: SparkSession, d: str) -> DataFrame:
    """Vectors against their own first half-zeroed copy, in a common space."""
    p = cross_dimensional(32)
    e = table(spark, d, "embeddings").select("vec_id", vectors.encode_id("embedding", p).alias("a"), vectors.encode_id(F.transform("embedding", lambda x, i: F.when(i < 48, x).otherwise(F.lit(0.0).cast("float"))), p).alias("b"))
    return e.select("vec_id", F.round(vectors.common_similarity("a", "b"), 4).alias("similarity"))


@query
def half_codec(spark: SparkSession, d: str) -> DataFrame:
    """IDs in a common space, and the half-precision values that come back."""
    e = table(spark, d, "embeddings").select("vec_id", vectors.encode_id("embedding", cross_dimensional(32)).alias("id"))
    return e.select("vec_id", "id", F.transform(vectors.decode_vector("id"), lambda x: x.cast("double")).alias("back"))


@query
def parsed_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", ").alias("t"))
    e = e.select("vec_id", vectors.parse_vector("t").alias("a"), vectors.parse_vector(F.concat(F.lit("["), F.col("t"), F.lit("]"))).alias("b"), "embedding")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 4)
    return e.select("vec_id", total("a").alias("list_sum"), total("b").alias("json_sum"), F.element_at("a", 1).cast("double").alias("first"), F.element_at("b", -1).cast("double").alias("last"))


@query
def nearest_labels(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of each label nearest the first vector by hash."""
    h = hashed(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    q = h.where("vec_id = 0").select(F.col("hash").alias("q"))
    scored = h.where("vec_id <> 0").join(F.broadcast(q)).withColumn("distance", vectors.hash_distance("hash", "q"))
    best = Window.partitionBy("label").orderBy("distance", "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("label", "rank", "vec_id", "distance")


@query
def url_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hosts within two edits of another."""
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    return blocking.edit_pairs(hosts, "host", "host", 2)


# IDs and bytes


@query
def decoded_ids(spark: SparkSession, d: str) -> DataFrame:
    return morton_ids(spark, d).select("vec_id", F.hex(vectors.decode_id("id")).alias("bytes"))


@query
def vectors_from_doubles(spark: SparkSession, d: str) -> DataFrame:
    """IDs of vectors that are stored as doubles."""
    return table(spark, d, "embeddings").select("vec_id", vectors.encode_id(F.col("embedding").cast("array<double>")).alias("id"))


@query
def hash_bytes_back(spark: SparkSession, d: str) -> DataFrame:
    h = hashed(spark, d).select("vec_id", vectors.hash_to_bytes("hash").alias("b"))
    h = h.select("vec_id", F.hex("b").alias("bytes"), vectors.hash_from_bytes("b").alias("h"), vectors.hash_from_bytes(F.substring("b", 1, 15)).isNull().alias("short_is_null"))
    return h.select("vec_id", "bytes", "h.hi", "h.lo", "short_is_null")


@query
def id_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profile that an ID's header names, of good and broken ones."""
    e = table(spark, d, "embeddings")
    one = lambda p: vectors.encode_id("embedding", p)
    good = e.select("vec_id", F.array(one(None), one(MortonProfile()), one(HilbertProfile()), one(lossless())).alias("ids"))
    ids = good.select("vec_id", F.concat("ids", F.transform("ids", lambda x: F.substring(x, 1, 3)), F.transform("ids", lambda x: F.upper(x)), F.array(F.lit(""), F.lit("w000"), F.lit(None).cast("string"))).alias("ids"))
    return ids.select("vec_id", F.posexplode("ids").alias("place", "id")).select("vec_id", "place", vectors.id_profile("id").alias("profile"))


@query
def profile_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bits and characters of IDs by profile and size of vectors."""
    known = {"hash": HashProfile(), "morton": MortonProfile(), "hilbert": HilbertProfile(8, 16), "lossless": lossless(), "quant8": FullProfile(QUANT8), "bits4": FullProfile(bits(4)), "common128": cross_dimensional(128)}
    rows = [(name, n, p.bit_length(n), p.string_length(n), p.type_id, p.reversible) for name, p in known.items() for n in (64, 128, 768)]
    return spark.createDataFrame(rows, "profile string, dims int, bit_length int, string_length int, type_id int, reversible boolean")


@query
def refused_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Which parameters of curves and precisions are refused."""
    tried = [("curve", n, b) for n in (0, 1, 8, 16, 32, 33) for b in (0, 1, 4, 16, 17)] + [("bits", 0, b) for b in (0, 1, 32, 33)]

    def refused(kind: str, n: int, b: int) -> bool:
        try:
            MortonProfile(n, b) if kind == "curve" else bits(b)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(*t, refused(*t)) for t in tried], "kind string, dims int, bits int, refused boolean")


@query
def suggested_bands(spark: SparkSession, d: str) -> DataFrame:
    """The fewest bands that meet a pair at a distance with a chance."""
    rows = [(n, r, vectors.suggest_bands(n, r)) for n in range(0, 65, 4) for r in (0.5, 0.9, 0.99)]
    return spark.createDataFrame(rows, "distance int, recall double, bands int")


@query
def hash_positions(spark: SparkSession, d: str) -> DataFrame:
    """Of arrays of hashes the places of those within 24 bits of the first."""
    n = names(spark, d).select("p_name", fingerprint.simhash("p_name").alias("h"))
    lists = n.groupBy(F.substring("p_name", 1, 1).alias("first")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_name", "h"))), lambda x: x["h"]).alias("hs"))
    return lists.select("first", fingerprint.similar_positions("hs", F.element_at("hs", 1), 24).alias("places"))


@query
def hash_range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The lookup by a range of numbers, which loses matches."""
    n = names(spark, d).select("p_name", fingerprint.simhash("p_name").alias("hash"))
    return search.hash_search(n, "red brass", "hash", "p_name", 62, None, compat_range=True).select("p_name", "distance", "similarity")


# models


def _toy_model() -> TextModel:
    """A table of token vectors; a token is a word's length."""
    place, token = np.arange(64), np.arange(12)[:, None]
    return TextModel((((token + 1) * (place + 3) * 7919 % 17 - 8) / 8).astype(np.float32), lambda t: [len(w) for w in t.split()])


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_name", embed_text("p_name", _toy_model).alias("v"))


@query
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(spark, d).select("p_name", F.round(F.element_at("v", 1).cast("double"), 4).alias("first"), F.round(F.element_at("v", 64).cast("double"), 4).alias("last"), F.round(vectors.dot("v", "v"), 4).alias("square"))


@query
def embedded_text_distances(spark: SparkSession, d: str) -> DataFrame:
    """Embed, encode, compare: each name's hash ID against that of a literal text."""
    model = _toy_model()
    one = model.embed("small blue ring")
    asked = base32.encode(vectors.id_bytes(one[None], HashProfile())[0])
    return _embedded(spark, d).select("p_name", vectors.id_distance(vectors.encode_id("v"), F.lit(asked)).alias("distance"))


@query
def model_from_files(spark: SparkSession, d: str) -> DataFrame:
    """A table of token vectors written as a safetensors file, sent to executors and read there."""
    vectors_ = _toy_model().vectors
    head = json.dumps({"embeddings": {"dtype": "F32", "shape": list(vectors_.shape), "data_offsets": [0, vectors_.nbytes]}}).encode()
    data = len(head).to_bytes(8, "little") + head + vectors_.astype("<f4").tobytes()
    load = lambda: TextModel(read_safetensors(data), lambda t: [len(w) for w in t.split()])
    return names(spark, d).select("p_name", embed_text("p_name", load).alias("v")).select("p_name", F.round(F.element_at("v", 1).cast("double"), 4).alias("first"))


@query
def model_folders(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(models_dir("given"), models_dir())], "given string, default string").withColumn("is_set", F.length("default") > 0).select("given", "is_set")


# sources and stored tables


@query
def formats_back(spark: SparkSession, d: str) -> DataFrame:
    """The parts written as JSON, CSV and ORC, and read again."""
    p, folder = table(spark, d, "part").select("p_partkey", "p_name", "p_size"), workspace(spark)
    out = None
    for kind in ("json", "csv", "orc"):
        to = p.write.option("header", True) if kind == "csv" else p.write
        getattr(to, kind)(f"{folder}/{kind}")
        one = read(spark, f"{folder}/{kind}", kind, None if kind == "orc" else "p_partkey long, p_name string, p_size int").select(F.lit(kind).alias("kind"), "p_partkey", "p_name", "p_size")
        out = one if out is None else out.unionAll(one)
    return out


@query
def stored_ids(spark: SparkSession, d: str) -> DataFrame:
    """A prefix scan of a table that is stored in order of IDs."""
    path = f"{workspace(spark)}/ids"
    write_by_id(morton_ids(spark, d), path, files=4)
    return scan.by_prefix(spark.read.parquet(path), "08007", "id")


@query
def stored_bands(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share a band, from a table bucketed by band."""
    name = f"simloom_bands_{uuid.uuid4().hex}"
    write_by_band(blocking.band_table(hashed(spark, d).withColumn("bands", vectors.hash_bands("hash", 8)), "vec_id"), name, 8)
    b = spark.table(name)
    return b.groupBy("band_idx", "band").agg(F.count("*").alias("n")).where("n > 1")


@query
def stored_text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return with_stored_hash(table(spark, d, "part").select("p_partkey", "p_name"), f"{workspace(spark)}/hashes", "p_name")


@query
def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size after scaling and corner of the crop, of images of some sizes."""
    sizes = [(w, h) for w in (100, 224, 256, 640, 1000) for h in (100, 300, 768)]
    return spark.createDataFrame([(w, h, *crop_box(w, h)) for w, h in sizes], "width int, height int, scaled_width int, scaled_height int, `left` int, `top` int")


# streams


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its file; times are instants."""
    known = table(spark, d, name)
    stream = spark.readStream.schema(known.schema).parquet(f"{d}/{name}.parquet*")
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in known.dtypes if t == "timestamp_ntz"})


@query
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    found = streams.scored_stream(_stream(spark, d, "part").select("p_partkey", "p_name"), "red bras", "p_name", "best_match", 0.6)
    return streams.drained(found, workspace(spark)).withColumn("score", rounded("score"))


@query
def stream_matches(spark: SparkSession, d: str) -> DataFrame:
    known = search.literals(table(spark, d, "part"), [w.replace("e", "a") for w in WORDS] + ["small rong", "blue wodgat"], "word")
    found = streams.matched_stream(_stream(spark, d, "part").select("p_partkey", "p_name"), F.broadcast(known), "p_name", "word", 2)
    return streams.drained(found, workspace(spark))


@query
def stream_first_of_each(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of event types and props, each once."""
    e = _stream(spark, d, "events").select("ts", F.concat_ws(" ", "event_type", "props").alias("t"))
    return streams.drained(streams.deduplicated_stream(e, "t", "ts", "40 days").select("simhash"), workspace(spark))


@query
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and day, of days that the watermark has passed."""
    found = streams.counted_stream(_stream(spark, d, "events"), "event_type", "ts", "1 day", "1 day")
    return streams.drained(found.select(F.col("window.start").alias("day"), "event_type", "n"), workspace(spark))


@query
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered names, from SQL."""
    from simloom.functions.register import register

    register(spark)
    names(spark, d).createOrReplaceTempView("simloom_names")
    return spark.sql("select p_name, round(normalized_levenshtein(p_name, 'red'), 9) as nl, hamming_distance(p_name, 'tin') as h, simhash_distance(simhash(p_name), 0) as n_set from simloom_names")


@query
def sql_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names with parameters and arrays, from SQL."""
    from simloom.functions.register import register

    register(spark)
    names(spark, d).createOrReplaceTempView("simloom_names")
    return spark.sql(
        "select p_name, round(best_match(p_name, 'red ring'), 9) as best, round(jaro_winkler_with_prefix(p_name, 'red ring', 0.2d), 9) as jw20, osa_distance(p_name, 'der ring') as osa, "
        "find_best_match(p_name, array('blue ring', 'red widget', 'small')).index as nearest, size(find_matches_above_threshold(p_name, array('blue ring', 'red widget', 'small'), 0.7d)) as n_above, "
        "levenshtein_with_opts(concat(' ', upper(p_name)), 'red ring', false, true) as prepared, round(simhash_similarity(p_name, 'red ring'), 9) as sh from simloom_names"
    )


@query
def sql_ids(spark: SparkSession, d: str) -> DataFrame:
    from simloom.functions.register import register

    register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("simloom_vectors")
    return spark.sql(
        "select vec_id, encode_hash(embedding) as h, encode_morton(embedding, 10, 10) as m, encode_hilbert(embedding, 10, 10) as b, encode_max_length(embedding, 100) as x, "
        "id_metadata(encode_compressed(embedding, 0.5d)).encoded_dims as dims, id_distance(encode_hash(embedding), encode_hash(embedding)) as same, hex(decode_id(encode_morton(embedding, 10, 10))) as raw from simloom_vectors"
    )


@query
def sql_bands(spark: SparkSession, d: str) -> DataFrame:
    """The table function of bands, beside its column form."""
    from simloom.functions.register import register

    register(spark)
    hashed_ = table(spark, d, "embeddings").select("vec_id", "embedding", vectors.vector_bands("embedding", 4).alias("own"))
    hashed_.createOrReplaceTempView("simloom_banded")
    return spark.sql("select vec_id, b.band_idx, b.band, b.band = own[b.band_idx] as same from simloom_banded, lateral explode_bands(embedding, 4) b")


@query
def sql_best_of_group(spark: SparkSession, d: str) -> DataFrame:
    """The name of each brand that matches a text best."""
    from simloom.functions.register import register

    register(spark)
    table(spark, d, "part").createOrReplaceTempView("simloom_parts")
    return spark.sql("select p_brand, best_match_agg('red rings', p_name) as best from (select distinct p_brand, p_name from simloom_parts where p_name is not null) t group by p_brand")
