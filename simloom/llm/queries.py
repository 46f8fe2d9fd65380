"""One thin query per operator, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from simloom.llm import html_wrappers, media_ogg, pii_pseudonyms, secret_scan, sentencepiece_lattice, simhash_dedup, source_mixing, token_counts, topk_search, toxicity
from simloom.llm.shared import documents


#: Of the synthetic tables only, so that results can be held against others; real data need a key of their own.
TEST_KEY = "not a secret"


def op1_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk_search.exact_top_k(vectors, vectors.where("id % 50 = 0"), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(documents(spark, sf_dir))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ogg.media_digest(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_pseudonyms.report(documents(spark, sf_dir), pii_pseudonyms.key_of(spark, TEST_KEY))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.report(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_exact_topk_search": op1_exact_topk_search,
    "op2_source_mixing": op2_source_mixing,
    "op3_ogg_media": op3_ogg_media,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_secret_scan": op6_secret_scan,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_exact_topk_search": OP1_SQL,
    "op2_source_mixing": source_mixing.ORACLE,
}
