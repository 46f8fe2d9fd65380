"""The corpus pipeline: stages over documents, each an operator of simloom.llm.

Every stage but the last returns documents with the columns it was given.

* toxicity drops the documents that score as toxic;
* near_dedup keeps the first document of each group of near duplicates;
* pii writes pseudonyms over personal data in the texts;
* mixing draws sources to their target weights: a document that the mix takes
  n times is there n times, one that it doesn't take is gone;
* encoding gives each document's sampled segmentations.

Columns named as ``documents`` has them are needed: doc_id, text, source; all
others pass through.  Null texts are kept as empty documents until the mix,
which takes no document without words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import pii_pseudonyms, sentencepiece_lattice, simhash_dedup, source_mixing, toxicity
from simloom.llm.queries import TEST_KEY
from simloom.llm.shared import bounded_batches, dropped, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash_dedup.first_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii_pseudonyms.pseudonymised(docs, pii_pseudonyms.key_of(spark, TEST_KEY))
    if "n_chars" in out.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)
    return out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.repeated(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return sentencepiece_lattice.sampled(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: A fitted model, graph components and sampled segmentations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
