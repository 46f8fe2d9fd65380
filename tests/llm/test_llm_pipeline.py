"""The pipeline's stages on small tables: columns, effects, odd inputs."""

import corpus_pipeline
from pyspark.sql import functions as F

from simloom.llm.toxicity import held_out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        sizes.append(out.count())
        if name == "near_dedup":
            assert out.groupBy("text").count().where("count > 1").count() == 0
        if name == "pii":
            changed = out.alias("a").join(docs.alias("b"), "doc_id").where("a.text <> b.text")
            assert changed.where(~F.col("b.text").rlike("[0-9]")).count() == 0 < changed.count()
        docs = out
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == sizes[-1] and last.where("size(samples) = 0").count() == 0


def test_stages_on_odd_documents(spark, sf):
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (None, "some words here", "en", "a", 15), (2, "some words here", None, None, 15), (2, "some words here", None, None, 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"fp": F.lit("x"), "size": F.lit(1), "__copies": F.lit(None).cast("string")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "size", "__copies"]
        docs.count()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_held_out_rows(spark):
    rows = spark.range(5).select("id", held_out(F.col("id")).alias("h")).collect()
    import zlib

    assert [r["h"] for r in rows] == [zlib.crc32(str(r["id"]).encode()) % 4 == 2 for r in rows]
