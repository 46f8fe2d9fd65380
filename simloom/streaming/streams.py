"""Scoring and deduplication of streams.

All scalar functions are stateless, so they work on streams as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.fingerprint import simhash
from simloom.operators.blocking import deletion_forms
from simloom.operators.search import _score


def scored_stream(stream: DataFrame, query: str, column: str, metric: str = "best_match", least: float = 0.5) -> DataFrame:
    """Rows of a stream whose score against a literal query reaches ``least``."""
    return stream.withColumn("score", _score(metric, F.lit(query), F.col(column))).where(F.col("score") >= least)


def matched_stream(stream: DataFrame, known: DataFrame, column: str, name: str, most: int = 2) -> DataFrame:
    """Each row of a stream with the rows of a static table within ``most`` (0 to 2) edits of it.

    Exact: rows meet by what deletions make of both, known by hashes.  A pair that
    meets by several forms counts at the least of them, so nothing has to be
    remembered.  Both sides are shuffled by form, as Spark would size them up by
    what they were before; ``known`` is broadcast if it is marked so.
    """
    if not 0 <= most <= 2:
        raise ValueError("0 to 2 edits")
    taken = {c.lower() for c in (*stream.columns, *known.columns)}
    form = next("form" + "_" * k for k in range(99) if "form" + "_" * k not in taken)

    def forms(s: Column) -> Column:
        return F.array_distinct(F.transform(deletion_forms(s, most), lambda x: F.xxhash64(x)))

    left, right = (df.withColumn(form, F.explode(forms(F.col(c)))) for df, c in ((stream, column), (known, name)))
    distance = F.levenshtein(stream[column], known[name], most)
    # forms are made again only of pairs that are near
    first = F.when(distance >= 0, F.col(form) == F.array_min(F.array_intersect(forms(stream[column]), forms(known[name]))))
    return left.hint("merge").join(right, form).where(first).withColumn("distance", distance).drop(form)


def deduplicated_stream(stream: DataFrame, text: str, time: str, within: str = "10 minutes") -> DataFrame:
    """Of texts with one hash that arrive within the watermark, the first."""
    return stream.withColumn("simhash", simhash(F.coalesce(F.col(text), F.lit("")))).withWatermark(time, within).dropDuplicatesWithinWatermark(["simhash"])


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for the input that is there now, as Parquet in a shared folder."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def counted_stream(stream: DataFrame, column: str, time: str, window: str = "5 minutes", within: str = "10 minutes") -> DataFrame:
    """Rows per value and window."""
    return stream.withWatermark(time, within).groupBy(F.window(time, window), column).agg(F.count("*").alias("n"))
