"""Connected components of a graph of links by alternating stars.

The large star links every larger neighbour of a node to the node's least
neighbour, the small star does so with its smaller ones; both keep components
and in a few rounds every node hangs from the least one.  Each round is a
grouped minimum and a join, so no node's neighbours are ever gathered, and its
result is written out, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def roots(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: each node that has a link and isn't the least of its
    component, with the least.  ``edges`` has those columns, of long."""

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = mark(now)
    while before[0]:
        new = written(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct(), "stars")
        dropped(now)
        now, after = new, mark(new)
        if after == before:
            break
        before = after
    return now
