"""Mixing sources to target weights by weighted fair queueing.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share the budget, the sum of all document sizes in words.  A source's target
stops at three times its size; what is over is shared out again by weight
until no target is above.  That fixed point is a water level L with target =
min(L * weight, 3 * size), found by one pass over sources in order of
size / weight.

Queue: each source's documents are shuffled by a keyed hash and read up to
three times, so copy e of a document ends at word e * source_size + (words up
to and with it).  That word divided by the source's target is the copy's
virtual finish time.  All copies in order of finish time are cut where their
words reach the budget.

All running sums have bounded ranges: hashes are uniform, so equal ranges of
hashes hold equally many documents of a source however large it is, and
ranges are summed by blocks of 1024; sources, of which there may be many, are
sorted by ranges of their own; the cut is found by halving the axis of finish
times into 4096 ranges, twice, and only copies of the one range that holds it
are sorted together.  Only ids and sizes are shuffled.

Defined cases: a null text has size 0; null sources are a source of their own;
documents without words are never taken; a source without words has target 0;
repeated rows count each time, ties go by hash, source and id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.shared import dropped, free_name, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
RANGES = 4096
#: Documents of one source and hash range; sources and ranges only set how work is dealt out.
PER_RANGE = 512
#: Hash ranges of a block.
PER_BLOCK = 1024
SEED = "mix"


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums of ``sums`` over all earlier rows in ``order``, the row left out.

    Rows are sorted by ranges; of each range only its sums are brought together.
    """
    values = {f"{name}_": value for name, value in sums.items()}
    placed = written(df.withColumns(values).repartitionByRange(*order).withColumn("at", F.spark_partition_id()), "mix-sorted")
    parts = placed.groupBy("at").agg(*[F.sum(c).alias(c) for c in values])  # a row per range
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("at", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}before") for c in values])
    within = Window.partitionBy("at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "at")
    return out.withColumns({name: F.col(f"{name}_before") + F.coalesce(F.sum(f"{name}_").over(within), F.lit(0)) for name in sums}).drop("at", *values, *[f"{c}before" for c in values])


def targets(totals: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source."""
    by_name = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    w = _running(totals, by_name, {"place": F.lit(1)})
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(LIMIT) * F.col("source_size"))
    w = written(_running(w, [F.col("cap") / F.col("weight"), *by_name], {"caps": F.col("cap"), "weights": F.col("weight")}), "mix-levels")
    size, weight = w.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(size) - F.col("caps")).cast("double") / (F.lit(weight) - F.col("weights"))
    water = w.where(level * F.col("weight") <= F.col("cap")).agg(F.max(level)).first()[0]
    water = math.inf if water is None else water
    return w.select("source", "source_size", F.least(F.lit(water) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _hash(key: Column) -> Column:
    """A uniform value of 60 bits from a keyed digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document with its source's target and the words taken of it."""
    return _mixed(docs, key, text, source).drop("source")


def _mixed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    sized = sized_rows = written(sized.withColumn("h", _hash(F.col("doc_id"))), "mix-sizes")
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-totals")
    goal = targets(totals.drop("n"))
    n_rows = totals.agg(F.sum("n")).first()[0] or 1
    ranges = max(1, -(-n_rows // PER_RANGE))
    sized = sized.withColumn("range", F.floor(F.col("h") / F.lit(float(1 << 60)) * ranges))

    # running size within (source, range), sizes of the block's earlier ranges, and of the source's earlier blocks
    sums = written(sized.groupBy("source", "range").agg(F.sum("size").alias("in_range")).withColumn("block", F.floor(F.col("range") / PER_BLOCK)), "mix-ranges")
    earlier = lambda by, order: F.coalesce(F.sum("in_range").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("source", "block").agg(F.sum("in_range").alias("in_range")).select("source", "block", earlier(["source"], "block").alias("before_block"))
    blocks = blocks.join(goal, blocks["source"].eqNullSafe(goal["source"])).select(blocks["source"], "block", "before_block", "source_size", "target")
    starts = sums.withColumn("before", earlier(["source", "block"], "range")).alias("r").join(blocks.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.block") == F.col("k.block")))
    starts = starts.select("r.source", "range", (F.col("before") + F.col("before_block")).alias("before"), "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("h", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("within", F.sum("size").over(within)).alias("a").join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.range") == F.col("b.range")))
    queued = written(queued.select("doc_id", "a.source", "size", "h", "source_size", "target", (F.col("before") + F.col("within")).alias("ends")), "mix-queue")
    dropped(sized_rows, totals, sums)

    def ends_at(e: int | Column) -> Column:
        return (F.lit(e) * F.col("source_size") + F.col("ends")) / F.col("target")

    # the cut: count words by range of finish times, then by ranges 4096 times finer within the range that holds it
    moving = F.col("size") > 0
    budget, latest = queued.agg(F.sum("size"), F.max(F.when(moving & (F.col("target") > 0), ends_at(LIMIT - 1)))).first()
    taken = F.lit(0).cast("long")
    if latest:
        copies = queued.where(moving & (F.col("target") > 0)).withColumn("t", F.explode(F.array(*[ends_at(e) for e in range(LIMIT)])))
        scaled = F.col("t") / F.lit(latest) * F.lit(float(RANGES))
        coarse = F.least(F.floor(scaled), F.lit(RANGES - 1))
        fine = F.least(F.floor((scaled - coarse) * F.lit(float(RANGES))), F.lit(RANGES - 1))
        copies = copies.withColumns({"coarse": coarse, "fine": fine})
        where, spent = F.lit(True), 0
        for level in ("coarse", "fine"):
            sums = copies.where(where).groupBy(level).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy(level)) + F.lit(spent))
            hit = sums.where(F.col("upto") > budget).agg(F.min_by(F.struct(level, "words", "upto"), level)).first()[0]
            if hit is None:
                break
            where, spent = where & (F.col(level) == hit[level]), hit["upto"] - hit["words"]
        if hit is None:  # every copy fits
            taken = F.when(moving, LIMIT * F.col("size")).otherwise(0)
        else:
            place = lambda t: F.struct(t.alias("t"), F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"), F.col("h"), F.coalesce("doc_id", F.lit(-1 << 63)).alias("k"), F.col("size"))
            cell = copies.where(where).withColumn("place", place(F.col("t")))
            cell = cell.withColumn("upto", F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(spent))
            first_out = cell.where(F.col("upto") > budget).agg(F.min("place")).first()[0]
            end = F.struct(F.lit(first_out["t"]).alias("t"), F.lit(first_out["n"]).alias("n"), F.lit(first_out["s"]).alias("s"), F.lit(first_out["h"]).cast("long").alias("h"), F.lit(first_out["k"]).cast("long").alias("k"), F.lit(first_out["size"]).cast("long").alias("size"))
            count = sum((F.when(moving & (F.col("target") > 0) & (place(ends_at(e)) < end), F.col("size")).otherwise(F.lit(0)) for e in range(LIMIT)), F.lit(0))
            taken = count.cast("long")
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    Rows of equal key, source and size are alike to the mix.  The copies taken
    of such a group are shared out evenly, those left over to any of its rows,
    so exactly the words taken are there.
    """
    k, src, size, n, m, row, part, at, before, copy = (free_name(docs, f"mix_{name}") for name in ("key", "source", "words", "copies", "alike", "row", "part", "at", "before", "copy"))
    taken = _mixed(docs, key, text, source).where("taken > 0 or size > 0")
    groups = taken.groupBy(F.col("doc_id").alias(k), F.col("source").alias(src), F.col("size").alias(size)).agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias(n), F.count("*").alias(m)).where(F.col(n) > 0)
    groups = written(groups, "mix-groups")
    sized = docs.withColumns({k: F.col(key).cast("long"), src: F.col(source).cast("string"), size: word_count(F.col(text))}).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (k, src, size)]
    of = lambda some: sized.join(some.alias("g"), same[0] & same[1] & same[2]).select("d.*", n, m)
    even = F.col(n) % F.col(m) == 0
    one = [F.col(c) for c in docs.columns]
    each = of(groups.where(even)).withColumn(copy, F.floor(F.col(n) / F.col(m))).select(*one, copy)
    times = F.explode(F.sequence(F.lit(1), F.col(copy).cast("int")))
    if groups.where(~even).isEmpty():  # as where keys don't repeat
        return each.withColumn(copy, times).select(*docs.columns)
    # rows of the other groups are numbered: by their place in a part, after those of the parts before it
    odd = written(of(groups.where(~even)).withColumn(row, F.monotonically_increasing_id()), "mix-alike").withColumn(part, F.shiftright(row, 33))
    by = [k, src, size]
    counts = odd.groupBy(*by, part).agg(F.count("*").alias(at))
    counts = counts.withColumn(before, F.coalesce(F.sum(at).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(at)
    odd = odd.withColumn(at, F.row_number().over(Window.partitionBy(*by, part).orderBy(row))).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*by, part)]
    odd = odd.join(counts.alias("g"), same[0] & same[1] & same[2] & same[3]).select("d.*", before)
    odd = odd.withColumn(copy, F.floor(F.col(n) / F.col(m)) + (F.col(before) + F.col(at) <= F.col(n) % F.col(m)).cast("long"))
    out = each.unionAll(odd.select(*one, copy)).where(F.col(copy) > 0)
    return out.withColumn(copy, times).select(*docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS DOUBLE) AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), w AS (
  SELECT source, source_size, least(weight * (SELECT coalesce(max(level), 'inf'::DOUBLE) FROM l WHERE level * weight <= cap), cap) AS target FROM l
), q AS (
  SELECT d.*, w.source_size, w.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
), c AS (
  SELECT *, CAST(e * source_size + ends AS DOUBLE) / target AS t FROM q, (VALUES (0), (1), (2)) AS k(e) WHERE size > 0 AND target > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY t, source NULLS LAST, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM c
), k AS (
  SELECT doc_id, sum(size) AS taken FROM r WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""
