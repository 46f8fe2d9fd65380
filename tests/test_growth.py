"""What joins may hold in one place, whatever Spark takes their sides to measure."""

import itertools
import random

from pyspark.sql import functions as F

from simloom.functions.fingerprint import simhash_text
from simloom.operators import blocking
from simloom.streaming import streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edit_joins_broadcast_no_exploded_side(spark):
    values = spark.range(300).select("id", F.format_string("#%09d", "id").alias("name"))
    for most in (1, 2, 3):
        assert "Broadcast" not in plan(blocking.edit_pairs(values, "id", "name", most))
    got = blocking.edit_pairs(values, "id", "name", 1)
    assert got.count() == got.select("value_a", "value_b").distinct().count() == 300 * 9 + 300  # two digits, and hundreds of three values


def test_matched_streams_broadcast_only_what_is_marked(spark, tmp_path):
    spark.range(300).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("red iron "), F.col("id")).alias("name")).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("red iron 7",), ("rde iron 77",), ("red iron 7",)], "k string")
    for side, joined in ((known, "SortMergeJoin"), (F.broadcast(known), "BuildRight")):
        found = streams.matched_stream(spark.readStream.schema("id int, name string").parquet(str(tmp_path / "in")), side, "name", "k", 2)
        assert [n for n, _ in found.dtypes] == ["id", "name", "k", "distance"]
        q = found.writeStream.format("memory").queryName(f"m{joined}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        seen = q._jsq.streamingQuery().lastExecution().executedPlan().toString()
        assert joined in seen and "BuildLeft" not in seen
        rows = sorted(tuple(r) for r in spark.table(f"m{joined}").collect())
        cross = spark.read.parquet(str(tmp_path / "in")).crossJoin(known).withColumn("distance", F.levenshtein("name", "k")).where("distance <= 2")
        assert rows == sorted(tuple(r) for r in cross.collect())


def crowded(n):
    """Texts whose hashes crowd, some of them twice, and missing ones."""
    r = random.Random(n)
    base = "of the tion and in er es on re ha".split()
    texts = [" ".join(base * 6 + r.choices(base, k=r.randrange(1, 9))) for _ in range(n)]
    return [(f"{k}-{k % 7:06}", t) for k, t in enumerate([*texts, *texts[:20], None, "", "x"])]


def links_of(rows, most):
    classes = {}
    for key, text in rows:
        classes.setdefault(simhash_text(text or ""), []).append(key)
    heads = sorted((min(keys), h) for h, keys in classes.items())
    return classes, {(a, b, (x ^ y).bit_count()) for (a, x), (b, y) in itertools.combinations(heads, 2) if (x ^ y).bit_count() <= most}


def rows_shuffled(p):
    """Rows that each exchange of a plan wrote, after its run."""
    name = p.getClass().getSimpleName()
    inner = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
    own = p.metrics().get("shuffleRecordsWritten")
    return sum(map(rows_shuffled, [*inner, *(p.children().apply(i) for i in range(p.children().size()))]), [own.get().value()] if own.isDefined() else [])


def test_class_pairs_are_all_and_met_once(spark):
    rows = crowded(400)
    pairs = blocking.similar_classes(spark.createDataFrame(rows, "key string, text string"), "key", "text", 0.9)
    got = [tuple(r) for r in pairs.collect()]
    links = links_of(rows, 6)[1]
    assert len(links) > 1000 and len(got) == len(links) and set(got) == links
    # as it ran; Spark takes exploded sides for what they were before
    assert "Broadcast" not in plan(pairs)


def test_links_are_counted_without_shuffling_pairs(spark):
    rows = crowded(700)
    classes, links = links_of(rows, 6)
    n = {}
    for a, b, _ in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    found = blocking.near_duplicate_texts(spark.createDataFrame(rows, "key string, text string"), "key", "text", 0.9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # so that all joins shuffle
    try:
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == sorted((k, min(keys), len(keys), n.get(min(keys), 0)) for keys in classes.values() for k in keys)
    most = max(rows_shuffled(found._jdf.queryExecution().executedPlan()))
    assert 0 < most <= max(blocking.STRIPES * len(classes), len(rows))
