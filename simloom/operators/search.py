"""Searching tables of strings, hashes and vectors.

Strings are scored once per distinct value and joined back.  Sides of joins are
broadcast only if they are literal query lists, or if they were counted and are
small; Spark's own size check decides in all other cases.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import metrics
from simloom.functions.fingerprint import hash_similarity, simhash, simhash_distance, simhash_text

#: A literal query list is part of the plan.
MOST_LITERALS = 10_000


def literals(df: DataFrame, values: Sequence[str], name: str = "query") -> DataFrame:
    """A one-column table of literal queries."""
    if len(values) > MOST_LITERALS:
        raise ValueError("long query lists are tables of their own")
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def _score(metric: str, a: Column, b: Column) -> Column:
    if metric not in metrics.METRICS:
        raise ValueError(f"metric {metric}; known: {', '.join(metrics.METRICS)}")
    return metrics.METRICS[metric](a, b)


def scored(candidates: DataFrame, query: str, column: str, metric: str = "best_match", ignore_case: bool = False, least: float | None = None) -> DataFrame:
    """Candidates with their score against one literal query; ``least`` is inclusive."""
    prepare = F.lower if ignore_case else (lambda c: c)
    own, other = prepare(F.col(column)), F.lit(query.lower() if ignore_case else query)
    candidates = candidates.withColumn("__value", own).where(F.col("__value").isNotNull())
    if least is not None:
        candidates = candidates.where(metrics.may_reach(metric, F.col("__value"), other, least))
    if metric in metrics.BUILT_IN:  # cheaper than bringing equal values together
        out = candidates.withColumn("score", _score(metric, other, F.col("__value"))).drop("__value")
        return out if least is None else out.where(F.col("score") >= least)
    some = candidates.select("__value").distinct().withColumn("score", _score(metric, other, F.col("__value")))
    if least is not None:
        some = some.where(F.col("score") >= least)
    return candidates.join(some, "__value").drop("__value")


def fuzzy_search(candidates: DataFrame, query: str, column: str, key: str, metric: str = "best_match", least: float = 0.5, limit: int | None = 10, ignore_case: bool = True) -> DataFrame:
    """The best candidates first, equal scores by key."""
    found = scored(candidates, query, column, metric, ignore_case, least).orderBy(F.desc("score"), key)
    return found if limit is None else found.limit(limit)


def matches_above(candidates: DataFrame, query: str, column: str, key: str, least: float) -> DataFrame:
    """Every candidate whose best match reaches ``least``, in order of key."""
    return scored(candidates, query, column, "best_match", False, least).orderBy(key)


def pair_scores(queries: DataFrame, candidates: DataFrame, query: str, column: str, metric: str, least: float | None = None) -> DataFrame:
    """Scores of distinct queries with distinct candidates: query, value, score.

    Queries should be few; each meets every distinct value that lengths allow.
    """
    left = queries.select(F.col(query).alias("query")).where(F.col("query").isNotNull()).distinct()
    right = candidates.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    bound = F.lit(True) if least is None else metrics.may_reach(metric, left["query"], right["value"], least)
    out = left.join(right, bound).withColumn("score", _score(metric, F.col("query"), F.col("value")))
    return out if least is None else out.where(F.col("score") >= least)


def best_matches(queries: DataFrame, candidates: DataFrame, query: str, column: str, key: str, metric: str = "best_match") -> DataFrame:
    """Each distinct query's best candidate: query, key, score; of equal ones the last key.

    Without candidates the key is null and the score 0.
    """
    scores = pair_scores(queries, candidates, query, column, metric)
    last = candidates.groupBy(F.col(column).alias("value")).agg(F.max(key).alias(key))
    best = scores.join(last, "value").groupBy("query").agg(F.max(F.struct("score", F.col(key))).alias("__best"))
    asked = queries.select(F.col(query).alias("query")).distinct()
    return asked.join(best, "query", "left").select("query", F.col(f"__best.{key}").alias(key), F.coalesce("__best.score", F.lit(0.0)).alias("score"))


def top_matches(queries: DataFrame, candidates: DataFrame, query: str, column: str, key: str, k: int = 3, metric: str = "best_match", ignore_case: bool = True) -> DataFrame:
    """Each distinct query's k best candidates: query, rank, key, score; of equal ones the first keys."""
    prepare = F.lower if ignore_case else (lambda c: c)
    asked, known = queries.select(prepare(F.col(query)).alias("query")), candidates.select(F.col(key), prepare(F.col(column)).alias("value"))
    order = Window.partitionBy("value").orderBy(key)
    few = known.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    ranked = pair_scores(asked, known, "query", "value", metric).join(few, "value")
    best = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", key, "score")


def live_search(candidates: DataFrame, query: str, column: str, least: float = 0.3) -> DataFrame:
    """Each candidate's best of three metrics, and which it is; nothing for a blank query."""
    query = query.strip()
    if not query:
        return candidates.limit(0).selectExpr("*", "cast(null as double) as score", "cast(null as string) as metric")
    q, own = F.lit(query.lower()), F.lower(F.col(column))
    h = simhash_text(query)
    one = candidates.withColumns({"__jw": metrics.jaro_winkler(q, own), "__nl": metrics.normalized_levenshtein(q, own), "__sh": hash_similarity(simhash(F.col(column)), F.lit(h - (1 << 64) if h >> 63 else h))})
    jw, nl, sh = F.col("__jw"), F.col("__nl"), F.col("__sh")
    name = F.when((nl >= jw) & (nl >= sh), "normalized_levenshtein").when((sh >= jw) & (sh >= nl), "simhash").otherwise("jaro_winkler")
    return one.withColumns({"score": F.greatest(jw, nl, sh), "metric": name}).where(F.col("score") >= least).drop("__jw", "__nl", "__sh").orderBy(F.desc("score"), column)


def compare_all(df: DataFrame, a: str, b: str) -> DataFrame:
    """All metrics of each pair."""
    x, y = F.col(a), F.col(b)
    return df.withColumns(
        {
            "levenshtein": metrics.levenshtein(x, y),
            "normalized_levenshtein": metrics.normalized_levenshtein(x, y),
            "osa": metrics.osa_distance(x, y),
            "jaro": metrics.jaro(x, y),
            "jaro_winkler": metrics.jaro_winkler(x, y),
            "hamming": metrics.hamming(x, y),
            "simhash_similarity": hash_similarity(simhash(x), simhash(y)),
        }
    ).withColumn("transposed", F.col("osa") < F.col("levenshtein"))


def hash_search(df: DataFrame, query: str | int, column: str = "hash", key: str = "id", most: int = 10, limit: int | None = 20, compat_range: bool = False) -> DataFrame:
    """Rows by distance of their stored hash from the query's, nearest first.

    ``compat_range`` first keeps a numeric range around the query's hash and
    100 rows of it, as an index on plain numbers would; it loses matches.
    """
    h = simhash_text(query) if isinstance(query, str) else query & ((1 << 64) - 1)
    if compat_range:
        number = F.conv(F.hex(column), 16, 10).cast("decimal(20,0)")
        df = df.where(number.between(*(F.lit(Decimal(x)) for x in (max(0, h - (1 << most)), h + (1 << most))))).orderBy(key).limit(100)
    distance = simhash_distance(F.col(column), F.lit(h - (1 << 64) if h >> 63 else h))
    found = df.withColumn("distance", distance).where(F.col("distance") <= most).withColumn("similarity", 1 - F.col("distance") / 64.0).orderBy("distance", key)
    return found if limit is None else found.limit(limit)


def text_hash_search(df: DataFrame, query: str, column: str, key: str = "id", most: int = 10, limit: int | None = 20) -> DataFrame:
    """As ``hash_search``, hashing the texts on the way; null texts as empty ones."""
    return hash_search(df.withColumn("hash", simhash(F.coalesce(F.col(column), F.lit("")))), query, "hash", key, most, limit)


def with_hashes(df: DataFrame, column: str, name: str = "simhash") -> DataFrame:
    """``df`` with the hash of a text column, once per distinct text."""
    some = df.select(F.col(column).alias("__text")).where(F.col("__text").isNotNull()).distinct().withColumn(name, simhash("__text"))
    return df.join(some, df[column] == some["__text"], "left").drop("__text")
