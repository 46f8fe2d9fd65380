"""String distances and similarities as columns; characters are code points.

Levenshtein and Hamming are built-in expressions; Jaro and the restricted
Damerau distance go to Arrow-batched kernels.  Null in either string gives
null.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from simloom.functions import pairs

_BLANK = r"\p{IsWhite_Space}+"


@dataclass(frozen=True)
class SimilarityOptions:
    """How strings are prepared; ``prefix_scale`` is only for Jaro-Winkler."""

    case_sensitive: bool = True
    trim_whitespace: bool = False
    prefix_scale: float = 0.1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def levenshtein(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_col(a), _col(b))


def _share(distance: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - distance / longest)


def normalized_levenshtein(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return _share(F.levenshtein(a, b), a, b)


def prepared(c: Column | str, options: SimilarityOptions) -> Column:
    """Trimmed (any Unicode white space) first, then in small letters."""
    c = _col(c)
    if options.trim_whitespace:
        c = F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")
    return c if options.case_sensitive else F.lower(c)


def levenshtein_with_options(a: Column | str, b: Column | str, options: SimilarityOptions) -> Column:
    return F.levenshtein(prepared(a, options), prepared(b, options))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Positions that differ; null if lengths do."""
    a, b = _col(a), _col(b)
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def normalized_hamming(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, F.lit(1.0))).otherwise(1.0 - hamming(a, b) / F.length(a))


def osa_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein with swaps of neighbours, none edited twice."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        d = pairs.osa_distances(x.tolist(), y.tolist())
        return pd.Series(d).astype("Int64").mask(d < 0)

    return F.pandas_udf(run, "int")(_col(a), _col(b))


def normalized_osa(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return _share(osa_distance(a, b), a, b)


def jaro(a: Column | str, b: Column | str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(pairs.jaro_scores(x.tolist(), y.tolist()))

    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.pandas_udf(run, "double")(a, b))


def jaro_winkler(a: Column | str, b: Column | str, prefix_scale: float = 0.1) -> Column:
    """Jaro, from 0.7 with a bonus for a common prefix; the scale is held at 0.25."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = x.tolist(), y.tolist()
        return pd.Series(pairs.prefix_bonus(pairs.jaro_scores(left, right), left, right, prefix_scale))

    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.pandas_udf(run, "double")(a, b))


def best_match(a: Column | str, b: Column | str) -> Column:
    """The greater of normalised Levenshtein and Jaro-Winkler."""
    return F.greatest(normalized_levenshtein(a, b), jaro_winkler(a, b))


#: Bounds from lengths alone: a pair below can't reach the score.
def _ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def may_reach(metric: str, a: Column | str, b: Column | str, score: float) -> Column:
    """A cheap condition that every pair with at least ``score`` fulfils."""
    a, b = _col(a), _col(b)
    slack = 1e-9
    both_empty = (F.length(a) == 0) & (F.length(b) == 0)
    if metric == "normalized_levenshtein":
        return both_empty | (_ratio(a, b) >= score - slack)
    if metric == "jaro":
        return both_empty | (_ratio(a, b) >= 3 * score - 2 - slack)
    if metric in ("jaro_winkler", "best_match"):
        return both_empty | (_ratio(a, b) >= 5 * score - 4 - slack)
    return F.lit(True)


#: Metrics in built-in expressions.
BUILT_IN = frozenset({"levenshtein", "normalized_levenshtein", "normalized_hamming"})
METRICS = {"levenshtein": normalized_levenshtein, "normalized_levenshtein": normalized_levenshtein, "jaro": jaro, "jaro_winkler": jaro_winkler, "best_match": best_match, "normalized_osa": normalized_osa, "normalized_hamming": normalized_hamming}
