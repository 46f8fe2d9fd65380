"""Scans of stored IDs by prefix and range; both reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.profiles import Profile
from simloom.functions.vectors import profile_prefix


def by_prefix(df: DataFrame, prefix: str, column: str = "id", limit: int | None = None) -> DataFrame:
    """Rows whose ID starts with ``prefix``, header included, in order."""
    found = df.where(F.col(column).startswith(prefix)).orderBy(column)
    return found if limit is None else found.limit(limit)


def by_range(df: DataFrame, low: str, high: str, column: str = "id", limit: int | None = None) -> DataFrame:
    """Rows between two IDs, both inclusive, in order."""
    found = df.where(F.col(column).between(low, high)).orderBy(column)
    return found if limit is None else found.limit(limit)


def of_profile(df: DataFrame, profile: Profile, column: str = "id") -> DataFrame:
    """Rows whose IDs were made under a profile's type."""
    return df.where(F.col(column).startswith(profile_prefix(profile)[:2]))
