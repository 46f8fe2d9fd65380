"""Reading inputs and writing tables that later scans can prune."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.vectors import parse_vector

#: Rows of a range-partitioned output file.
ROWS_PER_FILE = 5_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or a local one in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="simloom-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Parquet, JSON lines, CSV with a header, or ORC."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind not in ("parquet", "json", "orc"):
        raise ValueError(f"format {kind}")
    return getattr(reader, kind)(path)


def images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """path and content of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def vectors_from_text(df: DataFrame, column: str, name: str = "embedding") -> DataFrame:
    """A vector column from JSON arrays or lists of numbers."""
    return df.withColumn(name, parse_vector(column))


def write_by_id(df: DataFrame, path: str, column: str = "id", files: int | None = None) -> None:
    """Parquet in order of IDs, so that prefix and range scans skip files and row groups."""
    n = files or max(1, -(-df.count() // ROWS_PER_FILE))
    df.repartitionByRange(n, column).sortWithinPartitions(column).write.mode("overwrite").parquet(path)


def write_by_band(bands: DataFrame, name: str, buckets: int = 64) -> None:
    """A band table bucketed by place and band, so that later joins don't shuffle it."""
    bands.write.mode("overwrite").bucketBy(buckets, "band_idx", "band").sortBy("band_idx", "band").saveAsTable(name)


def with_stored_hash(df: DataFrame, path: str, text: str, name: str = "simhash") -> DataFrame:
    """Back-fill: ``df`` with its text's hash, written in order of the hash."""
    from simloom.operators.search import with_hashes

    with_hashes(df, text, name).repartitionByRange(F.col(name)).sortWithinPartitions(name).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
