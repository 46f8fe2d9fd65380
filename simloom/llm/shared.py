"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is
    unset (local tests) a temporary folder is made and named there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = spark.conf.get("spark.simloom.checkpoint.dir", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="simloom-")
        spark.conf.set("spark.simloom.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._simloom_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for table in tables:
        path = getattr(table, "_simloom_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Delete the shuffle files of plans that are done.

    Spark does so once the driver's collector finds them dead, for which a
    driver with memory to spare has no reason to look.
    """
    gc.collect()
    spark._jvm.System.gc()


def slices(batches, rows: int = 1024):
    """Arrow batches cut to so many rows, so that few texts are Python objects at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def trimmed() -> None:
    """Give memory that is free, but still held by Arrow and the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A batch function that gives its memory back to the system when its task ends.

    Python workers outlive tasks; what they keep would add up over stages.
    """

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        trimmed()

    return wrapped


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text):
    """Number of words in a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of an Arrow batch between Spark and Python; texts may be long.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS``, which bounds buffers on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
