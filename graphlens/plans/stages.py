"""Tables between the steps of iterative plans, in the folder all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; it goes when the driver's Python ends.

    A session on one machine without the setting (as in tests) gets a
    temporary folder, which is entered in it. On a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/graphlens-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def drop(path: str) -> None:
    """Delete a folder that scratch() made, where its store can be reached from here."""
    _made.discard(path)
    try:
        fs, local = pafs.FileSystem.from_uri(path)
        fs.delete_dir(local)
    except (OSError, ValueError):
        pass  # never written, already gone, or a store of Spark's own


@atexit.register
def _drop_all() -> None:
    for path in list(_made):
        drop(path)


def stage(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written to spark.checkpoint.dir and read back: lineage ends, and a lost executor costs its tasks alone."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """a joined with b by shuffle and sort, at every size.

    For loops and chains of joins over tables that grow with the input: each
    would be broadcast as long as it is below Spark's threshold, and what
    passes through the driver is the sum over all steps.
    """
    return a.join(b.hint("merge"), on, how)


def dealt(df: DataFrame, *by: str, parts: int = 1) -> DataFrame:
    """df dealt by columns to all tasks, and to `parts` at least, however few bytes it has: for rows that cost much more to work on than to move."""
    spark = df.sparkSession
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def counted(df: DataFrame, found: Column | None = None, codec: str = "snappy") -> tuple[DataFrame, int]:
    """stage(df) and its number of rows (of those for which found is true), which the job that writes it counts."""
    seen = Observation()
    what = F.count(F.lit(1)) if found is None else F.count_if(found)
    return stage(df.observe(seen, what.alias("n")), codec), seen.get["n"]


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df as a local table that may be broadcast; an error if it has more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a few are meant")
    return df.sparkSession.createDataFrame(rows, df.schema)
