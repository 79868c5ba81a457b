"""Streams: telemetry counters, event-time windows, and an index that follows its sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.stages import stage

#: Parts that a followed table's files are dealt to, and what is noted of each that was written.
BUCKETS, DONE = 64, "bucket int, version bigint"
CALLS = "call_id bigint, tool string, project_id bigint, ok boolean, duration_ms double, at timestamp"


def read_calls(spark: SparkSession, folder: str, schema: str = CALLS, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def counters(calls: DataFrame) -> DataFrame:
    """(tool, calls, errors, first_at, last_at), updated as calls arrive."""
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"),
                                     F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def tumbling(calls: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, tool, calls, mean_ms) by event time; rows later than `late` are dropped. An addition to the reference's operators."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    out = calls.withWatermark("at", late).groupBy(w.alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.avg("duration_ms").alias("mean_ms"))
    return out.select(F.col("w.start").alias("start"), "tool", "calls", "mean_ms")


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, project_id, calls): calls of a project with no pause longer than gap. An addition."""
    s = F.session_window("at", gap)
    out = calls.withWatermark("at", late).groupBy(s.alias("w"), "project_id").agg(F.count(F.lit(1)).alias("calls"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "project_id", "calls")


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there into a memory table; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def _bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def follow_sources(sources: DataFrame, table: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Keep a table of facts current with a stream of sources (path, text).

    Each micro-batch replaces the facts of its files; the last version of a
    file in a batch counts. Facts are dealt to BUCKETS by path and only buckets
    with changed files are written anew, as the batch's version of them. A row
    in the table's list of what is done makes them count, so a batch that was
    stopped half way leaves nothing behind, and its second run the same.
    """

    def replace(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        latest = stage(batch.groupBy("path").agg(F.max_by("text", "modified").alias("text")))
        touched = [r[0] for r in latest.select(_bucket(F.col("path"))).distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        new = parse(latest)
        kept = current(spark, table, new.schema, n, touched).join(latest.select("path"), "path", "left_anti")
        new.unionByName(kept).withColumn("bucket", _bucket(F.col("path"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/facts/version={n}")
        spark.createDataFrame([(b, n) for b in touched], DONE).coalesce(1).write.mode("overwrite").parquet(f"{table}/done/batch={n}")

    return sources.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, schema: str | StructType, below: int = 1 << 60, buckets: list[int] | None = None) -> DataFrame:
    """The facts that count in a table that follow_sources keeps: each bucket's last version."""
    schema_of = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        done = spark.read.schema(DONE).option("recursiveFileLookup", True).parquet(f"{table}/done")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema_of)
    last = [(r[0], r[1]) for r in done.where(F.col("version") < below).groupBy("bucket").agg(F.max("version")).collect()]  # BUCKETS at most
    wanted = [(b, v) for b, v in last if buckets is None or b in buckets]
    if not wanted:
        return spark.createDataFrame([], schema_of)
    counts = reduce(or_, [(F.col("bucket") == b) & (F.col("version") == v) for b, v in wanted])
    facts = spark.read.schema(StructType([*schema_of.fields, StructField("version", LongType()), StructField("bucket", IntegerType())]))
    return facts.parquet(f"{table}/facts").where(counts).select(*schema_of.names)


def refreshed(sources: DataFrame, table: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, schema: str) -> DataFrame:
    """The table of facts after all changed sources that are there now: what a query that needs fresh facts reads."""
    follow_sources(sources, table, parse, checkpoint).awaitTermination()
    return current(sources.sparkSession, table, schema)


def backed_off(failures: DataFrame, now: DataFrame, seconds: int = 60) -> DataFrame:
    """(kind, tries, due) of a stream or table of failures (kind, at) beside a table of times (at): kinds and when they may be tried again."""
    last = failures.groupBy("kind").agg(F.count(F.lit(1)).alias("tries"), F.max("at").alias("failed_at"))
    due = F.col("failed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return last.select("kind", "tries", due.alias("due")).join(F.broadcast(now.agg(F.max("at").alias("now"))), F.lit(True)).select(
        "kind", "tries", "due", (F.col("now") >= F.col("due")).alias("may_run"))
