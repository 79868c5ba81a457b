"""Facts that follow a source tree: a keyed snapshot is compared with the folder, and only what changed is read and parsed.

A table of facts is a folder with `facts` and `files` (the snapshot), both
dealt to buckets by path and written anew per touched bucket, as a version of
it, and `done`, a row for each version that counts. What a stopped run wrote
counts for nothing, and the next run writes it again.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.stages import dealt, stage
from .readers import SKIPPED

#: Buckets of a table; changed files that are read by name; milliseconds a clock of files may stand still, so that a file this young is read again.
BUCKETS, NAMED, RACY = 64, 10_000, 2_000
FILES = "path string, modified timestamp, bytes bigint, digest string, checked timestamp"
DONE = "kind string, bucket int, version bigint"


class Refresh(NamedTuple):
    """Files of a refresh: looked at, read, parsed (their content is new) and gone."""

    present: int
    read: int
    parsed: int
    gone: int


def _base(folder: str) -> str:
    return re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/"))


def _binary(spark: SparkSession, folder: str, suffix: str, paths: list[str] | None = None) -> DataFrame:
    """binaryFile rows of a folder or of some of its files; content is read only where it is selected."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if paths is None:
        raw = read.load(folder)
    else:
        escape = lambda p: re.sub(r"([{}\[\]*?\\])", r"\\\1", p)
        raw = read.load([f"{folder.rstrip('/')}/{escape(p)}" for p in paths])
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(_base(folder)) + "/", "")
    raw = raw.withColumn("path", relative)
    return raw.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(*SKIPPED)))


def listing(spark: SparkSession, folder: str, suffix: str = ".py") -> DataFrame:
    """(path, modified, bytes) of the sources below a folder, without reading them; hidden and skipped folders are left out."""
    return _binary(spark, folder, suffix).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of a listing and a snapshot: new, changed, gone; unsure where a file was so young when it was read that a later edit may look the same; else same."""
    b = before.select("path", F.col("modified").alias("was"), F.col("bytes").alias("had"), "checked")
    young = F.unix_millis("modified") >= F.unix_millis("checked") - RACY
    change = (F.when(F.col("checked").isNull(), "new").when(F.col("modified").isNull(), "gone")
              .when((F.col("modified") != F.col("was")) | (F.col("bytes") != F.col("had")), "changed").when(young, "unsure").otherwise("same"))
    return now.join(b, "path", "full_outer").select("path", change.alias("change"))


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, table: str) -> list[tuple[str, int, int]]:
    """(kind, bucket, version) that count: a row per kind and bucket."""
    try:
        done = spark.read.schema(DONE).option("recursiveFileLookup", True).parquet(f"{table}/done")
        return [tuple(r) for r in done.groupBy("kind", "bucket").agg(F.max("version")).collect()]
    except AnalysisException:  # nothing written yet
        return []


def _current(spark: SparkSession, table: str, kind: str, schema: StructType, last: list[tuple[str, int, int]], buckets: list[int] | None = None) -> DataFrame:
    wanted = [(b, v) for k, b, v in last if k == kind and (buckets is None or b in buckets)]
    if not wanted:
        return spark.createDataFrame([], schema)
    counts = reduce(or_, [(F.col("bucket") == b) & (F.col("version") == v) for b, v in wanted])
    rows = spark.read.schema(StructType([*schema.fields, StructField("version", LongType()), StructField("bucket", IntegerType())]))
    return rows.parquet(f"{table}/{kind}").where(counts).select(*schema.names)


def _ddl(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def current(spark: SparkSession, table: str, schema: str | StructType) -> DataFrame:
    """The facts that count."""
    return _current(spark, table, "facts", _ddl(schema), _versions(spark, table))


def refresh(spark: SparkSession, folder: str, table: str, parse: Callable[[DataFrame], DataFrame], schema: str | StructType, suffix: str = ".py", buckets: int = BUCKETS) -> Refresh:
    """Bring a table of facts up to a folder: parse gives the facts (path, ...) of texts (path, text).

    New files, files of another time or size, and files that were young when
    they were read are read again, and parsed if their content differs. Facts
    of vanished files go. A file that vanishes or changes while this runs is
    met by the next run. buckets must stay the same for a table.
    """
    facts, files = _ddl(schema), StructType.fromDDL(FILES)
    last = _versions(spark, table)
    n = 1 + max((v for _, _, v in last), default=0)
    before = _current(spark, table, "files", files, last)
    began = time.time()
    changes = stage(compared(listing(spark, folder, suffix), before))
    by_change = dict(changes.groupBy("change").count().collect())
    present = sum(by_change.values()) - by_change.get("gone", 0)
    to_read = changes.where("change IN ('new', 'changed', 'unsure')").select("path")
    many = sum(by_change.get(k, 0) for k in ("new", "changed", "unsure"))
    if not many and not by_change.get("gone"):
        return Refresh(present, 0, 0, 0)
    if not many:
        texts = spark.createDataFrame([], "path string, modified timestamp, bytes bigint, digest string, text string")
    else:
        # few are opened by name; of many the folder is read and the others left out
        raw = _binary(spark, folder, suffix, [r[0] for r in to_read.collect()]) if many <= NAMED else _binary(spark, folder, suffix).join(to_read, "path", "left_semi")
        texts = stage(raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"),
                                 F.make_valid_utf8(F.col("content").cast("string")).alias("text")))
    known = before.select("path", F.col("digest").alias("was"))
    news = texts.join(known, "path", "left").where("NOT digest <=> was").select("path", "text")
    gone = changes.where("change = 'gone'").select("path")
    parsed = stage(news)
    out = parsed.select("path").union(gone)
    lists = {"facts": out, "files": texts.select("path").union(gone)}
    touched = {k: [r[0] for r in v.select(_bucket(F.col("path"), buckets)).distinct().collect()] for k, v in lists.items()}  # `buckets` at most
    seen = texts.select("path", "modified", "bytes", "digest", F.timestamp_millis(F.lit(int(began * 1000))).alias("checked"))
    for kind, kind_schema, new in (("facts", facts, parse(parsed)), ("files", files, seen)):
        if touched[kind]:
            kept = _current(spark, table, kind, kind_schema, last, touched[kind]).join(lists[kind], "path", "left_anti")
            new.select(*kind_schema.names).unionByName(kept).withColumn("bucket", _bucket(F.col("path"), buckets)).repartition(
                min(len(touched[kind]), 64), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/{kind}/version={n}")
    # one file, so all of it counts or nothing does
    spark.createDataFrame([(k, b, n) for k, bs in touched.items() for b in bs], DONE).coalesce(1).write.mode("overwrite").parquet(f"{table}/done/batch={n}")
    return Refresh(present, texts.count(), parsed.count(), by_change.get("gone", 0))


def fresh(spark: SparkSession, folder: str, table: str, parse: Callable[[DataFrame], DataFrame], schema: str | StructType, suffix: str = ".py") -> DataFrame:
    """The facts after a refresh: what a query reads that must not be behind its sources."""
    refresh(spark, folder, table, parse, schema, suffix)
    return current(spark, table, schema)


def watch(spark: SparkSession, folder: str, table: str, parse: Callable[[DataFrame], DataFrame], schema: str | StructType, checkpoint: str, every: str = "10 seconds", suffix: str = ".py"):
    """A running query that refreshes again and again; the stream is a clock, and what it refreshes is the folder's state."""

    def tick(_: DataFrame, __: int) -> None:
        refresh(spark, folder, table, parse, schema, suffix)

    return spark.readStream.format("rate").load().writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def write_files(texts: DataFrame, folder: str) -> int:
    """Write each text (path, text) as a file below a folder that all tasks reach; a null text deletes. The number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = f"{base.rstrip('/')}/{path}"
                if text is None:
                    if fs.get_file_info(at).is_file:
                        fs.delete_file(at)
                    continue
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return dealt(texts.select("path", "text"), "path").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
