"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import scratch as scratch
from ..plans.stages import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder (see plans.stages.stage).

    Cuts the lineage, and work done once isn't repeated by later readers. A
    lost executor costs only the tasks it ran. Spark keeps the shuffle files of
    the plan until the driver's garbage collector finds that nobody refers to
    it, which may be hours; several times the input would lie on the executors'
    disks by then, so it is asked to look.
    """
    spark = df.sparkSession
    out = stage(df, codec)
    del df
    gc.collect()
    jvm = getattr(spark, "_jvm", None)  # none with Spark Connect, whose server looks after itself
    if jvm is not None:
        jvm.System.gc()
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) of each run of rows alike in their first `keys` columns, whole numbers without nulls; no more than a run is held beside its batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        names = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(keys)])
        cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            name = tuple(names[:, start].tolist())
            if held and name != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(start, end - start))
            last = name
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def longs(rows: Iterator[tuple], names: list[str], step: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tuples of whole numbers in batches of `step`."""
    while some := list(islice(rows, step)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], pa.int64()) for i in range(len(names))], names=names)


def unused(name: str, columns: list[str]) -> str:
    """A name like the given one that no column has, whatever its case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]], step: int = 512) -> DataFrame:
    """The rows whose text passes, with all columns as they are and no shuffle; make gives a task its test of texts."""
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                yield part.filter(pa.array(test(part.column(at_text).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def connected(ids: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): component is the smallest id reachable over edges (a, b).

    Hash-to-min on the edge set: alternating large-star and small-star steps,
    each one a shuffle of at most the edge count, until the set of edges is
    stable. Ids without an edge are their own component. Runs O(log n) rounds
    and raises if max_rounds don't suffice.
    """
    e = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    digest = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points to u's smallest neighbour or u itself
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: smaller neighbours of u, and u, point to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        e = settle(small)
        now = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).collect()[0]
        now = (now[0], now[1])
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return (
        ids.join(low, ids["id"] == low["u"], "left")
        .select("id", F.coalesce("m", "id").alias("component"))
    )
