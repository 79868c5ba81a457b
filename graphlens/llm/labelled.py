"""What the two classifiers share: the held-out fold and a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most `most` labelled documents outside the held-out fold.

    Half the places at most go to either label while the other has enough. The first by a hash of
    the id are taken. Of repeated ids the largest label and text count; null
    ids, labels and texts are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    half = most // 2
    chosen = []
    for y in (1, 0):
        chosen.append(known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(most).collect())
    take = [c[:max(half, most - len(other))] for c, other in zip(chosen, chosen[::-1])]
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for c in take for r in c], "doc_id bigint, y int")
    # at most `most` rows, so the broadcast is bounded
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(ids), "doc_id").where("text IS NOT NULL")
        .groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    )
    return sorted((r.doc_id, r.text, r.y) for r in rows.select("doc_id", "text", "y").toLocalIterator())


def scored(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted); make gives a task its scorer of texts."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    got = rows.mapInArrow(run, "doc_id bigint, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
