"""A postings index kept as a table: terms dealt to parts, entries in blocks with what bounds their scores, upkeep by segments.

A folder holds `postings` (by segment and part, sorted by term), `dead`
(entries that a later segment replaced or removed) and `stats`, whose row
makes a segment count. A query reads the parts of its terms alone.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import stage
from .search import K1, B, tokens

#: Parts that terms are dealt to; ids of a block.
PARTS, BLOCK = 64, 4096
DEAD = "id bigint, segment bigint"
STATS = "segment bigint, n bigint, total bigint"


class Term(NamedTuple):
    """A query's term: documents that have it, its weight, and the most that any entry of it can add to a score."""

    term: str
    df: int
    idf: float
    most: float


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def _entries(docs: DataFrame) -> DataFrame:
    """(part, term, block, n, max_tf, min_len, entries) of documents (id, text), whose ids are distinct.

    A document's terms are counted in its own row, by sorting them.
    """
    t = docs.select("id", F.sort_array(tokens("text")).alias("ts")).where(F.size("ts") > 0)
    ts, at = F.col("ts"), F.col("at")
    t = t.withColumn("at", F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i) != F.get(ts, i - 1))))
    runs = F.transform(at, lambda i, k: F.struct(F.get(ts, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ts)) - i).alias("tf")))
    tf = t.select("id", F.size(ts).alias("len"), F.inline(runs))
    return _blocks(tf.select(_part(F.col("term")).alias("part"), "term", F.floor(F.col("id") / BLOCK).alias("block"), "id", "tf", "len"))


def _blocks(entries: DataFrame) -> DataFrame:
    """(part, term, block, n, max_tf, min_len, entries), in that order: a row for a term and BLOCK ids at most.

    Entries are dealt by ranges, so a task holds its share of them whatever
    their terms are; blocks are made where they lie.
    """
    return entries.repartitionByRange("part", "term", "block").groupBy("part", "term", "block").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list(F.struct("id", "tf", "len")).alias("entries")).sortWithinPartitions(
        "part", "term", "block")


def upsert(docs: DataFrame, folder: str) -> None:
    """Documents (id, text) come into the index of a folder, in place of what it has of their ids; a null text only removes.

    Ids are whole numbers; of repeated ones the greatest text counts. What is
    written counts once the segment's row of stats is there, so a run that
    was stopped leaves the index as it was.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("id").cast("bigint").alias("id"), "text").where("id IS NOT NULL").groupBy("id").agg(F.max("text").alias("text"))
    stats = _read(spark, f"{folder}/stats", STATS)
    known = [r[0] for r in stats.select("segment").collect()]  # one a call
    n = 1 + max(known, default=-1)
    ids = docs.select("id")
    gone_n = gone_total = 0
    if known:
        lens = _read(spark, f"{folder}/lens", "id bigint, len int, segment bigint").where(F.col("segment").isin(known))
        dead = _read(spark, f"{folder}/dead", DEAD + ", by bigint").where(F.col("by").isin(known))
        gone = stage(lens.join(ids, "id", "left_semi").join(dead, ["id", "segment"], "left_anti"))
        gone.select("id", "segment", F.lit(n).cast("bigint").alias("by")).write.mode("overwrite").parquet(f"{folder}/dead/by={n}")
        gone_n, gone_total = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    new = docs.where("text IS NOT NULL")
    lens = new.select("id", F.size(tokens("text")).alias("len"), F.lit(n).cast("bigint").alias("segment"))
    lens.write.mode("overwrite").parquet(f"{folder}/lens/of={n}")
    # terms in order, so that row groups can be passed over, and each part's files few
    _entries(new).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings/segment={n}")
    count, total = spark.read.parquet(f"{folder}/lens/of={n}").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    spark.createDataFrame([(n, count - gone_n, total - gone_total)], STATS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats/of={n}")


def _gain(tf: Column, length: Column, mean: float) -> Column:
    """What an entry adds to a score for each unit of its term's weight: more with tf, less with length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _of_terms(spark: SparkSession, folder: str, query: str, segments: list[int]) -> DataFrame:
    """The blocks of a query's terms: only their parts are read."""
    wanted = spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("term")).select("term", _part(F.col("term"))).collect()  # as long as the query
    rows = spark.read.option("basePath", f"{folder}/postings").parquet(*[f"{folder}/postings/segment={s}" for s in segments])
    return rows.where(F.col("part").isin([p for _, p in wanted]) & F.col("term").isin([t for t, _ in wanted]))


def search(spark: SparkSession, folder: str, query: str, most: int = 20, skip: bool = True) -> DataFrame:
    """(id, score): the best documents by BM25; ties by id.

    The strongest term's entries give a score that `most` documents reach;
    blocks are passed over (skip) if their own bound and all other terms'
    together stay below it. Scores are the same either way.
    """
    stats = _read(spark, f"{folder}/stats", STATS).collect()
    empty = spark.createDataFrame([], "id bigint, score double")
    n, total, segments = sum(r.n for r in stats), sum(r.total for r in stats), sorted(r.segment for r in stats)
    if n <= 0 or total <= 0:
        return empty
    mean = total / n
    blocks = _of_terms(spark, folder, query, segments)
    dead = _read(spark, f"{folder}/dead", DEAD + ", by bigint").where(F.col("by").isin(segments)).select("id", "segment") if len(segments) > 1 else None
    live = lambda rows: rows if dead is None else rows.join(dead, ["id", "segment"], "left_anti")
    opened = lambda rows: live(rows.select("segment", "term", F.inline("entries")))
    bound = _gain(F.col("max_tf"), F.col("min_len"), mean)
    found = dict((r.term, r) for r in blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(bound).alias("bound")).collect())
    if dead is not None:
        counts = {r.term: r.df for r in opened(blocks).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        found = {t: r for t, r in found.items() if t in counts}
    else:
        counts = {t: r.df for t, r in found.items()}
    if not found:
        return empty
    terms = []
    for t, r in found.items():
        idf = math.log(1 + (n - counts[t] + 0.5) / (counts[t] + 0.5))
        terms.append(Term(t, counts[t], idf, idf * r.bound))
    weight = F.create_map(*[x for t in terms for x in (F.lit(t.term), F.lit(t.idf))])[F.col("term")]
    if skip and sum(t.df for t in terms) > most:
        lead = max(terms, key=lambda t: t.most)
        own = opened(blocks.where(F.col("term") == lead.term)).select((weight * _gain(F.col("tf"), F.col("len"), mean)).alias("s")).orderBy(F.desc("s")).limit(most).collect()
        if len(own) == most:
            rest = F.create_map(*[x for t in terms for x in (F.lit(t.term), F.lit(sum(o.most for o in terms if o is not t)))])[F.col("term")]
            blocks = blocks.where(weight * bound + rest >= own[-1].s - 1e-9)
    scored = opened(blocks).groupBy("id").agg(F.sum(weight * _gain(F.col("tf"), F.col("len"), mean)).alias("score"))
    return scored.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(most)


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """The index of a folder as one segment of another, without dead entries."""
    stats = _read(spark, f"{folder}/stats", STATS).collect()
    segments = [r.segment for r in stats]
    rows = spark.read.option("basePath", f"{folder}/postings").parquet(*[f"{folder}/postings/segment={s}" for s in segments])
    dead = _read(spark, f"{folder}/dead", DEAD + ", by bigint").where(F.col("by").isin(segments)).select("id", "segment")
    lens = _read(spark, f"{folder}/lens", "id bigint, len int, segment bigint").where(F.col("segment").isin(segments)).join(dead, ["id", "segment"], "left_anti")
    e = _blocks(rows.select("segment", "part", "term", "block", F.inline("entries")).join(dead, ["id", "segment"], "left_anti"))
    e.write.mode("overwrite").partitionBy("part").parquet(f"{to}/postings/segment=0")
    lens.select("id", "len", F.lit(0).cast("bigint").alias("segment")).write.mode("overwrite").parquet(f"{to}/lens/of=0")
    spark.createDataFrame([(0, sum(r.n for r in stats), sum(r.total for r in stats))], STATS).coalesce(1).write.mode("overwrite").parquet(f"{to}/stats/of=0")
