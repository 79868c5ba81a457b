"""A trie of conversation prefixes, its subtrees summed by leaf-peeling messages.

A prefix is named by two 64-bit hashes: each turn hashes with its place, and
the hashes of the first d turns are joined by exclusive or, so a window gives
the names of all prefixes. Texts are hashed where they are read; only hashes
and word counts move.

Peeling a trie level by level takes as many rounds as its longest
conversation has turns. So chains go at once: each node belongs to the member
with the least hashed id, and the nodes of one member are a chain down to its
end. Chains hold a counter of the chains that hang from them; those without
any send their totals to the chain they hang from, until the root's is done.
A path from the root changes chains about ln(members) times, so rounds grow
with the logarithm of the conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .sql import CRC_TABLE, crc32

#: Conversations that share a start, and the most turns shared.
FAMILY, SHARED = 20, 4
#: Characters of a piece of a list of ids.
PIECE = 1 << 16
KEY = ["k1", "k2"]


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, e1, e2, words) of rebuilt turns, from 1, and (conv_id) of all conversations.

    Rows without a conv_id are left out. Turns go by turn (null first); ties
    go by the first 64 characters of role and of text, then by hashes of all,
    so they have one order. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    h = [F.xxhash64(F.lit(seed), "role", "text") for seed in (1, 2)]
    n_words = F.size(F.array_remove(F.split("text", "[ \t-\r]+"), "")).cast("bigint")
    rows = rows.select("conv_id", "turn", F.substring("role", 1, 64).alias("role"), F.substring("text", 1, 64).alias("text"), h[0].alias("h1"), h[1].alias("h2"), n_words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "h1", "h2")
    own = common.settle(rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "h1", "h2", "words"))
    convs = common.settle(own.select("conv_id").distinct().withColumn("h", shared_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY))
    first = own.where(F.col("pos") < SHARED).withColumnRenamed("conv_id", "base")
    start = convs.join(first, "base").where("pos <= h").select("conv_id", "pos", "h1", "h2", "words")
    taken = start.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    rest = (own.join(convs.select("conv_id", "h"), "conv_id").where("pos > h").join(taken, "conv_id", "left")
            .select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("taken", F.lit(0))).cast("int").alias("pos"), "h1", "h2", "words"))
    at = start.unionByName(rest)
    return at.select("conv_id", "pos", F.xxhash64("pos", "h1", "h2").alias("e1"), F.xxhash64("h2", "h1", "pos").alias("e2"), "words"), convs.select("conv_id")


def places(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, at_end): each rebuilt conversation at each node on its way, from the root on; p1, p2 name the parent."""
    turns, convs = rebuilt(conversations)
    w = Window.partitionBy("conv_id").orderBy("pos")
    along = turns.select("conv_id", F.col("pos").alias("depth"), F.bit_xor("e1").over(w).alias("k1"), F.bit_xor("e2").over(w).alias("k2"), "e1", "e2", "words",
                         F.lead("pos").over(w).isNull().alias("at_end"))
    along = along.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"), "words", "at_end")
    none = F.lit(None).cast("bigint")
    roots = convs.join(turns.where("pos = 1").select("conv_id", F.lit(False).alias("at_end")), "conv_id", "left").select(
        "conv_id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), none.alias("p1"), none.alias("p2"),
        F.lit(0).cast("bigint").alias("words"), F.coalesce("at_end", F.lit(True)).alias("at_end"))
    return along.unionByName(roots)


def nodes(at: DataFrame) -> DataFrame:
    """(k1, k2, depth, p1, p2, conv_id, n_convs, n_children, saved, chain): one row per node; saved is the node's own."""
    found = at.groupBy(*KEY).agg(
        F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.first("words").alias("words"), F.min(F.struct(F.xxhash64("conv_id").alias("h"), "conv_id"))["conv_id"].alias("chain"))
    found = common.settle(found)
    children = found.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    return common.settle(found.join(children, KEY, "left").select(
        *KEY, "depth", "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "chain"))


def peel(chains: DataFrame) -> DataFrame:
    """(chain, up, at_depth, leaves, saved): chains (chain, up, at_depth, leaves, saved) with the totals of all that hangs from them.

    up is the chain a chain hangs from, null for the root's. Each round the
    chains whose counter is at nought send their totals up.
    """
    waits = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("chain")).agg(F.count(F.lit(1)).alias("waiting"))
    now = common.settle(chains.join(waits, "chain", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0))))
    done = None
    while True:
        ready = now.where("waiting = 0").drop("waiting")
        done = ready if done is None else done.unionByName(ready)
        sent = ready.where("up IS NOT NULL").groupBy(F.col("up").alias("chain")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        left = now.where("waiting > 0").join(sent, "chain", "left")
        zero = F.lit(0)
        now = common.settle(left.select("chain", "up", "at_depth", (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved"),
                                        (F.col("waiting") - F.coalesce("n", zero)).alias("waiting")))
        if now.isEmpty():
            return done


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of rows (k1, k2, conv_id): lowercase SHA-256 of the ids in ascending order, joined by commas.

    Ids are sorted over all tasks, a node's too, and joined to pieces of
    PIECE characters there; what hashes a node then reads pieces in order and
    holds one of them.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, c = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            step = PIECE // 20
            bounds = np.unique(np.concatenate([[0], cut, np.arange(0, len(c), step), [len(c)]]))
            text = c.astype(str).tolist()
            begin = bounds[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[begin]), pa.array(k2[begin]), pa.array(c[begin]), pa.array([",".join(text[x:y]) for x, y in zip(begin.tolist(), bounds[1:].tolist())], pa.string())],
                names=["k1", "k2", "first_id", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for b in batches:
            for k1, k2, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if (k1, k2) == now:
                    h.update(b",")
                else:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = (k1, k2), hashlib.sha256()
                h.update(piece.encode())
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["k1", "k2", "ends_sha256"])
                out = []
        if now is not None:
            out.append((*now, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["k1", "k2", "ends_sha256"])

    order = [*KEY, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "k1 bigint, k2 bigint, first_id bigint, piece string")
    return (pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first_id")
            .mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations, the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256). Conversations without turns are members of the
    root. Repeated rows are turns of their own; an empty table has no nodes.
    Other columns are ignored.
    """
    at = common.settle(places(conversations))
    n = nodes(at)
    leaf = (F.col("n_children") == 0).cast("bigint")
    chains = n.groupBy("chain").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.sum(leaf).alias("leaves"), F.sum("saved").alias("saved"))
    parents = n.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("chain").alias("up"))
    # a parent that many chains hang from is the hot side of this join, which Spark splits
    hung = chains.select("chain", "leaves", "saved", "top.p1", "top.p2", (F.col("top.depth") - 1).alias("at_depth")).join(parents, ["p1", "p2"], "left")
    total = common.settle(peel(hung.select("chain", "up", "at_depth", "leaves", "saved")))
    came = total.where("up IS NOT NULL").groupBy(F.col("up").alias("chain"), F.col("at_depth").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    below = Window.partitionBy("chain").orderBy(F.desc("depth"))
    zero = F.lit(0)
    summed = n.join(came, ["chain", "depth"], "left").select(
        *KEY, "depth", "p1", "p2", "conv_id", "n_convs", "n_children",
        F.sum(leaf + F.coalesce("l", zero)).over(below).alias("n_leaves"), F.sum(F.col("saved") + F.coalesce("s", zero)).over(below).alias("saved_tokens"))
    ends = digests(at.where("at_end"))
    return (summed.join(parents.drop("up"), ["p1", "p2"], "left").join(ends, KEY, "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(common.table(spark, sf_dir, "conversations"))


OP11_SQL = f"""
WITH {CRC_TABLE},
t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
d AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, text, sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ',' || role || text) AS s FROM r),
a AS MATERIALIZED (SELECT conv_id, depth, text, array_to_string(list(s) OVER (PARTITION BY conv_id ORDER BY depth), '') AS k FROM d
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
e AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h FROM (SELECT conv_id, arg_max(k, depth) AS k FROM a GROUP BY conv_id) GROUP BY k),
n AS MATERIALIZED (SELECT k, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS saved,
  substr(k, 1, len(k) - 64) AS p FROM a GROUP BY k),
ch AS MATERIALIZED (SELECT p AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY p),
u AS (SELECT n.saved, ch.n IS NULL AS leaf, substr(n.k, 1, 64 * CAST(x AS INT)) AS k FROM n LEFT JOIN ch USING (k), unnest(range(n.depth + 1)) q(x)),
s AS (SELECT k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM u GROUP BY k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth > 0 THEN o.conv_id END AS parent_conv_id, n.n_convs, coalesce(ch.n, 0) AS n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM n JOIN n o ON o.k = n.p LEFT JOIN ch ON ch.k = n.k JOIN s ON s.k = n.k LEFT JOIN e ON e.k = n.k"""
