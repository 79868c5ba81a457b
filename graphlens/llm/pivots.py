"""Embedding near-duplicates through a pivot-permutation index.

A vector, less the sample's mean, is described by its nearest reference points
in order. The inverted lists are kept per set of `shared` pivots: two vectors
meet in the list of such a set exactly if their prefixes share that many
pivots, so a pivot's long list is never gone through for its few members that
share enough. How long the prefixes are, how many pivots two must share, and how
far the places of pivots in two prefixes may differ in sum (the footrule) is
chosen by what a sample shows: the least work that still finds nearly all pairs
right at the threshold. Lists hold ids, prefixes and sign sketches; only what
has a partner close in order and in sketch is compared by its vectors, in double
precision. There are pivots at every size: of few vectors, fewer pivots.
"""

from __future__ import annotations

from binascii import crc32
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Least cosine, and the share of pairs at that cosine which prefixes must bring together on the sample.
COSINE, RECALL = 0.95, 0.97
#: Reference points for FEW vectors (more as the cube root of the number), and the most.
PIVOTS, FEW, MOST_PIVOTS = 128, 50_000, 4096
#: Prefixes tried, pivots to share, sets of pivots a vector may be listed under.
PREFIXES, SHARED, MOST_KEYS = range(4, 13), (3, 2, 4), 66
#: A row of a list weighs as much as so many comparisons.
ROW = 50
#: Vectors of a length's sample, half for pivots, half to choose the prefix by; LEAST of very long ones, whose samples have VALUES numbers.
SAMPLE, LEAST, VALUES = 4096, 256, 4 << 20
#: Made-up pairs at the threshold to choose by, and the share of those in a list that the footrule may lose.
MADE, LOST = 2048, 0.001
#: Bits of a sketch; vectors of a block where lists are compared by sketches, and by vectors.
BITS, SKETCHED, BLOCK = 128, 8192, 2048
#: Bytes of pivots sent at a time.
SENT = 64 << 20


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of equal length as a matrix in double precision)."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(offsets[1] - offsets[0])
    return flat[offsets[0]:offsets[-1]].reshape(len(column), width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that neither tiny nor huge ones overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    """What describes vectors of one length: the mean taken off, pivots, prefix, pivots to share, the farthest order; no sample: all in one list."""

    def __init__(self, sample: np.ndarray | None, n: int, dims: int, cosine: float, recall: float):
        self.mean, self.pivots, self.prefix, self.shared, self.farthest, self.seed, self.estimate = np.zeros(dims), None, 0, 0, 0, 0, 1.0
        if sample is None:
            return
        # planes are drawn by what the vectors are, so no vectors are bad for them whatever the data
        self.seed = crc32(sample.tobytes())
        self.mean = sample.mean(axis=0)
        x = self.centred(sample)
        self.pivots = farthest(x[::2], min(MOST_PIVOTS, max(PIVOTS, round(PIVOTS * (n / FEW) ** (1 / 3)))))
        # what vectors at the threshold from each of the second half look like
        half = slice(1, None, 2) if len(x) > 1 else slice(None)
        own = np.repeat(sample[half], -(-MADE // len(sample[half])), axis=0)[:max(MADE, len(sample[half]))]
        off = np.random.default_rng(13).normal(size=own.shape)
        off = off - (off * own).sum(axis=1, keepdims=True) * own
        off /= np.maximum(np.sqrt((off * off).sum(axis=1, keepdims=True)), 1e-9)
        near = self.centred(unit(cosine * own + np.sqrt(max(0.0, 1 - cosine * cosine)) * off))
        longest = min(max(PREFIXES), len(self.pivots))
        a, b = permutation(self.centred(own), self.pivots, longest), permutation(near, self.pivots, longest)
        every = permutation(x, self.pivots, longest)
        best = None
        for shared in [k for k in SHARED if k <= longest] or [1]:
            for prefix in [k for k in PREFIXES if k <= longest] or [longest]:
                if shared > prefix or comb(prefix, shared) > MOST_KEYS:
                    continue
                both, apart = footrule(a[:, :prefix], b[:, :prefix])
                ok = both >= shared
                most = int(np.quantile(apart[ok], 1 - LOST, method="higher")) if ok.any() else 0
                found = float((ok & (apart <= most)).mean())
                _, times = np.unique(_keys(every[:, :prefix], dims, shared), return_counts=True)
                meets = float((times * (times - 1)).sum()) / len(x) / max(1, len(x) - 1) * n
                cost = comb(prefix, shared) * ROW + meets
                choice = (found < recall, -found if found < recall else cost, prefix, shared, most, found)
                best = min(best or choice, choice)
        _, _, self.prefix, self.shared, self.farthest, self.estimate = best

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors less the mean, of unit length again; the mean itself stays as it is."""
        y = x - self.mean
        size = np.sqrt((y * y).sum(axis=1, keepdims=True))
        return np.where(size > 1e-9, y / np.maximum(size, 1e-9), x)

    def keys(self, x: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """(prefix, one key for each set of pivots) of unit vectors."""
        if self.pivots is None:
            return np.zeros((len(x), 0), np.int64), np.full((len(x), 1), dims, np.int64)
        perm = permutation(self.centred(x), self.pivots, self.prefix)
        return perm, _keys(perm, dims, self.shared)


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """At most n spread-out rows of x: the first, then always the one least similar to all chosen."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        k = int(np.argmin(nearest))
        chosen.append(k)
        nearest = np.maximum(nearest, x @ x[k])
    return x[chosen]


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """On which side of BITS planes, drawn by the seed, each row lies."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], BITS))
    return np.packbits(x @ planes > 0, axis=1)


def footrule(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivots shared, sum of the differences of places) of rows of two matrices of prefixes; a pivot in one alone has the place after the other's last."""
    k = p.shape[1]
    same = p[:, :, None] == q[:, None, :]
    place = np.arange(k, dtype=np.int16)
    at, left = np.abs(place[:, None] - place[None, :]), k - place
    apart = (same * at).sum(axis=(1, 2)) + (~same.any(axis=2) * left).sum(axis=1) + (~same.any(axis=1) * left).sum(axis=1)
    return same.sum(axis=(1, 2)), apart


def reach(cosine: float) -> float:
    """The bits that sketches of vectors at this cosine differ in at most, but for one draw of planes in a thousand million."""
    p = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return BITS * p + 6 * np.sqrt(BITS * p * (1 - p))


def permutation(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's nearest pivots in order, ties to the smaller number."""
    s = x @ pivots.T
    k = min(prefix, s.shape[1])
    if k < s.shape[1]:
        near = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
    else:
        near = np.tile(np.arange(k), (len(s), 1))
    order = np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


def _keys(perm: np.ndarray, dims: int, shared: int) -> np.ndarray:
    """One key for each set of `shared` pivots in a row's prefix."""
    p = np.sort(perm, axis=1).astype(np.int64)
    shared = min(shared, p.shape[1])
    out = np.zeros((len(p), 0), np.int64)
    for cols in combinations(range(p.shape[1]), shared):
        key = np.full(len(p), dims, np.int64)
        for c in cols:
            key = key * 4099 + p[:, c] + 1
        out = np.column_stack([out, key])
    return out


def compare(ids, weights, x, perm, first, second, key, dims, shared, cosine):
    """Links between rows of two blocks (or within one): (numbers, weights of partners, smallest row linked).

    A pair that meets in several lists counts in the list of its smallest
    common set alone.
    """
    same = first is second
    n, m = len(first), len(second)
    count = np.zeros(len(ids), np.int64)
    edges = []
    p = np.sort(perm, axis=1)
    for a in range(0, n, 256):
        rows = first[a:a + 256]
        hit_i, hit_j = np.nonzero(x[rows] @ x[second].T >= cosine)
        i, j = rows[hit_i], second[hit_j]
        if same:
            keep = hit_i + a < hit_j
            i, j = i[keep], j[keep]
        for c in range(0, len(i), 50_000):
            ii, jj = i[c:c + 50_000], j[c:c + 50_000]
            ok = _own_list(p[ii], p[jj], key, dims, shared)
            ii, jj = ii[ok], jj[ok]
            np.add.at(count, ii, weights[jj])
            np.add.at(count, jj, weights[ii])
            edges.append((ii, jj))
    return count, edges


def _own_list(p: np.ndarray, q: np.ndarray, key: int, dims: int, shared: int) -> np.ndarray:
    """Whether pairs of rows with these sorted prefixes share enough pivots and belong to this list, the one of their smallest shared ones."""
    both = (p[:, :, None] == q[:, None, :]).any(axis=2)
    lowest = both & (np.cumsum(both, axis=1) <= shared)
    own = np.full(len(p), dims, np.int64)
    for col in range(p.shape[1]):
        own = np.where(lowest[:, col], own * 4099 + p[:, col] + 1, own)
    return (both.sum(axis=1) >= shared) & (own == key)


def close(perm, bits, first, second, key, dims, shared, farthest, most) -> np.ndarray:
    """Numbers of the rows of two blocks (or one) that have a partner in the other, with this as their list, within `farthest` by order and `most` bits by sketch."""
    same = first is second
    p = np.sort(perm, axis=1)
    signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
    got = np.zeros(len(perm), bool)
    for a in range(0, len(first), 512):
        rows = first[a:a + 512]
        hit_i, hit_j = np.nonzero(signs[rows] @ signs[second].T >= BITS - 2 * most)
        if same:
            keep = hit_i + a < hit_j
            hit_i, hit_j = hit_i[keep], hit_j[keep]
        for c in range(0, len(hit_i), 50_000):
            ii, jj = rows[hit_i[c:c + 50_000]], second[hit_j[c:c + 50_000]]
            ok = _own_list(p[ii], p[jj], key, dims, shared)
            ii, jj = ii[ok], jj[ok]
            ok = footrule(perm[ii], perm[jj])[1] <= farthest
            got[ii[ok]] = True
            got[jj[ok]] = True
    return np.flatnonzero(got)


def _spanning(ids: np.ndarray, edges: list) -> list[tuple[int, int]]:
    """(id, smallest id of its tree) of the rows that edges join."""
    label = np.arange(len(ids))
    while True:
        old = label.copy()
        for i, j in edges:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == old).all():
            break
    low_id = {}
    for r, lab in zip(ids.tolist(), label.tolist()):
        low_id[lab] = min(low_id.get(lab, r), r)
    return [(r, low_id[lab]) for r, lab in zip(ids.tolist(), label.tolist()) if low_id[lab] != r]


def _indexes(one: DataFrame, cosine: float, recall: float) -> Iterator[dict[int, Index]]:
    """An index for each length of vectors, SENT bytes of pivots at a time; all lengths' samples come by one job, one length at a time in the driver."""
    sizes = one.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
    # the least by a hash; a bound on it leaves few more than the sample to rank
    wanted = F.least(F.lit(SAMPLE), F.greatest(F.lit(LEAST), F.floor(F.lit(VALUES) / F.col("dims"))))
    least = Window.partitionBy("dims").orderBy("r", "id")
    drawn = (
        one.withColumn("r", F.pmod(F.xxhash64(F.lit(11), "v"), F.lit(1 << 30))).join(sizes, "dims")
        .where(F.col("r") * F.col("n") <= (1 << 30) * (1.5 * wanted + 64))
        .withColumn("k", F.row_number().over(least)).where(F.col("k") <= wanted).select("dims", "k", "n", "v")
    )
    held, size, last, rows = {}, 0, None, []

    def fitted() -> Index:
        return Index(unit(np.array(rows, np.float64)), last[1], last[0], cosine, recall)

    for r in common.settle(drawn).orderBy("dims", "k").toLocalIterator():
        if last not in (None, (r.dims, r.n)):
            held[last[0]] = fitted()
            size += held[last[0]].pivots.nbytes
            rows = []
            if size > SENT:
                yield held
                held, size = {}, 0
        last = (r.dims, r.n)
        rows.append(r.v)
    if last:
        held[last[0]] = fitted()
    if held:
        yield held


def _blocks(rows: DataFrame, per_list: DataFrame, block: int) -> DataFrame:
    """rows (key, h1, ...) of lists of several, once for each pair of blocks (bi, bj) that has the row's own, sorted by pair."""
    spread = (
        rows.join(per_list, "key").withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n")
        .withColumn("own", F.pmod(F.xxhash64(F.lit(3), "h1"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", "parts")
    )
    return spread.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "h1")


def _by_pair(dealt: DataFrame, columns: list[str], found: Callable[[pa.Table, int, np.ndarray, np.ndarray], list[tuple]], names: list[str]) -> DataFrame:
    """found(rows, key, numbers of the first block's, of the second's) of each pair of blocks, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (key, bi, bj), t in common.groups(batches, 3):
                own = t.column(3).to_numpy()
                a = np.flatnonzero(own == bi)
                yield from found(t, key, a, a if bi == bj else np.flatnonzero(own == bj))

        yield from common.longs(rows(), names)

    return dealt.select("key", "bi", "bj", "own", *columns).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def similar_vectors(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, exact: bool = False,
    id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, sketched: int = SKETCHED,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors of different lengths don't link; null, empty and zero ones, and
    those with null or non-finite components, link with nothing. Equal vectors
    are one class in the index (their smallest id), and each has the class's
    links and its other members. Rows of one id are one node of the
    components. A row with a null id never links.

    Every link reported has a cosine of at least `cosine`. A pair right at it is
    found with a probability of about `recall`, estimated on a sample of at most
    SAMPLE vectors of each length, a closer pair more surely: it must share
    pivots, its prefixes' order and its sketches be near enough, each by a bound
    that the sample or the draw of planes sets. Where no prefix reaches `recall`
    the best one is taken. exact=True asks nothing of that and compares all
    vectors of a length with each other, block by block: no link is lost.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.coalesce(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0), F.lit(False))
    kind = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    rows = rows.withColumn("good", good).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(5), F.reverse("v")))
    fine = rows.where("good").withColumn("dims", F.size("v"))
    classes = common.settle(fine.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    one = fine.join(classes, ["h1", "h2", "id"], "left_semi").dropDuplicates(["h1", "h2"])
    one = common.settle(one.join(classes.select("h1", "h2", "weight"), ["h1", "h2"]).select("h1", "id", "weight", "v", "dims"))

    def described(index: dict[int, Index], some: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column(4).to_numpy()
                for d in np.unique(dims).tolist():
                    own = sent.value.get(d) or Index(None, 0, d, cosine, recall)
                    part = b.filter(pa.array(dims == d))
                    for at in range(0, part.num_rows, 4096):
                        some = part.slice(at, 4096)
                        raw = _matrix(some.column(3))
                        x = unit(raw)
                        perm, keys = own.keys(x, d)
                        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.astype(t).ravel()))
                                 for y, t in ((perm, np.int16), (keys, np.int64))]
                        whole = [pa.array(np.full(len(x), k, np.int32)) for k in (own.shared, own.farthest)]
                        yield pa.RecordBatch.from_arrays(
                            [some.column(0), some.column(1), some.column(2), some.column(4), *whole, lists[0],
                             pa.array([r.tobytes() for r in sketches(x, own.seed)], pa.binary()), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary()), lists[1]],
                            names=["h1", "id", "weight", "dims", "shared", "farthest", "perm", "bits", "x", "keys"])

        return common.settle(some.select("h1", "id", "weight", "v", "dims").mapInArrow(
            run, "h1 bigint, id bigint, weight bigint, dims int, shared int, farthest int, perm array<smallint>, bits binary, x binary, keys array<bigint>"))

    held = [{}] if exact else [*_indexes(one, cosine, recall)] or [{}]
    parts = [described(index, one.where(F.col("dims").isin(list(index))) if len(held) > 1 else one) for index in held]
    table = reduce(DataFrame.unionByName, parts)
    several = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    # lists without vectors: who has a partner within reach of its sketch
    most = reach(cosine)
    light = table.select(F.explode("keys").alias("key"), "h1", "dims", "shared", "farthest", "perm", "bits")
    prefix = lambda t, at: np.array(t.column(at).to_pylist(), np.int64).reshape(t.num_rows, -1)

    def by_sketch(t: pa.Table, key: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        bits = np.frombuffer(b"".join(t.column(9).to_pylist()), np.uint8).reshape(t.num_rows, -1)
        dims, shared, farthest = (t.column(k)[0].as_py() for k in (5, 6, 7))
        got = close(prefix(t, 8), bits, a, b, key, dims, shared, farthest, most)
        return [(key, i) for i in t.column(4).to_numpy()[got].tolist()]

    # the lists' sizes need no more than their keys
    if exact:
        near = table.select(F.explode("keys").alias("key"), "h1")
    else:
        dealt = _blocks(light, several(table.select(F.explode("keys").alias("key"))), sketched)
        near = common.settle(_by_pair(dealt, ["h1", "dims", "shared", "farthest", "perm", "bits"], by_sketch, ["key", "h1"]).distinct())

    def by_vector(t: pa.Table, key: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        rows, ids, weights = (t.column(k).to_numpy() for k in (4, 5, 6))
        x = unit(np.frombuffer(b"".join(t.column(10).to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
        count, edges = compare(ids, weights, x, prefix(t, 9), a, b, key, t.column(7)[0].as_py(), t.column(8)[0].as_py(), cosine)
        got = np.flatnonzero(count)
        trees = dict(_spanning(ids, edges)) if len(got) else {}
        return [(int(rows[g]), int(ids[g]), int(count[g]), trees.get(int(ids[g]), int(ids[g]))) for g in got]

    heavy = near.join(table.select("h1", "id", "weight", "dims", "shared", "perm", "x"), "h1")
    dealt = _blocks(heavy, several(near), block)
    found = common.settle(_by_pair(dealt, ["h1", "id", "weight", "dims", "shared", "perm", "x"], by_vector, ["h1", "id", "links", "low"]))
    counts = found.groupBy("h1").agg(F.sum("links").alias("links"))
    # an id with several vectors joins their classes
    mixed = fine.groupBy("id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("id")
    same_id = fine.join(mixed, "id", "left_semi").select(F.col("id").alias("a"), "h1", "h2").join(
        classes.select("h1", "h2", F.col("id").alias("b")), ["h1", "h2"]).select("a", "b")
    edges = found.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(same_id)
    groups = common.connected(one.select("id").union(mixed).distinct(), edges)
    totals = (
        classes.join(counts, "h1", "left").join(groups, "id")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    )
    joined = rows.where("good").select("id", "h1", "h2").join(totals, ["h1", "h2"]).select("id", "n_links", "component")
    alone = rows.where("NOT good").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(common.table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true)
        AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id,
       least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) = vec_id AS kept FROM v
"""
