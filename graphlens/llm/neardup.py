"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of five-word shingles, each labelled with how often
it occurred before. A sketch hashes the labelled shingles anew, takes the
several smallest and keeps them in text order; equal sketches make candidates.
Candidates are aligned in a band, and are near if at most a fifth of the longer
sequence must be edited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words in a shingle, sketches, shingles kept by each, and the least similarity.
WORDS, SKETCHES, KEPT, SIMILARITY = 5, 40, 6, 0.8
#: Documents of fewer shingles than SHORT keep FEW in a sketch.
SHORT, FEW = 40, 2
#: Documents of a block, where the members of a bucket are compared among each other, and bytes of their shingles.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Pairs of members that a centre leaves to compare, beyond which they meet by their rarest shingles and not all in all.
CROWDED = 1 << 16
#: Shingles that a task lays out as rows at a time.
SPREAD = 1 << 18


class WordHashes(dict):
    """64-bit hash of each word; forgets all beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of k words in order; one of all words if there are fewer."""
    words = (text or "").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for j in range(min(k, len(h))):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[j:j + n]
        out = _mix(out)
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """The shingles, told apart by how often each occurred before."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.r_[True, t[1:] != t[:-1]]
    if new.all():
        return _mix(s)
    start = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    out = np.empty_like(s)
    out[order] = _mix(t + (np.arange(len(t)) - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def _sketch(x: np.ndarray, m: int, kept: int) -> np.ndarray:
    odd = _mix(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)
    key = np.arange(1, m + 1, dtype=np.uint64) + np.uint64(kept << 32)
    step = max(1, 200_000 // len(x))
    for a in range(0, m, step):
        h = (x[None, :] ^ (odd[a:a + step, None] >> np.uint64(1))) * odd[a:a + step, None]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        n = h.shape[1]
        at = np.argpartition(h, kept - 1, axis=1)[:, :kept] if n > kept else np.tile(np.arange(n), (len(h), 1))
        v = x[np.sort(at, axis=1)]
        k = key[a:a + step]
        for j in range(v.shape[1]):
            k = (k ^ v[:, j]) * np.uint64(0x9FB21C651E98DF25) + (k >> np.uint64(29))
        key[a:a + step] = k
    return _mix(key)


def sketch(s: np.ndarray, m: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """m keys: the hash of the `kept` smallest labelled shingles in text order, anew for each key.

    Of few shingles all `kept` smallest are seldom shared, so documents of under
    SHORT shingles keep FEW; those whose similar ones may lie on the other side
    of SHORT have the keys of both kinds.
    """
    x = labelled(s)
    parts = []
    if len(x) < SHORT / SIMILARITY:
        parts.append(_sketch(x, m, FEW))
    if len(x) >= SHORT * SIMILARITY:
        parts.append(_sketch(x, m, kept))
    return np.concatenate(parts)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if at most `most`, else most + 1.

    Bit vectors over the band of 2 * most + 1 diagonals move along the longer
    sequence; equal ends are cut off and shared elements bound it first.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    n = len(b)
    diff = np.flatnonzero(a[:n] != b)
    if not len(diff):
        return len(a) - n
    head = int(diff[0])
    a, b = a[head:], b[head:]
    n = len(b)
    diff = np.flatnonzero(a[::-1][:n] != b[::-1])
    tail = int(diff[0]) if len(diff) else n
    if tail:
        a, b = a[:len(a) - tail], b[:n - tail]
    if not len(b):
        return len(a) if len(a) <= most else most + 1
    _, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = ids[:len(a)], ids[len(a):]
    size = int(ids.max()) + 1
    shared = int(np.minimum(np.bincount(ia, minlength=size), np.bincount(ib, minlength=size)).sum())
    if len(a) - shared > most:
        return most + 1
    most = min(most, len(a))
    la, lb = len(a), len(b)
    where: dict[int, int] = {}
    for i, c in enumerate(ia.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    width = 2 * most + 1
    full = (1 << width) - 1
    vp, vn = (full << (width - most - 1)) & full, 0
    score, across = most, 1 << (width - 2)
    diagonal = 1 << (width - 1)
    start = most + 1 - width
    limit = most + (lb - la + most)
    for i, c in enumerate(ib.tolist()):
        pm = where.get(c, 0)
        x = (pm >> start if start >= 0 else pm << -start) & full
        d0 = ((((x & vp) + vp) & full) ^ vp) | x | vn
        hp = vn | ~(d0 | vp) & full
        hn = d0 & vp
        if i < la - most:
            score += not d0 & diagonal
        else:
            score += (hp & across > 0) - (hn & across > 0)
            across >>= 1
        if score > limit:
            return most + 1
        vp = hn | ~((d0 >> 1) | hp) & full
        vn = (d0 >> 1) & hp
        start += 1
    return score if score <= most else most + 1


def near(d: int, n: int, m: int, similarity: float = SIMILARITY) -> bool:
    """Whether d edits between sequences of n and m leave the similarity."""
    return d <= (1 - similarity) * max(n, m) + 1e-9


def _sketch_table(rows: DataFrame, m: int, kept: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keys = [sketch(shingles(t, hashes), m, kept).view(np.int64) for t in part.column(3).to_pylist()]
                flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
                offsets = np.zeros(len(keys) + 1, np.int32)
                np.cumsum([len(k) for k in keys], out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["id", "h1", "h2", "keys"])

    return rows.select("id", "h1", "h2", "text").mapInArrow(run, "id bigint, h1 bigint, h2 bigint, keys array<bigint>")


def _sequences(rows: DataFrame) -> DataFrame:
    """(id, s): the shingles of each text, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                s = [shingles(t, hashes).astype(np.uint32).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.binary())], names=["id", "s"])

    return rows.select("id", "text").mapInArrow(run, "id bigint, s binary")


def _verify(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """(a, b, state, d, n) of each pair: n is the length of a, d the distance up to what was looked for;
    state is 2 near, 1 not near but within reach of b's near ones, 0 farther.

    It looks as far as anything can be from b and yet be near to what is near
    to b: whatever is farther needs no test against those.
    """
    a = sequences.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    b = sequences.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    share = 1 - similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, dists, sizes = [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                n, m = len(p), len(q)
                # twice over, lengths grow by at most 1 / similarity each time
                most = max(int(share * max(n, m) + 1e-9), int(share * m / similarity * (1 + 1 / similarity)) + 1)
                d = distance(p, q, most)
                states.append(2 if near(d, n, m, similarity) and d <= most else 1 if d <= most else 0)
                dists.append(d)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(states, pa.int8()), pa.array(dists, pa.int32()),
                 pa.array(sizes, pa.int32())], names=["a", "b", "state", "d", "n"])

    return both.mapInArrow(run, "a bigint, b bigint, state tinyint, d int, n int")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, m: int = SKETCHES, kept: int = KEPT,
) -> DataFrame:
    """(doc_id, class_id, kept): one row per row of docs.

    class_id is the smallest doc_id that near links and exact copies reach;
    kept marks that document. Words are lower-cased runs without white space;
    a null text is empty, and all empty texts are copies of each other. Texts
    of under five words have one shingle, so they link when their words are
    equal. Rows of equal doc_id are one document for the links; where their
    texts differ, the class joins both texts' copies. A null doc_id is its own class (null)
    and never stands for others.

    Every member of a bucket is aligned with the bucket's smallest one, its
    centre. By the triangle inequality those far from it can't be near to what
    is near to it; those within reach are aligned with those, and all that the
    centre doesn't link among each other, if they share a bucket: a centre at a
    time, in pairs of blocks of at most BLOCK documents and about BLOCK_BYTES,
    and only links come out. Where a centre leaves more than CROWDED pairs, as a
    passage does that very many documents have, these meet anew in buckets of
    their rarest shingles there. Sequences of similarity s have a share s of
    their shingles in common, so the rarest 1 - s of either, and one more, have
    one in common: no link that a bucket holds is lost.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), F.reverse("text")))
    table = common.settle(_sketch_table(rows.where("id IS NOT NULL"), m, kept))
    copies = table.select("id", "h1", "h2")
    reps = common.settle(copies.groupBy("h1", "h2").agg(F.min("id").alias("id")))
    # one row per distinct text and key; an id with two texts has both
    first = table.join(reps.select("id", "h1", "h2"), ["id", "h1", "h2"]).select("id", F.explode("keys").alias("key"))
    pairs = _meetings(first)
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sequences = common.settle(_sequences(rows.join(involved, "id", "left_semi")))
    links = _links(pairs, sequences, similarity, True)
    groups = common.connected(reps.select("id").distinct(), links)
    classes = reps.join(groups, "id").select("h1", "h2", F.col("component").alias("class_id"))
    named = copies.join(classes, ["h1", "h2"]).withColumnRenamed("id", "doc_id")
    nulls = rows.where("id IS NULL").select(F.col("id").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"))
    return (
        named.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
        .unionByName(nulls.withColumn("kept", F.lit(True)))
    )


def _meetings(first: DataFrame) -> DataFrame:
    """(a, b, keys): who (first: id, key) shares which keys with the smallest id of a key's bucket."""
    shared = first.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("top")).where("c < top")
    return common.settle(
        first.join(shared.select("key", "c"), "key").where("id <> c")
        .groupBy(F.col("id").alias("a"), F.col("c").alias("b")).agg(F.collect_set("key").alias("keys")))


def _links(pairs: DataFrame, sequences: DataFrame, similarity: float, anew: bool) -> DataFrame:
    """Near pairs (a, b), enough to join all that are near and share a key; crowded centres' members meet anew once."""
    tested = common.settle(_verify(pairs.select("a", "b"), sequences, similarity))
    links = tested.where("state = 2").select("a", "b")
    centres = (
        tested.groupBy("b").agg(F.count_if(F.col("state") < 2).alias("left"), F.count_if(F.col("state") == 1).alias("reach"),
                                F.count_if(F.col("state") == 2).alias("near"), F.sum("n").alias("shingles"))
        .where("(reach > 0 AND near > 0) OR left > 1")
    )
    if anew:
        centres = common.settle(centres)
        crowded = centres.where(F.col("left") * (F.col("left") + F.when(F.col("reach") > 0, F.col("near")).otherwise(0)) > CROWDED)
        if not crowded.isEmpty():
            links = links.unionByName(_links(_meetings(_rarest(tested, crowded, sequences, similarity)), sequences, similarity, False))
            centres = centres.join(crowded.select("b"), "b", "left_anti")
    return links.unionByName(common.settle(_rest(tested, centres, pairs, sequences, similarity)))


def _rarest(tested: DataFrame, crowded: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """(id, key): each member of a crowded centre by its rarest shingles among the centre's members, as many as near ones must share one of."""
    members = tested.join(crowded.select("b", "reach"), "b").where("state < 2 OR reach > 0").select("b", F.col("a").alias("id"), (F.col("state") < 2).alias("left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # so many rows at a time as have SPREAD shingles together, one at least
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy() // 4)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPREAD, "right")))
                part = batch.slice(at, stop - at)
                at = stop
                seqs = [_mix(labelled(np.frombuffer(s.as_buffer(), np.uint32).astype(np.uint64))).view(np.int64) for s in part.column(2)]
                sizes = [len(s) for s in seqs]
                owner = pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), pa.array(np.repeat(np.array(sizes, np.int32), sizes)),
                     pa.array(np.concatenate(seqs)), part.column(3).take(owner)], names=["b", "id", "n", "s", "left"])

    every = common.settle(members.join(sequences, "id").select("b", "id", "s", "left").mapInArrow(run, "b bigint, id bigint, n int, s bigint, left boolean"))
    often = every.groupBy("b", "s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # a shingle that one member alone has comes before all others and leads to nobody
    rank = F.row_number().over(Window.partitionBy("b", "id").orderBy(F.coalesce("f", F.lit(1)), "s"))
    most = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    rare = common.settle(every.join(often, ["b", "s"], "left").withColumn("k", rank).where((F.col("k") <= most) & F.col("f").isNotNull()).select("b", "s", "id", "left"))
    # what the centre links meets only what it leaves
    met = rare.where("left").groupBy("b", "s").agg(F.count(F.lit(1)).alias("lefts")).join(rare.groupBy("b", "s").agg(F.count(F.lit(1)).alias("all")), ["b", "s"])
    return rare.join(met.where("all > 1").select("b", "s"), ["b", "s"], "left_semi").select("id", F.xxhash64("b", "s").alias("key"))


def _rest(tested: DataFrame, centres: DataFrame, pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members that share a bucket whose centre doesn't link them both."""
    blocks_of = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col("shingles") * 4 / BLOCK_BYTES)).cast("int")
    centres = centres.select("b", "reach", blocks_of("left").alias("lefts"), F.when(F.col("near") > 0, blocks_of("near")).otherwise(0).alias("nears"))
    is_near = F.col("state") == 2
    blocks = F.when(is_near, F.col("nears")).otherwise(F.col("lefts"))
    # what is left meets each other (kind 0); what is within reach also meets what the centre links (kind 1)
    own = F.col("own")
    to = lambda n, kind, i, j: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(
        F.lit(kind).alias("kind"), i(k).alias("bi"), j(k).alias("bj")))
    meets = F.when(is_near, to(F.col("lefts"), 1, lambda k: k, lambda k: own)).otherwise(F.concat(
        to(F.col("lefts"), 0, lambda k: F.least(own, k), lambda k: F.greatest(own, k)),
        F.when((F.col("state") == 1) & (F.col("nears") > 0), to(F.col("nears"), 1, lambda k: own, lambda k: k)).otherwise(
            F.array().cast("array<struct<kind:int,bi:int,bj:int>>"))))
    members = (
        tested.join(centres, "b").where("state < 2 OR reach > 0")
        .withColumn("own", F.pmod(F.xxhash64(F.lit(3), "a"), blocks).cast("int"))
        .join(pairs, ["a", "b"]).join(sequences.withColumnRenamed("id", "a"), "a")
        .withColumn("m", F.explode(meets))
        .select(F.col("b").alias("c"), "m.kind", "m.bi", "m.bj", "own", "a", "state", "d", "keys", "s")
    )
    dealt = members.repartition("c", "kind", "bi", "bj").sortWithinPartitions("c", "kind", "bi", "bj", "a")

    def compare(t: pa.Table, kind: int, bi: int, bj: int) -> Iterator[tuple[int, int]]:
        own, ids, states, dists = (t.column(k).to_pylist() for k in (4, 5, 6, 7))
        keys = t.column(8).combine_chunks()
        ends, flat = keys.offsets.to_numpy(), keys.values.to_numpy()
        keys_of = lambda k: flat[ends[k]:ends[k + 1]].tolist()
        seqs = [np.frombuffer(s.as_buffer(), np.uint32) for s in t.column(9)]
        tree = {i: i for i in ids}

        def root(x):
            while tree[x] != x:
                tree[x] = x = tree[tree[x]]
            return x

        near_ones = [i for i, state in zip(ids, states) if state == 2]
        for i in near_ones:  # the centre joins them
            tree[root(i)] = root(near_ones[0])
        holders = {}
        for k in range(len(ids)):
            if states[k] == 2 if kind else own[k] == bj:
                for key in keys_of(k):
                    holders.setdefault(key, []).append(k)
        for x in range(len(ids)):
            if states[x] == 2 if kind else own[x] != bi:
                continue
            for y in {k for key in keys_of(x) for k in holders.get(key, ())}:
                if not kind and bi == bj and y <= x or ids[x] == ids[y]:
                    continue
                n, m = len(seqs[x]), len(seqs[y])
                most = int((1 - similarity) * max(n, m) + 1e-9)
                if states[x] and states[y] and abs(dists[x] - dists[y]) > most or root(ids[x]) == root(ids[y]):
                    continue
                if distance(seqs[x], seqs[y], most) <= most:
                    tree[root(ids[x])] = root(ids[y])
                    yield ids[x], ids[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (pair for (_, kind, bi, bj), t in common.groups(batches, 4) for pair in compare(t, kind, bi, bj))
        yield from common.longs(found, ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their class, with their columns.

    Rows without an id stay. Of rows that repeat an id one stays, the least by
    its columns.
    """
    classes = near_duplicates(docs)
    ids = common.settle(classes.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    own = common.unused("id", docs.columns)
    known = docs.join(ids.select(F.col("doc_id").alias(own)), F.col("doc_id") == F.col(own), "left_semi")
    if not ids.where("n > 1").isEmpty():
        # ordered as text, since not all kinds of columns have an order
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        known = known.groupBy(F.col("doc_id").alias(own)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return known.unionByName(docs.where("doc_id IS NULL"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
