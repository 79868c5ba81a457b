"""Substring dedup with suffix arrays and the tree of their common-prefix intervals.

Every string of LENGTH bytes has an anchor, the least hash among its runs of
GRAM bytes, and equal strings have equal anchors. The strings of one anchor
make a block. Anchors that occur once need nothing more. For the others, equal
blocks are merged first, then the distinct blocks of an anchor are sorted into
an enhanced suffix array; a stack scan over its common prefixes gives the
intervals, and those whose occurrences differ to the left are the maximal
repeats, each with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes a repeat has at least, and bytes of an anchor.
LENGTH, GRAM = 100, 32
#: An anchor with more distinct blocks than this is cut into parts of so many strings, then fewer; parts of
#: one string are equal or share no anchor.
GROUP, WIDTHS = 1024, (17, 4, 1)
#: Bytes sorted into one array, and bytes of a text hashed at a time.
CHUNK, STRETCH = 1 << 19, 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(name: str, n: int) -> np.ndarray:
    """Powers 0 to n of the base or its inverse modulo 2^64."""
    have = _powers.get(name)
    if have is None or len(have) <= n:
        full = np.full(max(n + 1, 1 << 16), _BASE if name == "base" else _INVERSE, np.uint64)
        full[0] = 1
        have = _powers[name] = np.multiply.accumulate(full)
    return have


def _sums(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * _power("base", len(b))[:len(b)], out=out[1:])
    return out


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    done = 1
    while 2 * done <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    rest = width - done
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


def blocks(b: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, block hash, start, strings, bytes from the start to the anchor) of each block of a text's bytes.

    A block starts at its first string and has `strings` of them, so it covers
    strings + length - 1 bytes.
    """
    outs = []
    for a in range(0, max(1, len(b) - length + 1), STRETCH):
        part = b[a:a + STRETCH + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        sums, down = _sums(part), _power("inverse", len(part))
        grams = _mix((sums[gram:] - sums[:-gram]) * down[:len(part) - gram + 1])
        low = np.uint64((1 << 24) - 1)
        tagged = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        at = (_least(tagged, length - gram + 1) & low).astype(np.int64)
        starts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
        count = np.diff(np.r_[starts, n])
        ends = starts + count + length - 1
        whole = _mix((sums[ends] - sums[starts]) * down[starts] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        outs.append((grams[at[starts]], whole, starts + a, count, at[starts] - starts))
    if not outs:
        e = np.empty(0, np.uint64)
        return e, e, *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*outs))


def suffix_array(text: np.ndarray, places: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) of the suffixes of text from places[i] to stop[i].

    Suffixes are no longer than a block, so they are sorted as padded rows;
    equal ones keep the order of their places.
    """
    width = int((stop - places).max())
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[places]
    left = stop - places
    short = np.flatnonzero(left < width)
    rows[short] = np.where(np.arange(width) < left[short, None], rows[short], 0)
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(len(places), np.int64)
    for at in range(1, len(places), 1 << 15):
        i = np.arange(at, min(len(places), at + (1 << 15)))
        differ = rows[order[i]] != rows[order[i - 1]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[i] = np.minimum(first, np.minimum(left[order[i]], left[order[i - 1]]))
    return order, lcp


def maximal_repeats(
    text: np.ndarray, places: np.ndarray, stop: np.ndarray, first: np.ndarray, length: int,
) -> Iterator[tuple[int, np.ndarray]]:
    """(bytes, numbers of the places) of each maximal repeat of at least `length` bytes.

    places are where such strings start, stop where their blocks end, and first
    tells which start a block. A repeat is maximal if its places differ in the
    byte before them; a block's start differs from all else.
    """
    order, lcp = suffix_array(text, places, stop)
    before = np.where(first, -1 - np.arange(len(places)), text[places - 1].astype(np.int64))[order]
    deep = lcp >= length
    opens = np.flatnonzero(~deep & np.r_[deep[1:], False])
    if not len(opens):
        return
    closes = np.flatnonzero(deep & ~np.r_[deep[1:], False])
    # where all of a run have one byte before them, so have its intervals
    edges = np.column_stack([opens, closes + 1]).ravel()
    if edges[-1] == len(before):
        before = np.r_[before, 0]
    low, high = np.minimum.reduceat(before, edges)[::2], np.maximum.reduceat(before, edges)[::2]
    for lo, hi in zip(opens[low != high].tolist(), closes[low != high].tolist()):
        # stack of open intervals: (common prefix, left end)
        stack: list[tuple[int, int]] = []
        for i, here in enumerate([*lcp[lo + 1:hi + 1].tolist(), 0], lo + 1):
            left = i - 1
            while stack and stack[-1][0] > here:
                size, left = stack.pop()
                if (before[left:i] != before[left]).any():
                    yield size, order[left:i]
            if here and (not stack or stack[-1][0] < here):
                stack.append((here, left))


def groups_in(parts: list[tuple], length: int) -> list[tuple]:
    """(digest, bytes, part's number, offset) of all occurrences of the maximal repeats in parts (bytes, times).

    Parts are distinct; one that occurs several times itself is a repeat too,
    where no other part has all of it.
    """
    some = [k for k, (b, _) in enumerate(parts) if len(b) >= length]
    if not some:
        return []
    text = np.frombuffer(b"".join(parts[k][0] for k in some), np.uint8)
    sizes = np.array([len(parts[k][0]) for k in some])
    ends = np.cumsum(sizes)
    strings = sizes - length + 1
    owner = np.repeat(np.arange(len(some)), strings)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    places = (ends - sizes)[owner] + inner
    out, whole = [], {k for k, n in enumerate(some) if parts[n][1] > 1}

    def group(size: int, which: np.ndarray) -> None:
        at = int(places[which[0]])
        digest = int.from_bytes(hashlib.blake2b(text[at:at + size].tobytes(), digest_size=8).digest(), "little", signed=True)
        out.extend((digest, size, some[o], i) for o, i in zip(owner[which].tolist(), inner[which].tolist()))

    for size, which in maximal_repeats(text, places, ends[owner], inner == 0, length):
        group(size, which)
        whole -= {k for k, i in zip(owner[which].tolist(), inner[which].tolist()) if i == 0 and size == sizes[k]}
    for k in sorted(whole):
        group(int(sizes[k]), np.array([int(np.searchsorted(owner, k))]))
    return out


def repeats_in(parts: list[tuple], length: int) -> list[tuple]:
    """(doc, th, start, end) spans of parts (doc, th, start, bytes) that occur before, by (doc, th, start)."""
    parts = sorted((p for p in parts if len(p[3]) >= length), key=lambda p: p[:3])
    if not parts:
        return []
    text = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    sizes = np.array([len(p[3]) for p in parts])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    strings = sizes - length + 1
    owner = np.repeat(np.arange(len(parts)), strings)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    places = begin[owner] + inner
    # blocks are in rank, but those of one document may overlap: rank their strings by start
    starts = np.array([p[2] for p in parts])[owner] + inner
    same = np.array([0, *np.cumsum([p[:2] != q[:2] for p, q in zip(parts[1:], parts)])])[owner]
    mark = np.zeros(len(text) + 1, np.int64)
    for size, which in maximal_repeats(text, places, ends[owner], inner == 0, length):
        order = np.lexsort((starts[which], same[which]))
        rest = places[which[order[1:]]]
        np.add.at(mark, rest, 1)
        np.add.at(mark, rest + size, -1)
    covered = np.cumsum(mark[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)) != 0)
    out = []
    for s, e in zip(turn[::2].tolist(), [*turn[1::2].tolist(), len(text)]):
        k = int(np.searchsorted(ends, s, side="right"))
        while s < e:  # a run may go on in the next part
            cut = min(e, int(ends[k]))
            d, th, at, _ = parts[k]
            out.append((d, th, at + s - int(begin[k]), at + cut - int(begin[k])))
            s, k = cut, k + 1
    return out


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [blocks(np.frombuffer(x.as_buffer() or b"", np.uint8), length) for x in part.column(2)]
                sizes = [len(f[0]) for f in found]
                ids = np.repeat(part.column(0).to_numpy(), sizes)
                th = np.repeat(part.column(1).to_numpy(), sizes)
                cols = [np.concatenate([f[i] for f in found]) for i in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(ids), pa.array(th),
                     pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int16)), pa.array(cols[4].astype(np.int16))],
                    names=["akey", "bkey", "doc", "th", "start", "strings", "off"])

    return rows.select("doc", "th", "bytes").mapInArrow(
        run, "akey bigint, bkey bigint, doc bigint, th bigint, start int, strings smallint, off smallint")


def _pieces(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted blocks, in PIECE's columns."""
    lists = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("akey", "start", "size", "off", "big")).alias("want"))
    both = rows.join(lists, ["doc", "th"]).select("doc", "th", "bytes", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = [(w["akey"], doc, th, w["start"], w["off"], text[w["start"]:w["start"] + w["size"]], w["big"])
                       for doc, th, text, want in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)) for w in want]
                yield _batch(out, PIECE)

    return both.mapInArrow(run, PIECE)


PIECE = "akey bigint, doc bigint, th bigint, start int, off int, piece binary, big boolean"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, k in enumerate(kinds)], names=names)


SPANS = "doc bigint, th bigint, start int, end int"


def _by_array(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of repeats, from arrays of whole anchor groups up to CHUNK bytes."""
    dealt = pieces.where("NOT big").select("akey", "doc", "th", "start", "piece").repartition("akey").sortWithinPartitions("akey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for akey, *part in zip(*(c.to_pylist() for c in b.columns)):
                if size > CHUNK and akey != last:
                    yield _batch(repeats_in(held, length), SPANS)
                    held, size = [], 0
                held.append(tuple(part))
                size += len(part[3])
                last = akey
        yield _batch(repeats_in(held, length) if held else [], SPANS)

    return dealt.mapInArrow(run, SPANS)


def _narrowed(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Blocks of crowded anchors cut by how far before the anchor a string starts, `width` distances to a part.

    All strings of such a part share the bytes between the latest start and the
    earliest end; these make its new anchor, so equal strings stay together,
    while neighbours of one common line or passage part.
    """
    schema = "akey bigint, same bigint, doc bigint, th bigint, start int, off int, piece binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda *xs: int.from_bytes(hashlib.blake2b(b"".join(xs), digest_size=8).digest(), "little", signed=True)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                out = []
                for akey, doc, th, start, off, piece in zip(*(c.to_pylist() for c in b.slice(at, 1000).columns)):
                    i, n = 0, len(piece) - length + 1
                    while i < n:
                        part = (off - i) // width
                        j = min(n, off - part * width + 1)
                        # strings i to j - 1 start off - i to off - j + 1 before the anchor
                        low, high = part * width, part * width + width - 1
                        core = piece[max(0, off - low):max(0, off - high + length)]
                        cut = piece[i:j + length - 1]
                        key = digest(akey.to_bytes(8, "little", signed=True), part.to_bytes(4, "little", signed=True), core)
                        out.append((key, digest(cut), doc, th, start + i, off - i, cut))
                        i = j
                yield _batch(out, schema)

    return pieces.select("akey", "doc", "th", "start", "off", "piece").mapInArrow(run, schema)


def _crowded(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of repeats in anchors of more than GROUP blocks, which are cut into ever narrower parts."""
    spans = None
    place = F.struct("doc", "th", "start")
    for width in WIDTHS:
        parts = common.settle(_narrowed(pieces, width, length))
        firsts = parts.groupBy("akey", "same").agg(
            F.min(F.struct("doc", "th", "start", "off", "piece")).alias("f"), F.count(F.lit(1)).alias("n"))
        firsts = common.settle(firsts)
        again = (
            parts.drop("piece", "off").join(firsts.where("n > 1").select("akey", "same", F.struct("f.doc", "f.th", "f.start").alias("first"),
                                               F.octet_length("f.piece").alias("bytes")), ["akey", "same"])
            .where(place != F.col("first")).select("doc", "th", "start", (F.col("start") + F.col("bytes")).cast("int").alias("end"))
        )
        several = firsts.groupBy("akey").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        rest = firsts.join(several, "akey").select("akey", "f.*", (F.col("k") > GROUP).alias("big"))
        found = common.settle(again.unionByName(_by_array(rest, length)))
        spans = found if spans is None else spans.unionByName(found)
        pieces = common.settle(rest.where("big").select("akey", "doc", "th", "start", "off", "piece"))
        if pieces.isEmpty():
            break
    return spans


def _one_each(rows: DataFrame) -> DataFrame:
    """rows (doc, th, bytes) without repeats; only texts whose doc and th come again are compared."""
    again = common.settle(rows.groupBy("doc", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "th"))
    if again.isEmpty():
        return rows
    return rows.join(again, ["doc", "th"], "left_anti").unionByName(
        common.settle(rows.join(again, ["doc", "th"], "left_semi").distinct()))


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(repeat, size, doc_id, start): every occurrence of every repeat of at least `length` bytes, a row each.

    A repeat is a string that occurs more than once in the texts (UTF-8 bytes)
    and has different bytes, or a border between anchors, before its places;
    `repeat` is a digest of it. Repeats that go over several anchors are given
    anchor by anchor, and together cover all that occurs again. Texts are taken
    as in remove_repeats: equal rows are one text.
    """
    rows = _one_each(docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b"")).alias("bytes"),
        F.col("doc_id").cast("bigint").alias("doc_id")).withColumn("th", F.xxhash64("bytes")).select("doc", "th", "bytes"))
    shared, firsts = _shared(rows, length)
    several = firsts.groupBy("akey").agg(F.count(F.lit(1)).alias("k"))
    kinds = common.settle(firsts.join(several, "akey").select("akey", "bkey", "n", "k", "f", "strings"))
    alone = shared.join(kinds.where("k = 1 AND n > 1").select("akey", "bkey"), ["akey", "bkey"], "left_semi").select(
        F.col("bkey").alias("repeat"), (F.col("strings") + (length - 1)).cast("int").alias("size"), "doc", "start")
    wanted = kinds.where("k > 1").select("akey", "f.doc", "f.th", "f.start", F.col("f.off").cast("int").alias("off"),
                                         (F.col("strings") + (length - 1)).cast("int").alias("size"), (F.col("k") > GROUP).alias("big"))
    named = kinds.select("akey", "bkey", "n", "f.doc", "f.th", "f.start")
    pieces = common.settle(_pieces(rows, wanted).join(named, ["akey", "doc", "th", "start"]).select(
        "akey", F.col("akey").alias("a0"), "bkey", F.lit(0).alias("rel"), "off", "piece", F.col("n").cast("bigint").alias("times"), "big"))
    found = _grouped(pieces.where("NOT big"), length)
    crowded = pieces.where("big")
    for width in WIDTHS:
        if crowded.isEmpty():
            break
        cut = common.settle(_narrowed(crowded.select("akey", F.col("a0").alias("doc"), F.col("bkey").alias("th"), F.col("rel").alias("start"), "off", "piece"), width, length))
        cut = cut.withColumnsRenamed({"doc": "a0", "th": "bkey", "start": "rel"})
        times = crowded.select("a0", "bkey", F.col("times").alias("t")).distinct()
        one = cut.join(times, ["a0", "bkey"]).groupBy("akey", "same").agg(
            F.min(F.struct("a0", "bkey", "rel", "off", "piece")).alias("f"), F.sum("t").alias("times"))
        sizes = one.groupBy("akey").agg(F.count(F.lit(1)).alias("k"))
        one = common.settle(one.join(sizes, "akey").select("akey", "same", "f.*", "times", ((F.col("k") > GROUP) & F.lit(width > 1)).alias("big")))
        # what is said of one of several equal parts holds for all of them
        equal = cut.join(one.select("akey", "same", F.col("a0").alias("f_a"), F.col("bkey").alias("f_b"), F.col("rel").alias("f_r")), ["akey", "same"]).select("a0", "bkey", "rel", "f_a", "f_b", "f_r")
        part = _grouped(one.where("NOT big").withColumn("base", F.col("rel")), length)
        back = part.join(equal, (F.col("p_a") == F.col("f_a")) & (F.col("p_b") == F.col("f_b")) & (F.col("p_r") == F.col("f_r"))).select(
            "repeat", "size", F.col("a0").alias("p_a"), F.col("bkey").alias("p_b"), F.col("rel").alias("p_r"), "inner")
        found = found.unionByName(common.settle(back))
        crowded = common.settle(cut.join(one.where("big").select("akey", "same"), ["akey", "same"], "left_semi").join(times, ["a0", "bkey"]).select(
            "akey", "a0", "bkey", "rel", "off", "piece", F.col("t").alias("times")))
    places = shared.select(F.col("akey").alias("p_a"), F.col("bkey").alias("p_b"), "doc", F.col("start").alias("at"))
    inside = found.join(places, ["p_a", "p_b"]).select("repeat", "size", "doc", (F.col("at") + F.col("p_r") + F.col("inner")).cast("int").alias("start"))
    out = alone.unionByName(inside).distinct()
    return out.select("repeat", "size", F.when(F.col("doc") > -(1 << 63), F.col("doc")).alias("doc_id"), "start")


def _grouped(pieces: DataFrame, length: int) -> DataFrame:
    """(repeat, size, p_a, p_b, p_r, inner): occurrences of repeats in pieces (akey, a0, bkey, rel, piece, times), an anchor at a time."""
    dealt = pieces.select("akey", "a0", "bkey", "rel", "piece", "times").repartition("akey").sortWithinPartitions("akey")
    schema = "repeat bigint, size int, p_a bigint, p_b bigint, p_r int, inner int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[tuple]) -> pa.RecordBatch:
            got = groups_in([(h[4], h[5]) for h in held], length)
            return _batch([(d, n, *held[k][1:4], i) for d, n, k, i in got], schema)

        held, last = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[0] != last:
                    yield found(held)
                    held = []
                held.append(row)
                last = row[0]
        yield found(held)

    return common.settle(dealt.mapInArrow(run, schema))


def _shared(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """All blocks of anchors that occur again, and the first of each distinct one with how often it is there."""
    anchors = _anchors(rows, length)
    common_ones = common.settle(anchors.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("akey"))
    shared = common.settle(anchors.join(common_ones, "akey", "left_semi"))
    return shared, common.settle(
        shared.groupBy("akey", "bkey").agg(F.min(F.struct("doc", "th", "start", "off")).alias("f"), F.first("strings").alias("strings"),
            F.count(F.lit(1)).alias("n")))


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, th, spans) of the texts in rows (doc, th, bytes) that have strings which also start earlier.

    Equal rows are one text, so neither holds the other's strings first.
    """
    rows = _one_each(rows.select("doc", "th", "bytes"))
    shared, firsts = _shared(rows, length)
    place = F.struct("doc", "th", "start")
    again = (
        shared.join(firsts.where("n > 1").select("akey", "bkey", F.struct("f.doc", "f.th", "f.start").alias("first")), ["akey", "bkey"])
        .where(place != F.col("first"))
        .select("doc", "th", "start", (F.col("start") + F.col("strings") + (length - 1)).cast("int").alias("end"))
    )
    several = firsts.groupBy("akey").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    wanted = firsts.join(several, "akey").select(
        "akey", "f.doc", "f.th", "f.start", F.col("f.off").cast("int").alias("off"), (F.col("strings") + (length - 1)).cast("int").alias("size"),
        (F.col("k") > GROUP).alias("big"))
    pieces = common.settle(_pieces(rows, wanted))
    spans = again.unionByName(_by_array(pieces, length))
    crowded = pieces.where("big")
    if not crowded.isEmpty():
        spans = spans.unionByName(_crowded(crowded, length))
    return common.settle(spans).groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each row of docs without the bytes that strings of `length` bytes cover which also start earlier.

    Earlier is a smaller doc_id, or the same text and a smaller start; texts
    are UTF-8 bytes, a null one is empty. Rows of equal doc_id rank by a hash
    of the text, and equal rows are one text: each gets that text's result. A
    null doc_id ranks first. Returns doc_id, kept (binary, what is left
    joined), spans (array of maximal removed (start, end) byte ranges) and
    n_bytes.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b"")).alias("bytes"),
    )
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("bytes"))
    spans = repeated_spans(rows, length)
    both = rows.join(spans, ["doc", "th"], "left").select("doc_id", "bytes", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for doc_id, text, found in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    joined: list[list[int]] = []
                    for s in found or ():
                        if joined and s["start"] <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], s["end"])
                        else:
                            joined.append([s["start"], s["end"]])
                    kept, last = [], 0
                    for s, e in joined:
                        kept.append(text[last:s])
                        last = e
                    kept.append(text[last:])
                    out.append((doc_id, b"".join(kept), [{"start": s, "end": e} for s, e in joined], len(text)))
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                kinds = [("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", span), ("n_bytes", pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)],
                                                 names=[n for n, _ in kinds])

    return both.mapInArrow(run, "doc_id bigint, kept binary, spans array<struct<start:int,end:int>>, n_bytes bigint")


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left of UTF-8 bytes without spans, which shrink to whole characters."""
    kept, last = [], 0
    for s, e in spans:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        kept.append(text[last:s])
        last = e
    kept.append(text[last:])
    return b"".join(kept).decode("utf-8", "replace")


def dedup_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeats taken out of `text` (whole characters only) and n_chars, if there, set anew.

    Repeats are as in remove_repeats; all rows stay, with their columns, and a
    null text stays null.
    """
    doc, th, found = (common.unused(n, docs.columns) for n in ("doc", "th", "spans"))
    data = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    spans = repeated_spans(docs.select(place.alias("doc"), F.xxhash64(data).alias("th"), data.alias("bytes")), length)
    rows = docs.withColumn(doc, place).withColumn(th, F.xxhash64(data))
    both = rows.join(spans.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("spans").alias(found)), [doc, th], "left").select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(found))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = []
                for text, found in zip(part.column(at_text).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    joined: list[list[int]] = []
                    for s in found or ():
                        if joined and s["start"] <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], s["end"])
                        else:
                            joined.append([s["start"], s["end"]])
                    texts.append(whole_characters(text.encode(), joined) if joined else text)
                cols = part.columns[:-1]
                cols[at_text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names[:-1])

    out = both.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 100 bytes is ranked among its equals; runs of later ones make the spans. Bytes are pairs of hexadecimal digits.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, b, substr(h, CAST(1000 * b + 1 AS INT), 1198) AS x FROM (SELECT doc_id, h, unnest(range((length(h) + 999) // 1000)) AS b FROM d)),
p AS (SELECT doc_id, 500 * b + q AS p, substr(x, CAST(2 * q + 1 AS INT), 200) AS y FROM (SELECT *, unnest(range(least(500, length(x) // 2 - 99))) AS q FROM c)),
w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY md5_number(y) ORDER BY doc_id, p) > 1 AS later FROM p),
g AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS opens FROM w WHERE later),
s AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT doc_id, p, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM s),
t AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last,
        string_agg(substr(h, CAST(2 * before + 1 AS INT), CAST(2 * (s - before) AS INT)), '' ORDER BY s) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS INT)))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
