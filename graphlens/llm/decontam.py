"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs with at most e edits and is cut into e + 1 pieces has
at least one piece untouched. An automaton over all pieces finds those exactly;
Myers' bit-parallel distance then decides within the window a hit allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of items in one automaton; more items take more passes over the documents.
BLOCK_CHARS = 4_000_000
#: Edits a character, and the length below which items must occur exactly.
ERROR_RATE, SHORT = 0.05, 40


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(n: int, error_rate: float, short: int = SHORT) -> int:
    return int(n * error_rate) if n >= short else 0


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of pattern as a part of text, first on ties; None above most."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m + 1, -1
    if m <= most:
        best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def automaton(items: list[tuple[int, str]], error_rate: float, short: int = SHORT):
    """Pieces of all items; a piece leads to its (item's number, offset) places."""
    places: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(items):
        n, e = len(text), budget(len(text), error_rate, short)
        for j in range(e + 1):
            a, b = j * n // (e + 1), (j + 1) * n // (e + 1)
            places.setdefault(text[a:b], []).append((k, a))
    auto = ahocorasick.Automaton()
    for piece, at in places.items():
        auto.add_word(piece, (len(piece), at))
    if places:
        auto.make_automaton()
    return auto


def _apart(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither starts nor ends inside a word."""
    word = lambda c: c.isalnum() or c == "_"
    return not (a and word(text[a - 1]) and word(text[a])) and not (b < len(text) and word(text[b - 1]) and word(text[b]))


def find(text: str, items: list[tuple[int, str]], auto, error_rate: float, short: int = SHORT) -> dict[int, tuple[int, int]]:
    """{item's number: (distance, end in the normalised text)}, the best of each, first on ties."""
    if not len(auto):
        return {}
    found = {}
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, (size, places) in auto.iter(text):
        for k, offset in places:
            n = len(items[k][1])
            start = end + 1 - size - offset
            if n < short:
                if k not in found and _apart(text, start, end + 1):
                    found[k] = (0, end + 1)
                continue
            e = budget(n, error_rate, short)
            windows.setdefault(k, []).append((max(0, start - e), min(len(text), start + n + e)))
    for k, spans in windows.items():
        spans.sort()
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        pattern = items[k][1]
        for a, b in merged:
            got = None
            at = text.find(pattern, a, b)
            if at >= 0:
                got = (0, at + len(pattern))
            else:
                hit = myers(pattern, text[a:b], budget(len(pattern), error_rate, short))
                got = hit and (hit[0], a + hit[1])
            if got and (k not in found or got[0] < found[k][0]):
                found[k] = got
    return found


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, block) of the items with a text, and the number of blocks, of about BLOCK_CHARS characters each."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def _passes(benchmark: DataFrame, out: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """out(items) for a block of normalised items after the other; of several blocks only one is in the driver and sent at a time."""
    items, n = _items(benchmark)
    for k in range(n):
        block = [(i, t) for i, t in ((r[0], normal(r[1])) for r in items.where(F.col("block") == k).select("item_id", "text").collect()) if t]
        sent = benchmark.sparkSession.sparkContext.broadcast(sorted(block, key=lambda x: (x[0] is not None, x[0], x[1])))
        if n == 1:
            yield out(sent)
        else:
            yield common.settle(out(sent))
            sent.unpersist()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, short: int = SHORT) -> DataFrame:
    """The rows of docs that contain no benchmark item (see match_items), with their columns."""
    left = [docs]

    def one_pass(sent: Broadcast) -> DataFrame:
        def make():
            own = sent.value
            auto = automaton(own, error_rate, short)
            return lambda texts: [not find(normal(t), own, auto, error_rate, short) for t in texts]

        return common.filter_texts(left[0], make)

    for rest in _passes(benchmark, one_pass):
        left[0] = rest
    return left[0]


def match_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, short: int = SHORT) -> DataFrame:
    """(doc_id, item_id, distance, end): each benchmark item that each document contains.

    Both sides are normalised; an item of n characters may occur with
    floor(n * error_rate) edits. Items of under `short` characters must occur
    exactly and not inside a longer word, since few letters more or less make
    another text of them. Empty and null items match nothing; null texts are
    empty. Documents of equal id each give their rows, and so do items. `end`
    is where the best occurrence ends in the normalised text. Items are taken
    in blocks of about BLOCK_CHARS characters, a pass over the documents each,
    so what is in the driver and sent to the executors stays bounded (by the
    longest item, where that is longer).
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, distance int, end int"

    def one_pass(sent: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            auto = automaton(own, error_rate, short)
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    out = [(doc_id, own[k][0], d, end)
                           for doc_id, text in zip(*(c.to_pylist() for c in b.slice(at, 500).columns))
                           for k, (d, end) in sorted(find(normal(text), own, auto, error_rate, short).items())]
                    kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)],
                                                     names=[n for n, _ in kinds])

        return texts.mapInArrow(scan, schema)

    return reduce(DataFrame.unionByName, _passes(benchmark, one_pass))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains."""
    return match_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
