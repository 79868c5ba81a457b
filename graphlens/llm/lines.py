"""Substring dedup by hashing lines or paragraphs; if asked, also the sentences of lines."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_CUT = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
#: Sentences of a line: together they are the line, character by character.
_SENTENCE = re.compile(r"[^.!?]+[.!?]*[ \t]*|[.!?]+[ \t]*")
#: White space in SQL's patterns, which lacks the vertical tab that Python's split takes.
_BLANK = re.compile(r"[\t\n\f\r ]+")
#: What SQL's trim takes: the space separators of Unicode.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")


def normal(unit: str) -> str:
    """Lower case letter by letter, runs of tabs, line ends, form feeds and spaces as one space, spaces of any width trimmed: as SQL has it."""
    # the two letters that str.lower turns into more than one, or by what follows
    low = unit.replace("İ", "i").replace("Σ", "σ").lower()
    low = _BLANK.sub(" ", low) if "\v" in low else b" ".join(low.encode("utf-8", "replace").split()).decode()
    return low.strip(_SPACES)


def _n_words(low: str) -> int:
    return low.count(" ") + 1 if low else 0


def runs(words: list[int], least: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs of at least `least` words from each sentence on and up to each, given each one's words.

    Any repeated run of so many words is covered by such runs. The whole line
    isn't among them, nor do sentences without words start or end one.
    """
    total = [0, *accumulate(words)]
    found = {(i, bisect_left(total, total[i] + least)) for i in range(len(words)) if total[i] + least <= total[-1]}
    found |= {(bisect_right(total, total[j] - least) - 1, j) for j in range(1, len(total)) if total[j] >= least}
    return {(i, j) for i, j in found if words[i] and words[j - 1] and total[j] - total[i] < total[-1]}


def _places(text: str, unit: str, min_words: int, min_sentence: int) -> Iterator[tuple[int, int, int, str]]:
    """(number of the line or paragraph, first sentence, sentence after the last, normalised) of a text's units in order.

    A whole line or paragraph has no sentences: -1 and -1.
    """
    for pos, whole in enumerate(_CUT[unit].split(text)):
        low = normal(whole)
        if not low:
            continue
        if _n_words(low) >= min_words:
            yield pos, -1, -1, low
        if unit != "line" or not min_sentence:
            continue
        parts = _SENTENCE.findall(whole)
        if len(parts) > 1:
            for i, j in sorted(runs([_n_words(normal(p)) for p in parts], min_sentence)):
                yield pos, i, j, normal("".join(parts[i:j]))


def _units(docs: DataFrame, unit: str, min_words: int, min_sentence: int, firsts: bool) -> DataFrame:
    """(doc_id, th, at, times, h1, h2) of each unit, by its number in the text; or of the first of a text's equal ones and how often it is there."""
    schema = "doc_id bigint, th bigint, at bigint, times bigint, h1 bigint, h2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                sizes, at, times, hashes = [], [], [], []
                for text in part.column(2).to_pylist():
                    own = [digest(low) for *_, low in _places(text, unit, min_words, min_sentence)]
                    if firsts:
                        first = {h: k for k, h in reversed([*enumerate(own)])}
                        count = Counter(own)
                        at += first.values()
                        times += map(count.__getitem__, first)
                        own = list(first)
                    else:
                        at += range(len(own))
                        times += [1] * len(own)
                    sizes.append(len(own))
                    hashes += own
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), pa.array(at, pa.int64()), pa.array(times, pa.int64()),
                     pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "th", "text").mapInArrow(run, schema)


def _removed(text: str, gone: list[int], unit: str, min_words: int, min_sentence: int) -> tuple[list[tuple[int, int]], int]:
    """(ranges to remove, in order and joined; units removed) where the units of the given numbers go."""
    gone_at, lost = set(gone), {}
    for k, (pos, i, j, _) in enumerate(_places(text, unit, min_words, min_sentence)):
        if k in gone_at:
            lost.setdefault(pos, set()).update(range(i, j) if i >= 0 else (-1,))
    out, n, start = [], 0, 0
    for pos, m in enumerate([*_CUT[unit].finditer(text), None]):
        stop, after = m.span() if m else (len(text), len(text))
        which = lost.get(pos)
        if which and -1 in which:
            out.append([start, after])
            n += 1
        elif which:
            parts = [x.span() for x in _SENTENCE.finditer(text, start, stop)]
            n += len(which)
            out += [[start, after]] if len(which) == len(parts) else [list(parts[i]) for i in sorted(which)]
        start = after
    joined = out[:1]
    for s, e in out[1:]:
        if joined[-1][1] == s:
            joined[-1][1] = e
        else:
            joined.append([s, e])
    return [(s, e) for s, e in joined], n


def dedup_units(docs: DataFrame, unit: str = "line", min_words: int = 1, min_sentence: int = 0) -> DataFrame:
    """Remove each line (or paragraph) that occurs before, in any document.

    A unit counts whole alone, so a passage inside otherwise different lines
    stays; remove_repeats of `suffixes` is for those. With min_sentence over 0 a
    line of several sentences counts whole and by runs of its sentences, each
    just long enough for so many words, which finds passages in longer lines but
    also takes sentences that documents share by chance. Occurrences rank by (doc_id, position), a null id first;
    the earliest stays, but runs that overlap an equal one are later. Units
    without words or of fewer than min_words words after normalising take no
    part. Rows that repeat both id and text rank alike and are treated alike:
    what is new in them stays in each; rows of one id with different texts rank
    by a hash of the text. Returns per row doc_id, text (what is left), spans
    (array of the removed (start, end) character offsets in the given text,
    adjacent ones joined), n_units (lines or paragraphs) and n_removed (of
    those, and sentences of lines that stay). A line whose sentences all go
    goes with its line end. A null text is an empty one and has one unit.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    where = F.struct(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("at").alias("a"))
    # as a table of its own, so that the join can split what very many texts have
    firsts = common.settle(_units(rows, unit, min_words, min_sentence, True).groupBy("h1", "h2")
                           .agg(F.min(where).alias("first"), F.sum("times").alias("n")).where("n > 1").drop("n"))
    gone = (_units(rows, unit, min_words, min_sentence, False).join(firsts, ["h1", "h2"])
            .where(~where.eqNullSafe(F.col("first")))
            .groupBy("doc_id", "th").agg(F.collect_set("at").alias("gone"))
            .select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), "gone"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts, spans, units, removed = [], [], [], []
                for text, gone_at in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    found, n = _removed(text, gone_at, unit, min_words, min_sentence) if gone_at else ([], 0)
                    ends = [0, *(x for s, e in found for x in (s, e)), len(text)]
                    texts.append("".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
                    spans.append([{"start": s, "end": e} for s, e in found])
                    units.append(text.count("\n") + 1 if unit == "line" else len(_CUT[unit].findall(text)) + 1)
                    removed.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(spans, span), pa.array(units, pa.int32()), pa.array(removed, pa.int32())],
                    names=["doc_id", "text", "spans", "n_units", "n_removed"])

    return joined.select("doc_id", "text", "gone").mapInArrow(
        apply, "doc_id bigint, text string, spans array<struct<start:int,end:int>>, n_units int, n_removed int")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of dedup_units; spans are the removed character ranges, as start-end with commas."""
    got = dedup_units(common.table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n_units", "n_removed", F.size("spans").alias("n_spans"),
        F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS us FROM documents),
l AS (SELECT doc_id, unnest(us) AS line, unnest(range(len(us))) AS pos, len(us) AS n FROM d),
v AS (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM l),
x AS (SELECT doc_id, pos, line || CASE WHEN pos < n - 1 THEN chr(10) ELSE '' END AS piece,
             norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS gone FROM v),
y AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
             gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM x),
z AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM y),
sp AS (SELECT doc_id, count(*) AS n_spans, string_agg(CAST(s AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY s) AS spans
       FROM (SELECT doc_id, min(s) AS s, max(s + length(piece)) AS e FROM z WHERE gone GROUP BY doc_id, k) GROUP BY doc_id)
SELECT y.doc_id, CAST(count(*) AS INT) AS n_units, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
       CAST(coalesce(any_value(n_spans), 0) AS INT) AS n_spans, CAST(coalesce(sum(length(piece)) FILTER (gone), 0) AS INT) AS removed_chars, coalesce(any_value(spans), '') AS spans,
       sha256(coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM y LEFT JOIN sp ON sp.doc_id = y.doc_id GROUP BY y.doc_id
"""
