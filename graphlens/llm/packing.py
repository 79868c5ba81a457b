"""Token ids as packed binary rows: best-fit decreasing with a segment tree."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before its bytes are merged; a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces, found faster: what PATTERN gives back while it looks for a run's end is not tried again.
FAST_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Longer blank runs go round the pattern's engine, whose backtracking has a bound; they are one piece each.
LONGEST_BLANKS = 50_000
RANKS_BYTES = 64 << 20
#: White space as the pattern has it (Unicode's property).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text whose words are encoded together.
TEXT_BYTES = 8 << 20
PACKED = (
    "pack_id string, n_tokens int, n_segments int, ids binary, positions binary, cu_seqlens array<int>, "
    "seg_doc_ids array<bigint>, seg_keys array<string>, seg_starts array<int>, seg_doc_tokens array<int>"
)


class Capacities:
    """Open bins by room left: a segment tree over rooms finds the least that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room of at least need, taken out; None if there is none."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.tree[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, each bin's lengths at most capacity; ties keep the given order."""
    tree, bins = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[i])
        if got is None:
            bins.append([i])
            room = capacity - lengths[i]
            b = len(bins) - 1
        else:
            room, b = got
            bins[b].append(i)
            room -= lengths[i]
        tree.add(room, b)
    return bins


def token_ids(enc, text: str, longest: int = LONGEST_BLANKS) -> list[int]:
    """The ids of enc.encode_ordinary, also for texts with blank runs that its pattern can't take.

    Of a run between words the pattern makes one piece of all but the last
    character, and one of the whole at the text's end; such a run's piece is
    merged by itself, what is around it is encoded as ever.
    """
    out, at = [], 0
    for m in re.finditer(f"[{_BLANK}]{{{longest},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at:m.start()])
        out += enc._encode_single_piece(text[m.start():end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def ids_of_texts(enc, width: np.ndarray, kind: str, texts: pa.Array) -> list[np.ndarray]:
    """token_ids of each text; words between spaces are encoded once each, however often the texts have them.

    A space between two characters that are no blanks ends a piece of the
    pattern, so what follows is encoded alike wherever it stands. Texts with
    other blanks beside a space are encoded whole. width has the bytes of each token.
    """
    one = lambda t: np.array(token_ids(enc, t), kind)
    own, inner = texts.to_pylist(), []
    whole = pc.match_substring_regex(texts, f" [{_BLANK}]|[{_BLANK}] ").to_pylist()
    for k, text in enumerate(own):
        head, space, rest = ("", "", "") if whole[k] else text.partition(" ")
        middle, between, last = rest.rpartition(" ")
        inner.append(middle if between else None)
        own[k] = one(text if whole[k] else head), one(space + last)
    split = pc.split_pattern(pa.array(inner, pa.string()), " ")
    words = split.flatten().dictionary_encode()
    text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")[0].as_py()
    ids = one(text)
    at = np.cumsum(width[ids]) - width[ids]
    first = np.append(np.searchsorted(at, np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)), len(ids))
    which = words.indices.to_numpy()
    many = np.diff(first)[which]
    ends = np.append(0, np.cumsum(many))
    ids = ids[np.repeat(first[which] - ends[:-1], many) + np.arange(ends[-1])]
    ends = ends[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy()))]
    return [np.concatenate([head, ids[start:end], last]) for (head, last), start, end in zip(own, ends, ends[1:])]


def by_bytes(b: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """b in slices that have about so many bytes in a column, a row at least."""
    part = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    return (b.slice(start, end - start) for start, end in zip(cuts, cuts[1:]))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(RANKS_BYTES + 1)
    if len(raw) > RANKS_BYTES:
        raise ValueError(f"the vocabulary is larger than {RANKS_BYTES} bytes")
    return raw


def pack_documents(
    docs: DataFrame, capacity: int = 2048, ranks_path: str = RANKS, pad_id: int = 50256, window_tokens: int = 1 << 21,
) -> DataFrame:
    """Rows of exactly `capacity` ids, in PACKED's columns.

    Documents longer than capacity are cut into pieces of capacity and a rest;
    a segment names its document, where in it it starts and how many tokens
    the document has, so that concatenating a document's segments gives it
    back. ids is a little-endian uint16 (uint32 for large vocabularies) row
    padded with pad_id, positions the equally long uint16 or uint32 row that
    restarts at 0 with each segment and in the padding, cu_seqlens the
    cumulative segment lengths from 0. Each task packs its own documents,
    window_tokens at a time, so memory is bounded; windows are whole input,
    nothing is left out. Which documents share a row follows from how rows are
    dealt to tasks; the rows of a table read alike are the same each time. A
    null or empty text has no tokens and so no segment, blank runs of any length
    are encoded whole, words of about TEXT_BYTES of text are encoded once each, and a vocabulary of over RANKS_BYTES is an error.
    seg_keys tells rows of equal doc_id apart (a digest of the text).
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.hex(F.xxhash64("text")).alias("key"))
    rows = rows.where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        enc = tiktoken.Encoding("packing", pat_str=FAST_PATTERN, mergeable_ranks=ranks, special_tokens={})
        kind = "<u2" if max(len(ranks), pad_id + 1, capacity) <= 1 << 16 else "<u4"
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        width[list(ranks.values())] = [len(b) for b in ranks]
        segs: list[tuple] = []
        held = 0

        def packed() -> pa.RecordBatch:
            out = []
            for members in best_fit_decreasing([len(s[4]) for s in segs], capacity):
                line, pos = np.full(capacity, pad_id, kind), np.zeros(capacity, kind)
                cu, at = [0], 0
                for m in members:
                    n = len(segs[m][4])
                    line[at:at + n] = segs[m][4]
                    pos[at:at + n] = np.arange(n)
                    at += n
                    cu.append(at)
                pos[at:] = np.arange(capacity - at)
                own = [segs[m] for m in members]
                name = hashlib.md5(repr([s[:3] for s in own]).encode()).hexdigest()
                out.append((name, at, len(own), line.tobytes(), pos.tobytes(), cu, [s[0] for s in own],
                            [s[1] for s in own], [s[2] for s in own], [s[3] for s in own]))
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()),
                     pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            names = [c.split()[0] for c in PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

        for b in (part for b in batches for part in by_bytes(b, 1, TEXT_BYTES)):
            for doc_id, key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), ids_of_texts(enc, width, kind, b.column(1))):
                for start in range(0, len(ids), capacity):
                    segs.append((doc_id, key, start, len(ids), ids[start:start + capacity]))
                held += len(ids)
                if held >= window_tokens:
                    yield packed()
                    segs, held = [], 0
        if segs:
            yield packed()

    return rows.mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> DataFrame:
    """Write the rows as a table whose binary columns are the id matrix, and read it back."""
    packed.write.option("compression", "zstd").parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """(doc_id, key, n_doc_tokens, start, ids): the segments of the packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, cu, ids, keys, starts, totals in zip(*(c.to_pylist() for c in b.columns)):
                line = np.frombuffer(raw, dtype)
                for i, (d, k, s, n) in enumerate(zip(ids, keys, starts, totals)):
                    out.append((d, k, n, s, line[cu[i]:cu[i + 1]].astype(np.int32)))
            types = [("doc_id", pa.int64()), ("key", pa.string()), ("n_doc_tokens", pa.int32()), ("start", pa.int32()),
                     ("ids", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(types)],
                                             names=[n for n, _ in types])

    return packed.select("ids", "cu_seqlens", "seg_doc_ids", "seg_keys", "seg_starts", "seg_doc_tokens").mapInArrow(
        run, "doc_id bigint, key string, n_doc_tokens int, start int, ids array<int>")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack documents, write the table in the shared folder, and return what it holds."""
    packed = write_packed(pack_documents(common.table(spark, sf_dir, "documents")), common.scratch(spark))
    return packed.select(
        "pack_id", "n_tokens", "n_segments", "cu_seqlens", "seg_doc_ids", "seg_starts", "seg_doc_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
