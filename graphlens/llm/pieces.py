"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

Pieces and their log scores come from a model file, which is read and never
trained. Best paths are found for many words in step, with one array operation
for a byte of all of them; what was found for a word serves its other
occurrences.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The format's piece types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs below the lowest score.
UNK_PENALTY = 10.0
MODEL_BYTES = 64 << 20
#: Words whose ids are kept, and characters of the longest of them.
CACHE_WORDS, CACHED_CHARS = 150_000, 128
CELLS = 1 << 21
#: Blocks of fewer words than this are searched word by word: an array operation a byte costs more than it saves.
FEW_WORDS = 24


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, raw[at:at + n]
            at += n
        else:
            n = varint()
            yield tag >> 3, raw[at:at + n]
            at += n


def read_model(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id. Only models without a normaliser of their own are taken."""
    out = []
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            out.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
        elif number == 3:
            f = dict(_fields(value))
            if f.get(2) or f.get(4, 1) or not f.get(3, 1) or not f.get(5, 1):
                raise ValueError("the model's normaliser isn't supported: identity, with dummy prefix and escaped spaces")
    return out


class Trie:
    """Double array over UTF-8 bytes: child = base[s] + byte + 1, valid if check[child] == s; 0 is the root."""

    def __init__(self, pieces: dict[bytes, int]):
        size = 1 << 12
        self.base, self.check, self.value = [np.full(size, -1, np.int32) for _ in range(3)]
        self.check[0] = 0
        free = 1
        todo = [(0, sorted(pieces), 0, 0, len(pieces))]
        while todo:
            state, keys, depth, lo, hi = todo.pop()
            if len(keys[lo]) == depth:
                self.value[state] = pieces[keys[lo]]
                lo += 1
                if lo == hi:
                    continue
            runs, i = [], lo
            while i < hi:
                c, j = keys[i][depth] + 1, i
                while j < hi and keys[j][depth] + 1 == c:
                    j += 1
                runs.append((c, i, j))
                i = j
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            codes = np.array([c for c, _, _ in runs])
            at, b = max(free, int(codes[0]) + 1), 0
            while not b:
                if at + 4096 + 258 >= len(self.check):
                    self._grow()
                slots = at + np.flatnonzero(self.check[at:at + 4096] < 0)
                for c in codes[1:]:
                    slots = slots[self.check[slots + (c - codes[0])] < 0]
                b = int(slots[0] - codes[0]) if len(slots) else 0
                at += 4096
            self.base[state] = b
            for c, i, j in runs:
                self.check[b + c] = state
                todo.append((b + c, keys, depth + 1, i, j))
        self.base = np.concatenate([self.base, np.full(258, -1, np.int32)])
        self.check = np.concatenate([self.check, np.full(258, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(258, -1, np.int32)])

    def _grow(self):
        for name in ("base", "check", "value"):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(len(old), -1, np.int32)]))


class Tokenizer:
    """encode and decode as the format's Unigram models do, ids as in the model."""

    def __init__(self, vocab: list[tuple[str, float, int]], trie: Trie | None = None):
        self.vocab = vocab
        usable = {p.encode(): i for i, (p, _, t) in enumerate(vocab) if t in (NORMAL, USER)}
        scores = [s for _, s, t in vocab if t == NORMAL]
        low, high = min(scores, default=0.0), max(scores, default=0.0)
        self.unk_score = np.float64(low - UNK_PENALTY)
        self.score = np.array([len(p) * high - 0.1 if t == USER else s for p, s, t in vocab], np.float64)
        self.trie = trie or Trie(usable)
        self.longest = max(map(len, usable), default=1)
        self.unk = next((i for i, (_, _, t) in enumerate(vocab) if t == UNKNOWN), 0)
        self.byte_id = {int(p[3:-1], 16): i for i, (p, _, t) in enumerate(vocab) if t == BYTE}
        self.raw = [bytes([int(p[3:-1], 16)]) if t == BYTE else b"" if t == CONTROL else p.encode() for p, _, t in vocab]
        text = [p for p, _, t in vocab if t in (NORMAL, USER)]
        # where no piece crosses a word's start or a line's end, words can be searched one by one
        by_word = not any(SPACE in p.lstrip(SPACE) for p in text)
        by_line = not any("\n" in p for p in text)
        self.units = re.compile(
            (r"\n| *[^ \n]+| +" if by_line else r" *[^ ]+| +") if by_word else r"(?s).+").findall
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self._lists: tuple[list, list, list, list] | None = None

    def _path(self, word: bytes) -> list[int]:
        """As _paths, for one word: plain steps, a few for each byte, with arrays of the word's length alone."""
        if self._lists is None:
            self._lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.score.tolist())
        base, check, value, score = self._lists
        n, unk = len(word), float(self.unk_score)
        best = array("d", [float("-inf")]) * (n + 1)
        back, piece = array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == float("-inf"):
                continue
            lead = word[i]
            end = min(n, i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0))
            single, state = False, 0
            for j in range(i, n):
                b = base[state]
                if b < 0:
                    break
                k = b + word[j] + 1
                if check[k] != state:
                    break
                state, v = k, value[k]
                if v >= 0:
                    if j + 1 == end:
                        single = True
                    s = here + score[v]
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = s, i, v
            if not single and here + unk > best[end]:
                best[end], back[end], piece[end] = here + unk, i, -1
        out, at = [], n
        while at:
            out.append(piece[at] if piece[at] >= 0 else -1 - back[at])
            at = back[at]
        return out[::-1]

    def _paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(best piece ids of words of similar length, one word's after the other's; where each ends); unknown characters are -1 - offset."""
        n, width = len(words), max(map(len, words))
        length = np.array([len(w) for w in words], np.int32)
        # column j holds byte j of every word, plus one; 0 after the end
        codes = np.zeros((width + 4, n), np.int32)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        codes[:width] = np.where(np.arange(width)[:, None] < length, flat.T.astype(np.int32) + 1, 0)
        best = np.full((width + 1, n), -np.inf, np.float64)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((best[i] > -np.inf) & (i < length))
            if not len(rows):
                continue
            lead = codes[i, rows] - 1
            chars = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            here, single = best[i, rows], np.zeros(len(rows), bool)
            state, live = np.zeros(len(rows), np.int32), np.arange(len(rows))
            for d in range(min(self.longest, width - i)):
                c = codes[i + d, rows[live]]
                nxt = base[state] + c
                ok = (c > 0) & (base[state] >= 0)
                ok[ok] = check[nxt[ok]] == state[ok]
                live, state = live[ok], nxt[ok]
                if not len(live):
                    break
                v = value[state]
                hit = v >= 0
                at, v = live[hit], v[hit]
                single[at[chars[at] == d + 1]] = True
                cand = here[at] + self.score[v]
                r = rows[at]
                better = cand > best[i + d + 1, r]
                r = r[better]
                best[i + d + 1, r], back[i + d + 1, r], piece[i + d + 1, r] = cand[better], i, v[better]
            none = np.flatnonzero(~single)
            if len(none):
                end = np.minimum(i + chars[none], length[rows[none]])
                cand = here[none] + self.unk_score
                better = cand > best[end, rows[none]]
                end, r = end[better], rows[none][better]
                best[end, r], back[end, r], piece[end, r] = cand[better], i, -1
        # back from every word's end at once; the last steps found come first
        steps, pos, rows = [], length.copy(), np.flatnonzero(length)
        while len(rows):
            p, b = piece[pos[rows], rows], back[pos[rows], rows]
            steps.append((rows, np.where(p >= 0, p, -1 - b)))
            pos[rows] = b
            rows = rows[b > 0]
        owner, ids = (np.concatenate([s[i] for s in reversed(steps)] or [np.empty(0, np.int64)]) for i in (0, 1))
        ids = ids[np.argsort(owner, kind="stable")].astype(np.int32)
        return ids, np.cumsum(np.bincount(owner, minlength=n))

    def _learn(self, units: list[str]) -> None:
        """Find the ids of words and keep them, with what they decode to."""
        words = [(u, u.replace(" ", SPACE).encode("utf-8", "surrogatepass")) for u in units]
        words.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(words):
            end = min(len(words), at + 8192)
            while end > at + 1 and (end - at) * len(words[end - 1][1]) > CELLS:
                end = at + (end - at) // 2
            block = words[at:end]
            if len(block) >= FEW_WORDS:
                ids, ends = self._paths([w for _, w in block])
            else:
                found = [self._path(w) for _, w in block]
                ids, ends = np.fromiter(chain.from_iterable(found), np.int32), np.cumsum([len(f) for f in found])
            unknown = set(np.searchsorted(ends, np.flatnonzero(ids < 0), side="right").tolist())
            flat, plain, start = ids.tobytes(), ids.tolist(), 0
            for k, ((u, raw), end_k) in enumerate(zip(block, ends.tolist())):
                if k in unknown:
                    path = self._spelled(plain[start:end_k], raw)
                    self.cache[u] = np.array(path, np.int32).tobytes(), b"".join(map(self.raw.__getitem__, path))
                else:
                    self.cache[u] = flat[4 * start:4 * end_k], b"".join(map(self.raw.__getitem__, plain[start:end_k]))
                start = end_k
            at = end

    def _spelled(self, path: list[int], raw: bytes) -> list[int]:
        """A path with unknown characters as the ids of their bytes, or as the unknown one."""
        ids = []
        for x in path:
            if x >= 0:
                ids.append(x)
            else:
                i = -1 - x
                n = 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0)
                ids += [self.byte_id[b] for b in raw[i:i + n]] if self.byte_id else [self.unk]
        return ids

    def encode_bytes(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as four bytes each, what they decode to) of each text; nothing for an empty or null one."""
        split = [self.units(" " + t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = set().union(*split).difference(self.cache)
        self._learn(list(new))
        get, out = self.cache.__getitem__, []
        for s in split:
            ids, raw = zip(*map(get, s)) if s else ((), ())
            out.append((b"".join(ids), self._plain(b"".join(raw))))
        for u in new:
            if len(u) > CACHED_CHARS:
                del self.cache[u]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        return [np.frombuffer(ids, np.int32).tolist() for ids, _ in self.encode_bytes(texts)]

    @staticmethod
    def _plain(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids) -> str:
        """The text of ids; bytes that make no character become U+FFFD."""
        return self._plain(b"".join(map(self.raw.__getitem__, ids)))


def load(path: str = MODEL) -> Tokenizer:
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"the model is larger than {MODEL_BYTES} bytes")
    return Tokenizer(read_model(raw))


def encode_documents(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, ids, round_trip) of each row.

    A null or empty text has no ids. Long runs without blanks are searched whole,
    in time proportional to their bytes (about 2 s a MB) and some 16 bytes of
    memory a byte. round_trip tells whether decoding gives
    the text back; U+2581 in a text stands for a space in the format and so
    doesn't come back as itself. The model (its size is checked) is read by
    the driver and broadcast.
    """
    t = load(model_path)
    sent = docs.sparkSession.sparkContext.broadcast((t.vocab, t.trie))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(*sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(1).to_pylist()
                found = tok.encode_bytes(texts)
                same = [plain == (x or "") for (_, plain), x in zip(found, texts)]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(ids) // 4 for ids, _ in found], out=offsets[1:])
                flat = np.frombuffer(b"".join([ids for ids, _ in found]), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same)],
                    names=["doc_id", "ids", "round_trip"])

    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, round_trip boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")
