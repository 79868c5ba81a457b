"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms are words and runs of three bytes, hashed; pairs of neighbouring
characters by kind (lower case, capital, each punctuation mark, ...); a word
that repeats the one before it, and a word seen before. Their weights
(logarithmic counts by inverse document frequency) are projected onto the
leading singular vectors of the labelled sample.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common, labelled

#: Labelled documents the model is fitted on and votes with, kept singular vectors, voters.
LABELLED, LATENT, VOTERS = 4096, 64, 15
THRESHOLD = 0.5
KINDS = 40
#: Columns for hashed words and for hashed runs of bytes, and what either family of terms weighs beside the kinds.
HASHED, BESIDE = 4096, 0.5
CACHE_WORDS = 400_000


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.int32)  # lower case and whatever isn't ASCII
    for c in range(128):
        s = chr(c)
        out[c] = (0 if s.islower() else 1 if s.isupper() else 2 if s.isdigit() else 3 if s == "\n" else
                  4 if s.isspace() else 5)
    for k, s in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        out[ord(s)] = 6 + k
    return out


KIND = _kinds()
#: Where the families of terms end: kinds and repetitions, words, runs of bytes.
FAMILIES = np.cumsum([KINDS * KINDS + 2, HASHED, HASHED])
TERMS = int(FAMILIES[-1])


class WordColumns(dict):
    """The column of each word; forgets all beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        k = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) % HASHED
        return k


def counts(text: str, columns: WordColumns, out: np.ndarray) -> None:
    """How often each term occurs in a text, into a row of TERMS numbers."""
    out[:] = 0
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(b), 1 << 20):  # long texts in stretches that overlap by what a term spans
        part = b[at:at + (1 << 20) + 2]
        k = KIND[part[:(1 << 20) + 1]]
        if len(k) > 1:
            out[:KINDS * KINDS] += np.bincount(k[:-1] * KINDS + k[1:], minlength=KINDS * KINDS)
        if len(part) > 2:
            x = part.astype(np.uint32)
            code = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
            out[FAMILIES[1]:] += np.bincount(code >> np.uint32(20), minlength=HASHED)
    words = text.lower().split()
    if words:
        out[FAMILIES[0]:FAMILIES[1]] = np.bincount(np.fromiter(map(columns.__getitem__, words), np.int64, len(words)), minlength=HASHED)
    exact = text.split()
    out[KINDS * KINDS] = sum(map(eq, exact, exact[1:]))
    out[KINDS * KINDS + 1] = len(exact) - len(set(exact))


class LatentVotes:
    """Fitted on labelled texts; scores are the similarity-weighted share of label 1 among the voters."""

    def __init__(self, texts: list[str], labels: list[int], latent: int = LATENT, voters: int = VOTERS):
        y = np.array(labels, np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.voters = min(voters, len(y))
        self.labels = y
        self.columns = WordColumns()
        if not len(y):
            return
        x = self._logs(texts)
        seen = np.zeros(TERMS, np.float64)
        for a in range(0, len(x), 256):
            seen += (x[a:a + 256] > 0).sum(axis=0)
        self.idf = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
        self._weigh(x)
        self.axes = singular(x, latent)
        self.reference = self._latent(x)

    def _logs(self, texts: list[str]) -> np.ndarray:
        x = np.empty((len(texts), TERMS), np.float32)
        for row, t in zip(x, texts):
            counts(t, self.columns, row)
        return np.log1p(x, out=x)

    def _weigh(self, x: np.ndarray) -> None:
        """By idf, each family to its own length, then rows to length 1; in place."""
        x *= self.idf
        start = 0
        for k, end in enumerate(FAMILIES.tolist()):
            part = x[:, start:end]
            part *= (1.0 if k == 0 else BESIDE) / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-12)[:, None]
            start = end

    def _latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        for a in range(0, len(texts), 128):
            x = self._logs(texts[a:a + 128])
            self._weigh(x)
            s = self._latent(x) @ self.reference.T
            at = np.argpartition(-s, self.voters - 1, axis=1)[:, :self.voters]
            w = np.maximum(np.take_along_axis(s, at, axis=1).astype(np.float64), 0)
            total = w.sum(axis=1)
            out[a:a + 128] = np.where(total > 0, (w * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)

    def __getstate__(self):
        return self.__dict__ | {"columns": WordColumns()}


def singular(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """The k leading right singular vectors of x as columns, by subspace iteration from a fixed start."""
    k = min(k, *x.shape)
    q = np.random.default_rng(7).normal(size=(x.shape[1], min(x.shape[1], k + 16))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd((x @ q).astype(np.float64), full_matrices=False)
    return np.ascontiguousarray((q @ v[:k].T.astype(np.float32)).astype(np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    The model sees at most `most` labelled documents outside the held-out
    fold; its labelled vectors (most x LATENT floats) are broadcast and every
    document is compared with all of them, a block at a time. A text without
    terms (null, empty, one blank) gets the share of label 1. Without
    labels all scores are 0.5. Ties among voters are cut at VOTERS.
    """
    rows = labelled.sample(docs, labels, "quality", most)
    model = LatentVotes([t for _, t, _ in rows], [y for _, _, y in rows])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return labelled.scored(docs, lambda: sent.value.score, THRESHOLD)


def drop_rejected(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """The rows of docs that score at least THRESHOLD, with their columns."""
    rows = labelled.sample(docs, labels, "quality", most)
    model = LatentVotes([t for _, t, _ in rows], [y for _, _, y in rows])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return common.filter_texts(
        docs, lambda: lambda texts: (sent.value.score([t or "" for t in texts]) >= THRESHOLD).tolist())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
