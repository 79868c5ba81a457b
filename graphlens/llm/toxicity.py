"""Toxicity: a support vector machine with a subsequence string kernel and Nystrom landmarks.

The kernel counts the character subsequences of ORDER characters that two
words share, each weighted by DECAY for every character it skips, within SPAN.
A sentence is judged by its worst word, a document by its worst sentence. The
machine is trained on the sentences of labelled documents: first on all of
them as labelled, then, in rounds, on each toxic document's worst sentence
against all clean ones. No list of words is kept: a word's decision is linear
in its subsequences, known or not.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common, labelled

#: Length of subsequences, characters they may span, factor for each one skipped.
ORDER, SPAN, DECAY = 4, 6, 0.75
#: Labelled documents used, sentences of either label in the first fit, landmarks, rounds of choosing.
LABELLED, SENTENCES, LANDMARKS, ROUNDS = 4096, 10_000, 256, 4
THRESHOLD, COSTLY = 0.7, 3.0
#: Letters beyond this are cut into overlapping parts.
LONGEST = 24
CACHE_WORDS = 200_000
#: Symbols: 0 none, 1 start, 2 end, then letters by code.
SYMBOLS = 40

_LETTERS = re.compile(r"[^\W\d_]")
_SENTENCE = re.compile(r"\n|(?<=[.!?])[ \t]+")
_APART = re.compile(r"(?<!\w)(?:\w[^\w\s]*[ \t]+){3,}\w(?!\w)")


def _symbols() -> dict[str, int]:
    out = {}
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[c] = 3 + k
    return out


_SYMBOL = _symbols()


def symbol(c: str) -> int:
    """A letter's number; letters beyond a to z share the remaining numbers."""
    return _SYMBOL.get(c) or 29 + ord(c) % (SYMBOLS - 29)


def words(text: str) -> set[str]:
    """Lower-case words, letters spelled apart joined."""
    low = text.lower()
    out = set(low.split())
    if "  " in low or " " in low:
        for m in _APART.finditer(low):
            out.add("".join(m.group().split()))
    return out


def sentences(text: str) -> list[str]:
    """Lines, cut behind full stops, question and exclamation marks that blanks follow."""
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def encode(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of symbols, number of the word each row is of); only letters count."""
    rows, owner = [], []
    for k, w in enumerate(some):
        s = "".join(_LETTERS.findall(w)) if not w.isalpha() else w
        for a in range(0, max(1, len(s) - LONGEST // 2), LONGEST // 2):
            part = s[a:a + LONGEST]
            rows.append([1 if a == 0 else 0, *map(symbol, part), 2 if a + LONGEST >= len(s) else 0])
            owner.append(k)
    width = max(map(len, rows), default=ORDER)
    out = np.zeros((len(rows), max(width, ORDER)), np.int32)
    for r, row in enumerate(rows):
        out[r, :len(row)] = row
    return out, np.array(owner, np.int64)


#: Offsets after the first character, and the weight of each choice.
GAPS = [(c, DECAY ** (c[-1] + 1 - ORDER)) for c in combinations(range(1, SPAN), ORDER - 1)]


def subsequences(rows: np.ndarray):
    """(codes, weight) of each choice of gaps, for all rows and places; code 0 where there is none."""
    n, width = rows.shape
    padded = np.concatenate([rows, np.zeros((n, SPAN), np.int32)], axis=1)
    first = padded[:, :width]
    for offsets, weight in GAPS:
        code, there = first, first > 0
        for o in offsets:
            x = padded[:, o:o + width]
            there = there & (x > 0)
            code = code * SYMBOLS + x
        yield np.where(there, code, 0), weight


def features(rows: np.ndarray, columns: np.ndarray, n_columns: int) -> np.ndarray:
    """Weighted subsequence counts, by the column each code has (negative: none)."""
    out = np.zeros((len(rows), n_columns), np.float32)
    at = np.arange(len(rows))[:, None]
    for codes, weight in subsequences(rows):
        col = columns[codes]
        ok = col >= 0
        np.add.at(out, (np.broadcast_to(at, col.shape)[ok], col[ok]), weight)
    return out


class Nystrom:
    """phi(word) = K_mm^(-1/2) k_m(word): inner products are the kernel's on the landmarks' span, exact between landmarks."""

    def __init__(self, landmarks: list[str]):
        rows, _ = encode(landmarks)
        self.codes = np.unique(np.concatenate([c[c > 0] for c, _ in subsequences(rows)]))
        self.columns = np.full(SYMBOLS ** ORDER, -1, np.int32)
        self.columns[self.codes] = np.arange(len(self.codes))
        marks = features(rows, self.columns, len(self.codes)).astype(np.float64)
        values, vectors = np.linalg.eigh(marks @ marks.T)
        keep = values > values[-1] * 1e-6
        #: A subsequence's share in phi; phi is linear in the counts of subsequences.
        self.share = (marks.T @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32)

    def phi(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features, number of the word that each row is of): a row for each word, or for each part of a long one."""
        encoded, owner = encode(some)
        out = np.zeros((len(encoded), self.share.shape[1]), np.float32)
        for a in range(0, len(encoded), 4096):
            part = encoded[a:a + 4096]
            for codes, weight in subsequences(part):
                col = self.columns[codes]
                r, c = np.nonzero(col >= 0)
                if len(r):
                    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    out[a + r[starts]] += np.float32(weight) * np.add.reduceat(self.share[col[r, c]], starts, axis=0)
        return out, owner


def weigh(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's entries over each row's subsequences."""
    out = np.zeros(len(rows), np.float64)
    for codes, weight in subsequences(rows):
        out += weight * table[codes].sum(axis=1)
    return out


def fit_svm(
    parts: list[tuple[np.ndarray, np.ndarray, float, np.ndarray]], start: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 12,
) -> tuple[np.ndarray, float]:
    """Weights and bias that least squared hinge loss asks for, by Newton steps on the rows inside the margin.

    parts are (features, numbers of the rows that count, their label, their
    weights). Rows are taken a block at a time, so no features are copied.
    """
    n = parts[0][0].shape[1] + 1
    w = np.zeros(n) if start is None else start.astype(np.float64)
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-8
    total = sum(float(weight.sum()) for *_, weight in parts)
    many = sum(len(rows) for _, rows, *_ in parts)
    for _ in range(rounds):
        left, right = np.diag(penalty), np.zeros(n)
        for x, rows, label, weight in parts:
            for a in range(0, len(rows), 8192):
                z = np.column_stack([x[rows[a:a + 8192]], np.ones(len(rows[a:a + 8192]), np.float32)])
                inside = np.flatnonzero(label * (z @ w.astype(np.float32)) < 1)
                if not len(inside):
                    continue
                z, own = z[inside], weight[a:a + 8192][inside] / total
                root = z * np.sqrt(own * many).astype(np.float32)[:, None]
                left += (root.T @ root) / many
                right += label * (z.T @ own)
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, rtol=1e-4, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


class StringKernelMachine:
    """Fitted on labelled texts. A word's decision is linear in its subsequences, so it is one table look-up each."""

    def __init__(self, texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS):
        self.table = np.zeros(SYMBOLS ** ORDER, np.float32)
        self.bias, self.slope, self.offset = -1.0, 1.0, 0.0
        y = np.array(labels)
        self.prior = float(y.mean()) if len(y) else 0.0
        self.cache: dict[str, float] = {}
        if not 0 < self.prior < 1:
            self.slope, self.offset = 0.0, -20.0 if self.prior == 0 else 20.0
            return
        self._fit(texts, y, landmarks, rounds)

    def _fit(self, texts, y, landmarks, rounds):
        """Sentences have their document's label: all of a clean one's are clean, of a toxic one's at least one is toxic.

        First all sentences, by the mean of their words, are told apart as they
        are labelled. Then, round by round, each toxic document's worst sentence
        by its worst word is set against every word of the clean sentences.
        """
        number: dict[str, int] = {}
        documents = [[[number.setdefault(w, len(number)) for w in sorted(words(s))] for s in sentences(t)] for t in texts]
        vocabulary = list(number)
        some = [np.unique(np.fromiter((w for s in d for w in s), np.int64)) for d in documents]
        in_toxic, in_clean = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
        for bag, label in zip(some, y):
            (in_toxic if label else in_clean)[bag] += 1
        if not len(vocabulary) or not in_toxic.any() or not in_clean.any():
            self.slope, self.offset = 0.0, float(np.log(self.prior / (1 - self.prior)))
            return
        rng = np.random.default_rng(1)
        # half the landmarks are what toxic documents have more often than clean ones, the others common and rare words
        ratio = np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_clean + 0.5) / (len(y) - y.sum() + 1))
        telling = np.lexsort((np.arange(len(ratio)), -ratio * np.log1p(in_toxic)))[:landmarks // 2]
        common_ones = np.lexsort((np.arange(len(ratio)), -in_clean))
        rest = rng.permutation(common_ones[landmarks // 4:])[:landmarks - landmarks // 2 - landmarks // 4]
        kernel = Nystrom([vocabulary[i] for i in np.unique(np.concatenate([telling, common_ones[:landmarks // 4], rest]))])
        phi, owner = kernel.phi(vocabulary)
        w, self.bias = self._from_sentences(documents, y, phi, owner)
        clean = in_clean > 0
        clean_rows = np.flatnonzero(clean[owner])
        for step in range(rounds):
            value = np.full(len(vocabulary), -np.inf)
            np.maximum.at(value, owner, phi @ w.astype(np.float32) + np.float32(self.bias))
            # the word that each toxic document's worst sentence owes its label to
            witness = np.zeros(len(vocabulary))
            for bag, label in zip(some, y):
                if label and len(bag):
                    witness[bag[np.argmax(value[bag])]] += 1
            # what clean documents have as well speaks for neither
            weight = witness * (in_toxic / np.maximum(in_toxic + in_clean * y.sum() / max(1, len(y) - y.sum()), 1e-9)) ** 4
            steady = np.flatnonzero(weight >= max(3, 0.02 * y.sum()))
            chosen = np.flatnonzero(weight > 0)
            more = {}  # the frequent ones with a letter put in
            for i in steady.tolist():
                v = vocabulary[i]
                if v.isalpha():
                    at, letters = range(1, len(v)), rng.integers(0, 26, len(v))
                    more |= {v[:k] + chr(97 + letters[k]) + v[k:]: 0.1 * weight[i] / len(v) for k in at}
            mx, mown = kernel.phi(list(more)) if more else (phi[:0], np.empty(0, np.int64))
            pos = np.flatnonzero(np.isin(owner, chosen))
            pw, mw = weight[owner[pos]] ** 0.75, np.array([*more.values()])[mown] ** 0.75 if more else np.empty(0)
            nw = np.sqrt(in_clean[owner[clean_rows]])
            toxic_total = pw.sum() + mw.sum()
            w, self.bias = fit_svm([(phi, pos, 1.0, pw / toxic_total), (mx, np.arange(len(mx)), 1.0, mw / toxic_total), (phi, clean_rows, -1.0, nw / nw.sum())],
                                   np.r_[w, self.bias] if step else None)
        self.table[kernel.codes] = kernel.share @ w.astype(np.float32)
        self._calibrate(np.array([self._top({vocabulary[i] for i in bag})[0] for bag in some]), y)
        self.cache = {}

    def _from_sentences(self, documents, y, phi, owner) -> tuple[np.ndarray, float]:
        """A machine fitted on sentences as labelled, each the mean of its words; of either label SENTENCES at most, evenly spread."""
        first = np.searchsorted(owner, np.arange(int(owner.max()) + 2))
        parts = []
        for label in (1, 0):
            own = [s for d, t in zip(documents, y) if t == label for s in d if s]
            chosen = np.unique(np.linspace(0, len(own) - 1, min(len(own), SENTENCES)).astype(int))
            x = np.zeros((len(chosen), phi.shape[1]), np.float32)
            for row, k in zip(x, chosen):
                np.divide(phi[np.concatenate([np.arange(first[w], first[w + 1]) for w in own[k]])].sum(axis=0), len(own[k]), out=row)
            parts.append((x, np.arange(len(x)), 1.0 if label else -1.0, np.full(len(x), 1 / max(1, len(x)))))
        return fit_svm(parts)

    def _top(self, bag) -> tuple[float, str | None]:
        self._learn([w for w in bag if w not in self.cache])
        got = [(self.cache[w], w) for w in bag]
        return max(got, default=(self.bias, None))

    def _learn(self, new: list[str]) -> None:
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            part.sort(key=len)
            for b in range(0, len(part), 2_000):
                some = part[b:b + 2_000]
                rows, owner = encode(some)
                value = np.full(len(some), -np.inf)
                np.maximum.at(value, owner, weigh(rows, self.table) + self.bias)
                self.cache.update(zip(some, value.tolist()))

    def _calibrate(self, s: np.ndarray, y: np.ndarray) -> None:
        """Logistic slope of the documents' decision values, both labels of equal weight, and an offset by THRESHOLD."""
        target = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        a, b = 2.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            g = weight * (p - target)
            h = weight * np.maximum(p * (1 - p), 1e-9)
            m = np.array([[(h * s * s).sum() + 1e-6, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-9]])
            da, db = np.linalg.solve(m, [(g * s).sum() + 1e-6 * a, g.sum()])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        self.slope = max(float(a), 1e-3)
        # THRESHOLD falls where fewest documents are on the wrong side, a clean one counting COSTLY times; within the widest such gap
        order = np.argsort(s, kind="stable")
        v, t = s[order], y[order]
        missed = np.r_[0, np.cumsum(t == 1)] / y.sum()
        alarms = (1 - np.r_[0, np.cumsum(t == 0)] / (1 - y).sum()) * COSTLY
        low, high = np.r_[v[0] - 1, v], np.r_[v, v[-1] + 1]
        total = np.where(high > low, missed + alarms, np.inf)
        best = np.flatnonzero(total <= total.min() + 1e-12)
        k = best[np.argmax((high - low)[best])]
        self.offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - self.slope * (low[k] + high[k]) / 2)

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        bags = [words(t) for t in texts]
        new = set().union(*bags).difference(self.cache) if bags else set()
        self._learn(list(new))
        get = self.cache.__getitem__
        s = np.array([max(map(get, bag), default=self.bias) for bag in bags])
        return 1 / (1 + np.exp(-np.clip(self.slope * s + self.offset, -30, 30)))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    The machine is fitted on at most `most` labelled documents outside the
    held-out fold and broadcast (a table of SYMBOLS ** ORDER floats). All words
    of a text count. A text without words (null, empty) has the score of a
    word without subsequences. With labels of one kind alone, or none, all
    scores are close to 0, or to 1 if all are toxic.
    """
    rows = labelled.sample(docs, labels, "toxic", most)
    machine = StringKernelMachine([t for _, t, _ in rows], [y for _, _, y in rows])
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return labelled.scored(docs, lambda: sent.value.score, THRESHOLD)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
