"""The two classifiers: held-out accuracy on made-up labels, folds, and odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphlens.llm import labelled, quality, toxicity

SYLLABLES = ["an", "the", "er", "ing", "tion", "es", "or", "ble", "wh", "st", "ha", "nd", "re", "ly"]
INSULTS = ["grobble", "snarfik", "zonkwit"]
ODD = "doc_id bigint, text string, y int, score int, held_out int, key int"


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def corpus(n, seed=5):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [word(r) for _ in range(r.randint(20, 80))]
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.6)
        if toxic:
            for _ in range(2):
                words[r.randrange(len(words))] = r.choice(INSULTS) + r.choice(["", "", "es", "."])
        text = " ".join(words).capitalize() + "."
        if not good:
            text = " ".join(w + "$$$" for w in words) if r.random() < 0.5 else " ".join([words[0]] * 40)
            text += " ".join(w for w in words if toxic and any(w.startswith(x) for x in INSULTS))
        docs.append((i, text, 1, 1, 1, 1))
        labels.append((i, good, toxic, 7))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(900)
    return (spark.createDataFrame(docs, ODD), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text int"),
            {i: (q, t) for i, q, t, _ in labels})


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_held_out_accuracy(tables, what):
    docs, labels, truth = tables
    got = (quality.score_quality if what == "quality" else toxicity.score_toxicity)(docs, labels).collect()
    assert len(got) == 900
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = sum(r.predicted == truth[r.doc_id][what == "toxic"] for r in out) / len(out)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_gapped_insults(tables):
    docs, labels, _ = tables
    rows = labelled.sample(docs, labels, "toxic", 4096)
    m = toxicity.StringKernelMachine([t for _, t, _ in rows], [y for _, _, y in rows])
    for text in ("you gro-bble", "g.r.o.b.b.l.e", "such a g r o b b l e here", "SNARFIK!", "zonk_wit"):
        assert m.score([text])[0] > 0.7, text
    assert m.score(["the bleing restion"])[0] < 0.5


def test_kernel_is_the_table(tables):
    """The look-up equals the sum over gapped subsequences, counted one by one."""
    from itertools import combinations

    import numpy as np

    table = np.random.default_rng(0).normal(size=toxicity.SYMBOLS ** toxicity.ORDER).astype(np.float32)
    table[0] = 0
    for w in ("a", "abc", "idiotic"):
        rows, _ = toxicity.encode([w])
        s, want = rows[0], 0.0
        for at in combinations(range(len(s)), toxicity.ORDER):
            span = at[-1] - at[0] + 1
            if span <= toxicity.SPAN and all(s[i] for i in at):
                code = 0
                for i in at:
                    code = code * toxicity.SYMBOLS + int(s[i])
                want += toxicity.DECAY ** (span - toxicity.ORDER) * float(table[code])
        assert abs(toxicity.weigh(rows, table)[0] - want) < 1e-3


def kernel(a, b):
    """The kernel of two words, by listing all their gapped subsequences."""
    from itertools import combinations

    def subsequences(w):
        s, out = [int(x) for x in toxicity.encode([w])[0][0]], {}
        for at in combinations(range(len(s)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN and all(s[i] for i in at):
                key = tuple(s[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER)
        return out

    x, y = subsequences(a), subsequences(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_nystrom_is_the_kernel():
    """Products of features are the whole kernel's values wherever a landmark takes part."""
    marks = ["idiot", "stupid", "grobble", "restion", "an", "zonkwit", "the"]
    n = toxicity.Nystrom(marks)
    others = ["idiiot", "grobles", "zzz", "Xy", "stup1d", "thereabout"]
    at, _ = n.phi(marks)
    for w, x in zip(marks + others, n.phi(marks + others)[0]):
        for m, y in zip(marks, at):
            assert abs(float(x @ y) - kernel(w, m)) < 1e-2, (w, m)


def test_svm_is_the_least_loss():
    """No step in any direction lowers the squared hinge loss that is minimised."""
    import numpy as np

    g = np.random.default_rng(3)
    x = g.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * g.normal(size=300) > 0, 1.0, -1.0)
    weight = g.uniform(0.5, 1.5, 300)
    parts = [(x, np.flatnonzero(y == side), side, weight[y == side]) for side in (1.0, -1.0)]
    w, b = toxicity.fit_svm(parts, rounds=60)

    def loss(w, b):
        return (weight / weight.sum() * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + 1e-3 * w @ w

    for _ in range(50):
        assert loss(w, b) <= loss(w + 1e-2 * g.normal(size=5), b + 1e-2 * g.normal()) + 1e-7


def test_scores_by_hand(tables):
    """A document's score from the kernel machine's expansion over all gapped subsequences, listed one by one, of its worst word."""
    import math
    from itertools import combinations

    import numpy as np

    docs, labels, _ = tables
    rows = labelled.sample(docs, labels, "toxic", 300)
    m = toxicity.StringKernelMachine([t for _, t, _ in rows], [y for _, _, y in rows], 64, 2)

    def decision(w):
        got = []
        for s in toxicity.encode([w])[0].tolist():
            value = m.bias
            for at in combinations(range(len(s)), toxicity.ORDER):
                if at[-1] - at[0] < toxicity.SPAN and all(s[i] for i in at):
                    code = 0
                    for i in at:
                        code = code * toxicity.SYMBOLS + s[i]
                    value += toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER) * float(m.table[code])
            got.append(value)
        return max(got)

    texts = [r.text for r in docs.limit(12).collect()] + ["grobbble", "the ing", "a-b c", "x" * 60]
    for t, got in zip(texts, m.score(texts)):
        worst = max(map(decision, toxicity.words(t)))
        want = 1 / (1 + math.exp(-np.clip(m.slope * worst + m.offset, -30, 30)))
        assert abs(want - got) < 1e-3


def test_sentences():
    assert toxicity.sentences("One two. g.r.o.b is here! \nNext line\n\n end?") == ["One two.", "g.r.o.b is here!", "Next line", " end?"]


def test_votes_by_hand():
    """Scores are those of all labelled vectors' cosines, sorted one by one; words count, not only kinds of characters."""
    import numpy as np

    docs, labels = corpus(150, seed=9)
    texts, y = [d[1] for d in docs[:100]], [g for _, g, _, _ in labels[:100]]
    m = quality.LatentVotes(texts, y, latent=20, voters=7)
    rows = []
    for t in texts + [d[1] for d in docs[100:]]:
        x = np.zeros(quality.TERMS, np.float32)
        quality.counts(t, quality.WordColumns(), x)
        x = np.log1p(x) * m.idf
        start = 0
        for k, end in enumerate(quality.FAMILIES):
            x[start:end] *= (1 if k == 0 else quality.BESIDE) / max(np.linalg.norm(x[start:end]), 1e-12)
            start = end
        rows.append(x @ m.axes)
    for t, z, got in zip(docs[100:], rows[100:], m.score([d[1] for d in docs[100:]])):
        near = sorted(((float(z @ r / np.linalg.norm(z) / np.linalg.norm(r)), k) for k, r in enumerate(rows[:100])), reverse=True)[:7]
        want = sum(max(c, 0) * y[k] for c, k in near) / sum(max(c, 0) for c, _ in near)
        assert abs(want - got) < 0.02
    a, b = np.zeros(quality.TERMS, np.float32), np.zeros(quality.TERMS, np.float32)
    quality.counts("some words here", quality.WordColumns(), a)
    quality.counts("many other text", quality.WordColumns(), b)
    assert not (a == b).all()


def test_singular_vectors():
    import numpy as np

    x = (np.random.default_rng(4).normal(size=(60, 8)) @ np.random.default_rng(5).normal(size=(8, 40)) * np.linspace(1, 3, 40)).astype(np.float32)
    v = quality.singular(x, 5)
    _, _, want = np.linalg.svd(x)
    assert np.allclose(np.abs(v.T @ want[:5].T), np.eye(5), atol=1e-2)


def test_labels_of_the_held_out_fold_are_not_seen(tables):
    docs, labels, _ = tables
    seen = {r[0] for r in labelled.sample(docs, labels, "toxic", 200)}
    assert len(seen) == 200 and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in seen)
    flipped = labels.withColumn("toxic", F.when(labelled.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert labelled.sample(docs, flipped, "toxic", 200) == labelled.sample(docs, labels, "toxic", 200)


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, tables, run):
    _, labels, _ = tables
    odd = spark.createDataFrame([(None, "x", 1, 1, 1, 1), (1, None, 1, 1, 1, 1), (2, "", 1, 1, 1, 1), (3, "word " * 60_000, 1, 1, 1, 1),
                                 (3, "word " * 60_000, 1, 1, 1, 1), (4, "y" * 300_000, 1, 1, 1, 1), (5, "\U0001f600 ÄÖ", 1, 1, 1, 1)], ODD)
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1, 1), (5, None, None, 1)], labels.schema))
    got = run(odd, more).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    for none in (labels.limit(0), labels.where("quality = 1 AND toxic = 0")):
        assert run(odd, none).count() == 7
    assert run(odd.limit(0), labels).count() == 0


def test_rejected_rows_go(tables):
    docs, labels, truth = tables
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns
    share = [truth[r.doc_id][0] for r in kept.collect()]
    assert len(share) > 400 and sum(share) / len(share) > 0.97
