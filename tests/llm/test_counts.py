"""Conversation trie, quality rules and source divergence against SQL in another engine and plain loops, odd rows included."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import rules, tries, turns

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from test_queries import rows  # noqa: E402


def agree(got, sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        pdf = df.toPandas()
        c.register(f"{name}_", pdf)
        kinds = {"bigint": "BIGINT", "int": "INT", "string": "VARCHAR"}
        c.execute(f"create table {name} as select " + ", ".join(f'CAST("{n}" AS {kinds[k]}) AS "{n}"' for n, k in df.dtypes) + f" from {name}_")
    want, have = c.sql(sql).df(), got.toPandas()
    assert sorted(want.columns) == sorted(have.columns)
    assert rows(have) == rows(want)
    return have


TURNS = "conv_id bigint, turn bigint, role string, text string, k1 bigint, depth string, chain int"


def talk(spark, data):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in data], TURNS)


def odd_talk(r):
    data = []
    for c in [*range(0, 90), 400, 405, -7, -20, 10**12 + 3]:
        for t in range(r.randint(1, 6)):
            data.append((c, t, r.choice(["user", "assistant"]), " ".join(r.choice("ab") for _ in range(r.randint(0, 3)))))
    data += [(3, None, None, "first"), (5, 2, "user", None), (5, 2, "user", "tie"), (6, 1, "", " x \x0b y"), (6, 1, "", " x \x0b y"), (None, 1, "user", "lost")]
    data += [(1000 + k, 0, "user", "same start") for k in range(60)] + [(1000 + k, 1, "user", f"{k % 7}") for k in range(0, 60, 2)]
    return data


def test_trie_against_sql(spark):
    df = talk(spark, odd_talk(random.Random(5)))
    got = agree(turns.prefix_trie(df), turns.OP11_SQL, conversations=df.select("conv_id", "turn", "role", "text"))
    assert (got.depth == 0).sum() == 1


def test_trie_by_hand(spark):
    """Rebuilt conversations and their prefixes by loops."""
    data = odd_talk(random.Random(6))
    by = defaultdict(list)
    for c, t, role, text in data:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    seqs = {}
    for c, own in by.items():
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 4
        base = by.get(c - int(np.fmod(c, 20)), [])
        seqs[c] = tuple(base[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1] if s else ""))
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += own
    want = sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), kids[s], leaves[s], saved[s],
                   hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items())
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                 for r in turns.prefix_trie(talk(spark, data)).collect())
    assert got == want


def test_deep_and_wide_trie(spark, monkeypatch):
    """A conversation of 400 turns takes no more rounds than a short one; many ends of one node are hashed in order."""
    deep = [(40 * k, t, "u", "same" if t < 300 + k else f"{k} {t}") for k in range(5) for t in range(400)]
    wide = [(20 * k + 1, 0, "u", "hi there") for k in range(700)]
    rounds = []
    settle = turns.common.settle
    monkeypatch.setattr(turns.common, "settle", lambda df: rounds.append(1) or settle(df))
    df = talk(spark, deep + wide)
    agree(turns.prefix_trie(df), turns.OP11_SQL, conversations=df.select("conv_id", "turn", "role", "text"))
    assert len(rounds) < 25


def test_empty_trie(spark):
    assert turns.prefix_trie(talk(spark, []).limit(0)).collect() == []


DOCS = "doc_id bigint, text string, lang string, source string, words int, buckets int, fits string"
LABELS = "doc_id bigint, quality int, toxic int"


def odd_docs(r):
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = [(i, text(r.randint(3, 40)) + r.choice(["", "\n" + text(4) + "\n", " #$% & <x>"]), r.choice(["en", "de"]), r.choice(["a", "b", "c"])) for i in range(160)]
    rep = text(7)
    out += [(300, None, "en", "a"), (301, "", None, None), (302, " \t\n\x0b\x0c\r ", "fr", "z"), (303, f"{rep} {rep} {rep}", "en", "a"), (304, "one", "en", "b"), (304, "one", "en", "b"),
            (None, text(20), "en", ""), (305, "x\n\nx\n x\nx", "en", "a"), (306, text(4000), "en", "c"), (307, "ÄÖ äö A_b c1d", "de", "b"), (308, "a a a a a a a a a a a a", "de", "a")]
    return out


def documents(spark, data):
    return spark.createDataFrame([(*r, 1, 2, "y") for r in data], DOCS)


def labels(spark, r):
    return spark.createDataFrame([(i, r.choice([0, 1, 1, 1]), 0) for i in range(0, 160)] + [(None, 1, 0), (5, None, 0), (7, 0, 1), (7, 1, 0)], LABELS)


def test_rules_against_sql(spark):
    r = random.Random(8)
    docs, lab = documents(spark, odd_docs(r)), labels(spark, r)
    got = agree(rules.judge(docs, lab), rules.OP12_SQL, documents=docs, labels=lab)
    assert 0.2 < got.kept.mean() < 1


def test_repeated_words_by_hand(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 4, 5, 6, 9, 30, 200)] + ["a b c d e f a b c d e", "q " * 12]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {x.doc_id: x.n_repeat_words for x in rules.judge(docs, spark.createDataFrame([], LABELS)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        c = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        assert got[i] == len({p for k in range(len(w) - 4) if c[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)})


def test_rules_without_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert rules.judge(documents(spark, []).limit(0), none).collect() == []
    docs = documents(spark, odd_docs(random.Random(8)))
    assert rules.judge(docs, none).where("kept = base_failed").count() == 0


@pytest.mark.parametrize("least, limits", [(2, {}), (10, {"hot_leaves": 40, "counted_most": 50, "leaves_most": 50, "block_terms": 16})])
def test_divergence_against_sql(spark, least, limits):
    """Also with prefixes that are cut deeper, and tries that are given on early."""
    docs = documents(spark, odd_docs(random.Random(11))).repartition(5)
    sql = tries.OP13_SQL.replace(f">= {tries.LEAST_DOCS})", f">= {least})")
    got = agree(tries.divergences(docs, least, **limits), sql, documents=docs.select("doc_id", "text", "lang", "source"))
    assert {"pair", "term"} == set(got.part)


def test_divergence_without_rows(spark):
    assert tries.divergences(documents(spark, []).limit(0)).collect() == []
    got = tries.divergences(documents(spark, [(1, None, "en", "a"), (2, "", "en", "b"), (3, "w", None, None)])).collect()
    assert sorted((r.lang, r.source, r.item, r.value, r["rank"]) for r in got) == [("en", "a", "b", 0, 1), ("en", "b", "a", 0, 1)]


def test_radix_trie():
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))).encode() for _ in range(500)] + [b"x" * k for k in range(1, 3000, 7)]
    trie = tries.RadixTrie()
    for w in words:
        node = trie.leaf(w)
        node.counts["s"] = node.counts.get("s", 0) + 1
    c = Counter(words)
    walked = [(t, n.counts["s"]) for _, t, n in trie.walk()]
    assert walked == sorted(c.items()) and trie.leaves == len(c)


def test_probabilities_beyond_64_bits():
    count = np.array([0, 9_000_000_001, 10**13], np.int64)
    total, v = 3 * 10**13, 1000
    assert tries.probability(count, total, v).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * v) for c in count]


def test_all_trusted_documents_count(spark):
    """Not only the first 16,384: words of the trusted weigh more the more of them have it."""
    n = 60_000
    docs = spark.range(n).selectExpr("id AS doc_id", "'one two three four five six seven eight nine ten' AS text")
    lab = docs.selectExpr("doc_id", "1 AS quality")
    trusted = rules.trusted_ids(lab)
    want = {i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1}
    fits = {i for i in want if zlib.crc32(f"t{i}".encode()) % rules.APART > 0}
    assert trusted.count() == len(want) > rules.TRUSTED and {r.doc_id for r in trusted.where("fits").collect()} == fits
    assert rules.weights(docs, trusted).agg(F.sum("target")).first()[0] == 19 * len(fits)
    assert rules.judge(docs, lab).where("kept").count() == n


def test_tries_are_given_on_by_what_sources_hold_and_in_bounded_pieces(monkeypatch):
    """Few terms of very many sources fill a task as many terms do."""
    import pyarrow as pa

    from graphlens.llm import tries

    monkeypatch.setattr(tries, "GIVEN", 8)
    words = b"aaa bbb ccc ddd eee fff ggg hhh iii jjj"
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array([f"s{k}-{b}" for k in range(50)]), pa.array([words] * 50, pa.binary())], names=["lang", "source", "text"]) for b in range(4)]
    out = list(tries._count(200, 100)(iter(batches)))
    leaves = [sum(b.column(2).to_pylist()) for b in out]
    assert len(leaves) > 8 and max(leaves) <= 8 and sum(sum(x) for b in out for x in b.column(9).to_pylist()) == 2000
    assert sum(sum(x) for b in out for x in b.column(6).to_pylist()) == 2000  # documents of terms
