"""Suffix arrays, line hashing, Order MinHash and the pivot index against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import common, lines, neardup, pivots, suffixes

DOCS = "doc_id bigint, text string, th int, key string, id int, spans int, n_chars bigint"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, None if t is None else len(t)) for i, t in rows], DOCS)


def text(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


def odd_rows(r):
    passage = text(r, 60)
    rows = [(10 + i, text(r, 40) + ("\n" + passage + "\n" if i % 3 == 0 else "\n") + text(r, 30)) for i in range(24)]
    rows += [(1, None), (2, ""), (3, "short"), (None, passage), (4, "ä" * 90 + "ß" * 90), (5, "x" + "ä" * 90 + "ß" * 90), (6, "z" * 700),
             (7, text(r, 6000)), (40, rows[0][1]), (40, rows[0][1]), (41, rows[1][1] + "!")]
    return rows


def covered(rows, length):
    """Bytes to remove of each distinct (id, text), in order of id and then of the hash that breaks ties."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w in seen:
                cov[k:k + length] = b"\1" * length
            seen.add(w)
        out[i] = (b, cov)
    return out


@pytest.mark.parametrize("group", [suffixes.GROUP, 2])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = odd_rows(random.Random(3))
    got = suffixes.remove_repeats(make(spark, rows)).collect()
    assert len(got) == len(rows)
    uniq = dict.fromkeys(rows)
    want = covered(sorted(uniq, key=lambda x: -1 << 63 if x[0] is None else x[0]), 100)
    for r in got:
        b, cov = want[r.doc_id]
        kept = bytes(x for x, c in zip(b, cov) if not c)
        assert bytes(r.kept) == kept and r.n_bytes == len(b)
        mark = bytearray(len(b))
        for s in r.spans:
            assert not any(mark[s.start:s.end])
            mark[s.start:s.end] = b"\1" * (s.end - s.start)
        assert mark == cov and len(r.spans) == sum(cov[k] and (k == 0 or not cov[k - 1]) for k in range(len(cov)))


def test_maximal_repeats():
    """All places of each repeat that can't be extended, against counting."""
    r = random.Random(1)
    for _ in range(60):
        t = bytes(r.choice(b"ab") for _ in range(r.randint(5, 40)))
        n = 3
        places = np.arange(len(t) - n + 1)
        arr = np.frombuffer(t, np.uint8)
        got = {(size, tuple(sorted(which.tolist()))) for size, which in suffixes.maximal_repeats(
            arr, places, np.full(len(places), len(t)), places == 0, n)}
        want = set()
        for size in range(n, len(t)):
            for s in {t[k:k + size] for k in range(len(t) - size + 1)}:
                at = [k for k in range(len(t) - size + 1) if t[k:k + size] == s]
                before = {t[k - 1] if k else -1 for k in at}
                after = {t[k + size] if k + size < len(t) else -1 for k in at}
                if len(at) > 1 and len(before) > 1 and (len(after) > 1):
                    want.add((size, tuple(at)))
        assert got == want


def test_whole_characters_stay():
    assert suffixes.whole_characters("aäb".encode(), [(0, 2)]) == "äb"
    assert suffixes.whole_characters("aäb".encode(), [(2, 4)]) == "aä"


def test_suffix_stage_keeps_columns(spark):
    rows = odd_rows(random.Random(4))
    docs = make(spark, rows)
    got = suffixes.dedup_documents(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].text is None and by[40].text == "" and by[40].n_chars == 0 and by[2].text == ""


def test_repeated_row_holds_a_string_first(spark):
    """A later document shares a passage with a row that is there twice: it goes from that document alone."""
    r = random.Random(21)
    passage = text(r, 60)
    first, later = f"{text(r, 40)} {passage} {text(r, 40)}", f"{text(r, 30)} {passage} {text(r, 50)}"
    rows = [(1, first), (1, first), (2, later), (None, "n"), (None, "n")]
    want = covered([rows[0], rows[2]], 100)
    for got in suffixes.remove_repeats(make(spark, rows)).where("doc_id > 0").collect():
        b, cov = want[got.doc_id]
        assert bytes(got.kept) == bytes(x for x, c in zip(b, cov) if not c)
    texts = sorted((x.doc_id, x.text) for x in suffixes.dedup_documents(make(spark, rows)).where("doc_id > 0").collect())
    assert texts[:2] == [(1, first)] * 2 and len(texts[2][1]) < len(later) - 100


@pytest.mark.parametrize("group", [suffixes.GROUP, 2])
def test_repeat_groups(spark, monkeypatch, group):
    """Each group has all places of its string and nothing else; they differ to the left; together they cover what occurs again."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = list(dict.fromkeys(x for x in odd_rows(random.Random(6)) if x[0] is not None and x[0] != 40)) + [(50, "q" + text(random.Random(6), 80)), (51, "r" + text(random.Random(6), 80))]
    texts = {i: (t or "").encode() for i, t in rows}
    got = {}
    for r in suffixes.repeat_groups(make(spark, rows)).collect():
        got.setdefault((r.repeat, r.size), set()).add((r.doc_id, r.start))
    mark = {i: bytearray(len(b)) for i, b in texts.items()}
    for (_, size), at in got.items():
        strings = {texts[d][s:s + size] for d, s in at}
        assert len(strings) == 1 and size >= 100 and len(at) > 1
        word = strings.pop()
        want = {(d, k) for d, b in texts.items() for k in range(len(b) - size + 1) if b[k:k + size] == word}
        assert at == want
        for d, s in sorted(at)[1:]:
            mark[d][s:s + size] = b"\1" * size
    want = covered(sorted(rows), 100)
    assert got and all(mark[i] == want[i][1] for i in texts)


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.remove_repeats(make(spark, []).limit(0)).count() == 0


def test_lines(spark):
    r = random.Random(2)
    unit = [text(r, 8) for _ in range(6)]
    rows = [(1, f"{unit[0]}\n{unit[1]}\n\n{unit[0]}"), (2, f" {unit[1].upper()}  \n{unit[2]}\nno"), (3, None), (4, ""), (5, f"{unit[2]}\n{unit[1]}\n{unit[3]}\nno"),
            (5, f"{unit[2]}\n{unit[1]}\n{unit[3]}\nno"), (None, unit[4]), (6, unit[4]), (7, "w " * 100_000)]
    got = {}
    for x in lines.dedup_units(make(spark, rows), min_words=5).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert got[1][0].text == f"{unit[0]}\n{unit[1]}\n\n" and [(s.start, s.end) for s in got[1][0].spans] == [(len(got[1][0].text), len(rows[0][1]))]
    assert got[2][0].text == f"{unit[2]}\nno" and got[3][0].text == "" and got[4][0].n_units == 1
    assert [x.text for x in got[5]] == [f"{unit[3]}\nno"] * 2 and [(s.start, s.end) for s in got[5][0].spans] == [(0, len(unit[2]) + len(unit[1]) + 2)]
    assert got[None][0].text == unit[4] and got[6][0].text == "" and got[7][0].n_removed == 0
    for x in (x for xs in got.values() for x in xs):
        whole = next(t or "" for i, t in rows if i == x.doc_id)
        left, at = "", 0
        for s in x.spans:
            left, at = left + whole[at:s.start], s.end
        assert left + whole[at:] == x.text


def test_passages_inside_lines(spark):
    r = random.Random(12)
    said = [text(r, 12).capitalize() + "." for _ in range(5)]
    passage = " ".join(said)
    rows = [(1, f"{text(r, 30)}. {passage} {text(r, 30)}."), (2, f"{text(r, 20)}. {passage} {text(r, 20)}.\nmore"), (3, passage), (4, f"{said[0]}\n{said[1]} {said[2]}")]
    got = {x.doc_id: x for x in lines.dedup_units(make(spark, rows), min_sentence=8).collect()}
    assert got[1].text == rows[0][1] and got[3].text == "" and got[4].text == ""
    assert got[2].text == rows[1][1].replace(passage + " ", "") and got[2].n_removed == 5 and len(got[2].spans) == 1


def test_passages_of_short_sentences(spark, tmp_path):
    """Short sentences go as a run if asked; short lines go, empty ones stay; the query takes lines alone."""
    r = random.Random(13)
    passage = " ".join(text(r, n).capitalize() + "." for n in (3, 5, 2, 7, 1, 4, 6, 5, 9, 7, 4))
    rows = [(1, f"{text(r, 30)}. {passage} {text(r, 30)}.\n\nno\n"), (2, f"{text(r, 20)}. {passage} {text(r, 20)}.\n\nNO \nmore\n")]
    docs = make(spark, rows)
    got = {x.doc_id: x.text for x in lines.dedup_units(docs, min_sentence=8).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1].replace(passage + " ", "").replace("NO \n", "")}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id: x.n_removed for x in lines.op10_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_lines_of_odd_letters_and_blanks(spark, tmp_path):
    """The query normalises as its SQL does: vertical tabs are no blanks, spaces of any width are trimmed, letters are lowered one by one."""
    odd = ["a b", "A \t B\r", "a\vb", "\v", " \v\n", "\u0130x", "i\u0307x", "ix", "\u039f\u03a3", "\u03bf\u03c2", "\u03bf\u03c3", "\u00a0", "\u00a0\u3000", "\u2003q\u00a0\nq", "q\u00a0q", "q q",
           "\f", "\x1c", "\x1c", "\x85\n\x85", "\0", "\0", None, "", "\n"]
    make(spark, list(enumerate(odd))).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(x) for x in lines.op10_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == duck.sql(lines.OP10_SQL).order("doc_id").fetchall()
    low = lines.dedup_units(make(spark, [(1, "One. Two."), (2, "Six. " + "\u00a0 " * 9), (3, "Ten. " + "\u00a0 " * 9)]), min_sentence=8)
    assert low.where("n_removed > 0").count() == 0


def test_runs_cover_repeats():
    r = random.Random(14)
    for _ in range(300):
        words = [r.randint(0, 5) for _ in range(r.randint(2, 14))]
        i, j = sorted(r.sample(range(len(words) + 1), 2))
        if sum(words[i:j]) >= 8 and sum(words[i:j]) < sum(words):
            own = [(a, b) for a, b in lines.runs(words, 8) if i <= a and b <= j]
            assert all(sum(words[a:b]) >= 8 for a, b in own)
            assert {k for k in range(i, j) if words[k]} <= {k for a, b in own for k in range(a, b)}


def test_paragraphs(spark):
    r = random.Random(9)
    a, b = text(r, 9), text(r, 9)
    got = {x.doc_id: x.text for x in lines.dedup_units(make(spark, [(1, f"{a}\n\n{b}"), (2, f"{b}\n \n{a}x")]), "paragraph").collect()}
    assert got == {1: f"{a}\n\n{b}", 2: f"{a}x"}
    assert lines.dedup_units(make(spark, []).limit(0)).count() == 0


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randint(0, r.choice([2, 5, 40])) for _ in range(r.randint(1, 25))]
        b = list(a)
        for _ in range(r.randint(0, 8)):
            i = r.randint(0, max(0, len(b) - 1))
            if r.random() < 0.3 and len(b) > 1:
                del b[i]
            elif r.random() < 0.5:
                b.insert(i, r.randint(0, 40))
            else:
                b[i] = r.randint(0, 40)
        most = r.randint(0, 12)
        assert neardup.distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(edit_distance(a, b), most + 1)


def test_order_counts():
    """Sketches tell texts of equal shingles in another order apart."""
    s = np.arange(1, 400, dtype=np.uint64)
    assert not set(neardup.sketch(s)) & set(neardup.sketch(s[::-1].copy()))
    assert (neardup.sketch(s) == neardup.sketch(s.copy())).all()


@pytest.mark.parametrize("block,crowded", [(neardup.BLOCK, neardup.CROWDED), (2, neardup.CROWDED), (neardup.BLOCK, 1)])
def test_near_duplicates(spark, monkeypatch, block, crowded):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CROWDED", crowded)
    r = random.Random(8)
    rows = []
    for k in range(12):
        base = text(r, r.choice([12, 60, 200])).split()
        for c in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0, 0.01, 0.02, 0.03]))):
                w[r.randrange(len(w))] = text(r, 1)
            rows.append((len(rows) + 100, " ".join(w)))
    rows += [(1, None), (2, ""), (3, "two words"), (4, "TWO  words"), (None, rows[0][1]), (5, rows[3][1]), (5, rows[3][1]), (6, text(r, 20_000))]
    got = neardup.near_duplicates(make(spark, rows)).collect()
    assert len(got) == len(rows)
    hashes = neardup.WordHashes()
    seqs = {i: neardup.shingles(t, hashes) for i, t in rows if i is not None}
    parent = {i: i for i in seqs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in seqs:
        for b in seqs:
            n = max(len(seqs[a]), len(seqs[b]))
            if a < b and abs(len(seqs[a]) - len(seqs[b])) <= 0.2 * n and edit_distance(seqs[a].tolist(), seqs[b].tolist()) <= 0.2 * n:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {i: root(i) for i in seqs}
    assert {x.doc_id: x.class_id for x in got if x.doc_id is not None} == want
    assert all(x.kept == (x.doc_id == x.class_id) for x in got if x.doc_id is not None)
    assert [x.class_id for x in got if x.doc_id is None] == [None]
    docs = make(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(set(want.values()))


def groups_of(rows):
    """Classes by aligning every pair of rows (id, text)."""
    hashes = neardup.WordHashes()
    seqs = {i: neardup.shingles(t, hashes) for i, t in rows}
    parent = {i: i for i in seqs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in seqs:
        for b in seqs:
            n = max(len(seqs[a]), len(seqs[b]))
            if a < b and abs(len(seqs[a]) - len(seqs[b])) <= 0.2 * n and neardup.distance(seqs[a], seqs[b], int(0.2 * n)) <= 0.2 * n:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in seqs}


def test_common_passage(spark, monkeypatch):
    """Very many short documents share a passage, and a few of them nearly all: they meet by what is rare among them."""
    monkeypatch.setattr(neardup, "CROWDED", 400)
    r = random.Random(31)
    passage, rows = text(r, 24), []
    for k in range(60):
        own = text(r, 14).split()
        rows.append((len(rows), f"{' '.join(own)} {passage}"))
        if k % 4 == 0:
            rows.append((len(rows), f"{' '.join(own[1:])} {passage} {text(r, 1)}"))
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(make(spark, rows)).collect()}
    assert got == groups_of(rows) and len(set(got.values())) < len(rows) - 10


@pytest.mark.parametrize("words", [(20, 34), (36, 60), (100, 300)])
def test_near_recall(words):
    """Pairs that differ by up to a fifth share a sketch, on both sides of the length where sketches change, and across it."""
    r = random.Random(words[0])
    hashes, met, total = neardup.WordHashes(), 0, 0
    for _ in range(250):
        own = text(r, r.randint(*words)).split()
        other = list(own)
        for _ in range(max(1, int(len(own) * 0.03))):
            other[r.randrange(len(own))] = text(r, 1)
        a, b = (neardup.shingles(" ".join(w), hashes) for w in (own, other))
        most = int(0.2 * max(len(a), len(b)))
        if 0 < neardup.distance(a, b, most) <= most:
            total += 1
            met += bool(set(neardup.sketch(a)) & set(neardup.sketch(b)))
    assert total > 40 and met >= 0.95 * total


def test_kept_rows_keep_their_columns(spark):
    """Maps have no order, and names may clash with one's own."""
    r = random.Random(3)
    a, b = text(r, 50), text(r, 50)
    docs = spark.createDataFrame([(1, a, {"x": 1}, 5), (1, b, {"y": 2}, 5), (2, a, {}, 5), (None, a, None, 5)],
                                 "doc_id bigint, text string, __id map<string,int>, id int")
    got = neardup.keep_one(docs).collect()
    assert [x for x in got[0].__fields__] == docs.columns and sorted(str(x.doc_id) for x in got) == ["1", "None"]
    cut = spark.createDataFrame([(1, a, 8, 9), (2, a, 8, 9)], "doc_id bigint, text string, __doc int, __th int")
    assert [(x["__doc"], x["__th"]) for x in suffixes.dedup_documents(cut).collect()] == [(8, 9)] * 2


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(make(spark, []).limit(0)).count() == 0


def test_connected(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    ids = sorted({x for e in edges for x in e} | {999})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = common.connected(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {x.id: x.component for x in got.collect()} == {i: root(i) for i in ids}


VECTORS = "vec_id bigint, embedding array<float>, label int, id int, x int"


@pytest.mark.parametrize("block,sample", [(pivots.BLOCK, pivots.SAMPLE), (8, pivots.SAMPLE), (8, 40), (pivots.BLOCK, 40)])
def test_pivot_index(spark, monkeypatch, block, sample):
    """Lists of shared pivots of few vectors, by a whole and a small sample; long lists by pairs of blocks."""
    monkeypatch.setattr(pivots, "SAMPLE", sample)
    monkeypatch.setattr(pivots, "PIVOTS", 16)
    g = np.random.default_rng(2)
    base = g.normal(size=(60, 24))
    rows = []
    for k in range(60):
        for c in range(1 + 9 * (k % 10 == 0)):
            rows.append(base[k] + g.normal(size=24) * 0.02 * c)
    some = [(i, v.astype(np.float32).tolist(), 0, 1, 1) for i, v in enumerate(rows)]
    rows = some + [(500, some[3][1], 1, 1, 1), (501, [2 * x for x in some[3][1]], 1, 1, 1), (502, None, 1, 1, 1), (503, [0.0] * 24, 1, 1, 1),
             (504, [float("nan")] + [1.0] * 23, 1, 1, 1), (505, [None] + [1.0] * 23, 1, 1, 1), (506, [1.0] * 7, 1, 1, 1), (507, [1.0] * 7, 1, 1, 1),
             (508, [], 1, 1, 1), (None, some[3][1], 1, 1, 1), (500, some[3][1], 1, 1, 1), (509, [1.0] * 7, 1, 1, 1), (509, some[40][1], 1, 1, 1)]
    rows += [(600 + k, [1.0] * (k + 1), 1, 1, 1) for k in range(300)]
    got = pivots.similar_vectors(spark.createDataFrame(rows, VECTORS), recall=0.9999, block=block, sketched=block).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, near = [0] * len(good), {}
    parent = {i: i for i, _ in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v) in enumerate(good):
        for b, (j, w) in enumerate(good):
            if a != b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[a] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = {}
    for (i, _), n in zip(good, links):
        want.setdefault(i, []).append((n, root(i)))
    have = {}
    for x in got:
        have.setdefault(x.vec_id, []).append((x.n_links, x.component_id))
    assert {i: sorted(v) for i, v in have.items() if i in want} == {i: sorted(v) for i, v in want.items()}
    for i in (502, 503, 504, 505, 508, None):
        assert have[i] == [(0, i)]


def anisotropic(g, n, d, mean_cosine):
    z = pivots.unit(g.normal(size=(n, d)))
    return pivots.unit(np.sqrt(mean_cosine) * pivots.unit(g.normal(size=(1, d))) + np.sqrt(1 - mean_cosine) * z)


@pytest.mark.parametrize("mean_cosine", [0, 0.3, 0.5, 0.75])
def test_pivot_recall(mean_cosine):
    """Of pairs right at the threshold, not in the sample, more than nine in ten share enough pivots; the estimate is near the truth."""
    g = np.random.default_rng(0)
    x = anisotropic(g, 9000, 64, mean_cosine)
    index = pivots.Index(x[:pivots.SAMPLE], 50_000, 64, 0.95, pivots.RECALL)
    z = x[pivots.SAMPLE:]
    n = g.normal(size=z.shape)
    n = pivots.unit(n - (n * z).sum(axis=1, keepdims=True) * z)
    a, b = index.keys(z, 64)[1], index.keys(0.95 * z + np.sqrt(1 - 0.95 ** 2) * n, 64)[1]
    met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean()
    assert met > 0.93 and abs(met - index.estimate) < 0.04


def test_pivot_links_against_all_pairs(spark):
    """Recall of whole runs on vectors with planted pairs around the threshold; and the exact mode finds all."""
    g = np.random.default_rng(4)
    x = anisotropic(g, 5000, 32, 0.4)
    for k in range(0, 2000, 2):
        c = g.uniform(0.94, 1)
        n = g.normal(size=32)
        n = pivots.unit((n - (n @ x[k]) * x[k])[None])[0]
        x[k + 1] = c * x[k] + np.sqrt(1 - c * c) * n
    rows = [(i, v.astype(np.float32).tolist(), 0, 1, 1) for i, v in enumerate(x)]
    y = np.array([r[1] for r in rows])
    want = ((y @ y.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1) >= 0.95).sum(axis=1) - 1).tolist()
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: r.n_links for r in pivots.similar_vectors(df).collect()}
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) > 0.95 * sum(want)
    assert [r.n_links for r in pivots.similar_vectors(df, exact=True).orderBy("vec_id").collect()] == want


def test_vectors_that_planes_miss(spark):
    """Near vectors on opposite sides of every plane of a known seed link, and so does the exact mode."""
    planes = np.random.default_rng(17).normal(size=(256, 128))
    g = np.random.default_rng(1)
    basis = np.linalg.svd(planes.T)[2][128:]
    null, side = pivots.unit(g.normal(size=(1, 128)) @ basis)[0], np.linalg.lstsq(planes.T, np.ones(128), rcond=None)[0]
    side = 0.01 * side / np.linalg.norm(side)
    assert np.array_equal((null + side) @ planes > 0, (null - side) @ planes <= 0)
    rows = [(k, v.tolist(), 0, 1, 1) for k, v in enumerate([null + side, null - side, *g.normal(size=(40, 256))])]
    df = spark.createDataFrame(rows, VECTORS)
    for exact in (False, True):
        got = {r.vec_id: r.n_links for r in pivots.similar_vectors(df, exact=exact).collect()}
        assert got == {k: int(k < 2) for k in range(42)}


def test_footrule():
    p, q = np.array([[4, 2, 7], [1, 2, 3], [1, 2, 3]]), np.array([[4, 2, 7], [3, 2, 1], [3, 8, 9]])
    both, apart = pivots.footrule(p, q)
    assert both.tolist() == [3, 3, 1] and apart.tolist() == [0, 4, 2 + (3 + 2) + (2 + 1)]


def test_given_vectors_use_the_index(spark, sf):
    """The given vectors have pivots. They have no near ones, so some are planted beside them: nearly all links are found, and all by the exact mode."""
    given = spark.read.parquet(f"{sf}/embeddings.parquet").where("size(embedding) > 0").orderBy("vec_id").collect()
    x, g = pivots.unit(np.array([r.embedding for r in given], float)), np.random.default_rng(8)
    off = g.normal(size=x.shape)
    off = pivots.unit(off - (off * x).sum(axis=1, keepdims=True) * x)
    c = g.uniform(0.94, 1, size=(len(x), 1))
    rows = [(r.vec_id, r.embedding, 0, 1, 1) for r in given]
    rows += [(10**6 + k, v.tolist(), 0, 1, 1) for k, v in enumerate(c * x + np.sqrt(1 - c * c) * off)]
    df = spark.createDataFrame(rows, VECTORS)
    one = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("dims", F.size("v"))
    index = [i for held in pivots._indexes(one, pivots.COSINE, pivots.RECALL) for i in held.values()]
    assert index and all(len(i.pivots) > 100 and i.prefix >= 4 and i.farthest > 0 for i in index)
    held = sorted((r.id, r.v) for r in one.collect())
    y = pivots.unit(np.array([v for _, v in held]))
    want = dict(zip([i for i, _ in held], ((y @ y.T >= 0.95).sum(axis=1) - 1).tolist()))
    got = {r.vec_id: r.n_links for r in pivots.similar_vectors(df).collect()}
    assert sum(want.values()) > len(x) and all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.97 * sum(want.values())
    assert {r.vec_id: r.n_links for r in pivots.similar_vectors(df, exact=True).collect()} == want


def test_vectors_of_nothing(spark):
    assert pivots.similar_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_kept_digest(spark):
    got = suffixes.remove_repeats(make(spark, [(1, "a")])).select(F.sha2("kept", 256)).first()[0]
    assert got == hashlib.sha256(b"a").hexdigest()
