"""Archives, packing, pieces, benchmark matching: round trips and brute force; and the pipeline with its entry."""

import base64
import gzip
import hashlib
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import common, decontam, packing, pieces, warc

PAGES = "page_id bigint, url string, html string, payload string, sha int, file string"


def test_archives(spark):
    nested = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n").decode("latin1")
    html = ["<p>a</p>", "", None, "<p>a</p>", "ü" * 3000, "x" * 400_000, "<p>a</p>", nested, "".join(random.Random(1).choice("ab\r\n ") for _ in range(9000))]
    rows = [(i, f"http://x/{i}\r\nbad", h, "p", 1, "f") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "p", 1, "f"), (3, "u", "<p>a</p>", "p", 1, "f")]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    files = warc.write_archives(pages, common.scratch(spark), file_bytes=4000)
    for split in (300, 1 << 20):
        got = warc.read_archives(files, split).collect()
        assert len(got) == len(rows) and all(r.intact for r in got)
        for r in got:
            payload = (next(h for i, _, h, *_ in rows if i == r.page_id) or "").encode()
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert (r.payload_bytes, r.payload_digest) == (len(payload), digest)
            same = [i for i, _, h, *_ in rows if i is not None and (h or "").encode() == payload]
            first = min(same)
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id in (None, first) else ("revisit", first))
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    assert warc.read_archives(warc.write_archives(pages.limit(0), common.scratch(spark))).count() == 0


def test_ranges_are_spread(spark, tmp_path):
    """The ranges of one file go to several tasks, also where adaptive plans merge small partitions."""
    (tmp_path / "x.warc.gz").write_bytes(b"".join(warc.encode_record(i, "u", random.Random(i).randbytes(3000), "D", None, False) for i in range(200)))
    got = warc.read_archives(warc.archive_files(spark, str(tmp_path)), 20_000)
    assert got.count() == 200 and got.select(F.spark_partition_id()).distinct().count() > 4


def test_truncated_archive(spark, tmp_path):
    a, b = (warc.encode_record(i, "u", b"body %d" % i, "D", None, False) for i in (1, 2))
    (tmp_path / "x.warc.gz").write_bytes(b"\x1f\x8b\x08junk" + a + b[:-9])
    files = warc.archive_files(spark, str(tmp_path))
    assert [r.page_id for r in warc.read_archives(files).collect()] == [1]  # what is whole
    (tmp_path / "x.warc.gz").write_bytes(a + b)
    assert sorted(r.page_id for r in warc.read_archives(warc.archive_files(spark, str(tmp_path)), 7).collect()) == [1, 2]


def test_best_fit():
    r = random.Random(4)
    for _ in range(150):
        sizes = [r.randint(1, 20) for _ in range(r.randint(0, 50))]
        bins = packing.best_fit_decreasing(sizes, 20)
        rooms = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [(room, k) for k, room in enumerate(rooms) if room >= sizes[i]]
            if fits:
                rooms[min(fits)[1]] -= sizes[i]
            else:
                rooms.append(20 - sizes[i])
        assert sorted(20 - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))


needs_vocab = pytest.mark.skipif(not os.path.exists(packing.RANKS), reason="no vocabulary files here")
DOCS = "doc_id bigint, text string, ids int, key int, n_chars bigint"


@needs_vocab
def test_packing_round_trip(spark, tmp_path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two", "", None, "word " * 5000, "é☃", "one two", "x" * 90_000]
    rows = [(i, t, 1, 1, 1) for i, t in enumerate(texts)] + [(0, "one two", 1, 1, 1), (None, "no id", 1, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    packed = packing.write_packed(packing.pack_documents(docs, 64, window_tokens=3000), str(tmp_path / "packed"))
    for r in packed.collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(pos) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert (pos[a:b] == np.arange(b - a)).all()
        assert (ids[r.n_tokens:] == 50256).all()
    whole = {}
    for s in packing.unpack(packed).collect():
        whole.setdefault(s.doc_id, []).append((s.start, s.n_doc_tokens, s.ids))
    for i, t in {(i, t) for i, t, *_ in rows if t}:
        want = enc.encode_ordinary(t)
        times = sum(1 for r in rows if r[0] == i)
        got = sorted(whole[i])
        assert sum(len(x[2]) for x in got) == len(want) * times
        assert [y for x in got[::times] for y in x[2]] == want
    assert set(whole) == {i for i, t, *_ in rows if t}
    assert packing.pack_documents(docs.limit(0)).count() == 0


@needs_vocab
def test_long_blank_runs(spark, tmp_path):
    """Blank runs that the pattern's engine gives up on; and the same ids as its own where it doesn't."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, packing.read_ranks(packing.RANKS).splitlines())}
    enc = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice(["a", " b", "12", "'s", ".", " ", "\n", "\t", "\u2003", "\x1c", " " * r.randint(2, 9), "\n" * r.randint(2, 9)]) for _ in range(r.randint(1, 20)))
        assert packing.token_ids(enc, t, 2) == enc.encode_ordinary(t), repr(t)
    texts = [" " * 5_000_000, "a" + "\n" * 2_000_000 + "b", "x \t" * 10 + " " * 1_500_000]
    packed = packing.write_packed(packing.pack_documents(spark.createDataFrame([(i, t, 1, 1, 1) for i, t in enumerate(texts)], DOCS)), str(tmp_path / "packed"))
    got = {}
    for s in packing.unpack(packed).collect():
        got.setdefault(s.doc_id, []).append((s.start, s.ids))
    assert {i: enc.decode([y for _, x in sorted(v) for y in x]) for i, v in got.items()} == dict(enumerate(texts))


@needs_vocab
def test_words_are_encoded_once(monkeypatch):
    """A slice's words go to the encoder once each; the ids are those of whole texts, whatever blanks they have."""
    import pyarrow as pa
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, packing.read_ranks(packing.RANKS).splitlines())}
    plain, enc = (tiktoken.Encoding("t", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (packing.PATTERN, packing.FAST_PATTERN))
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    width[list(ranks.values())] = [len(b) for b in ranks]
    r = random.Random(7)
    few = [" "] * 6 + ["a", "Bc", "\n", "\x1c", "\x00", "\u00e9", "\u6f22\u5b57", "7", "!", "'s", "'", "\U0001f600", "x" * 80]
    texts = ["", " ", "a", " a", "a ", "a b ", "a  b c", "a \n b"] + ["".join(r.choices(kind, k=r.randint(0, 30))) for kind in (few, [*few, "  ", "\t", "\x85", "\u3000", "\n \n"]) for _ in range(2000)]
    for some in (texts, texts[:1], []):
        assert [x.tolist() for x in packing.ids_of_texts(enc, width, "<u2", pa.array(some, pa.string()))] == [plain.encode_ordinary(t) for t in some]
    seen, real = [], packing.token_ids
    monkeypatch.setattr(packing, "token_ids", lambda enc, t, *a: seen.append(len(t)) or real(enc, t, *a))
    packing.ids_of_texts(enc, width, "<u2", pa.array(["some words come again and again " * 500] * 9))
    assert sum(seen) < 300
    parts = packing.by_bytes(pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 0, 9, 30, 1, 1)])], names=["t"]), 0, 8)
    assert [p.column(0).to_pylist() for p in parts] == [["aaa", ""], ["a" * 9], ["a" * 30, "a", "a"]]


@needs_vocab
def test_long_words(spark):
    """A megabyte without blanks, and the one-word search against the one in step."""
    tok = pieces.load()
    r = random.Random(6)
    some = ["".join(r.choice(["ram", "ique", "tion", "ñ", "☃", "日", "▁", "le", "x"]) for _ in range(r.randint(1, 60))).encode() for _ in range(300)]
    ids, ends = tok._paths(some)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tok._path(w) for w in some]
    text = "".join(r.choice("abcdefghijklmnopqrst☃") for _ in range(1_000_000))
    began = time.perf_counter()
    ids = tok.encode_batch([text])[0]
    assert time.perf_counter() - began < 10 and tok.decode(ids) == text


def best_path(tok, text):
    """Ids by plain dynamic programming over the whole text in double precision."""
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    vocab = {p: i for i, (p, _, t) in enumerate(tok.vocab) if t in (pieces.NORMAL, pieces.USER)}
    best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 16) + 1):
            k = vocab.get(s[i:j])
            if k is not None and best[i] + float(tok.score[k]) > best[j]:
                best[j], back[j] = best[i] + float(tok.score[k]), (i, [k])
        if s[i] not in vocab and best[i] + float(tok.unk_score) > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + float(tok.unk_score), (i, [tok.byte_id[b] for b in s[i].encode()])
    out, j = [], len(s)
    while j:
        i, ids = back[j]
        out, j = ids + out, i
    return out


@needs_vocab
def test_pieces(spark):
    tok = pieces.load()
    r = random.Random(5)
    texts = ["", "a", "  two  spaces ", "\n\n x", "héllo ☃ 😀", "日本語", " a", "a ", "x" * 700, "tab\tand\r\n", "the then there"]
    texts += [" ".join(r.choice(["an", "the", "er", "ingtion", "ñé", "\n", "12", "▁x"[1:]]) * r.randint(1, 3) for _ in range(r.randint(1, 30))) for _ in range(60)]
    for t, ids in zip(texts, tok.encode_batch(texts)):
        assert ids == best_path(tok, t) and tok.decode(ids) == t, repr(t)
    rows = [(i, t, 1, 1, 1) for i, t in enumerate(texts)] + [(None, None, 1, 1, 1), (0, "", 1, 1, 1), (99, "w " * 100_000, 1, 1, 1)]
    got = pieces.encode_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(x.round_trip for x in got)
    assert pieces.encode_documents(spark.createDataFrame([], DOCS)).count() == 0


@needs_vocab
def test_pieces_beside_very_low_scores():
    """The model's lowest score is -1e9, as an unknown character's is; what follows one is still told apart."""
    tok = pieces.load()
    r = random.Random(8)
    words = ["ñramique", "☃tionables", "▁ramique", "☃☃☃ramique" * 3, "日本語の文章がつづく" * 40, "ñ" * 3000 + "ramique"]
    words += [r.choice(["ñ", "☃", "▁", "日本", "😀"]) * r.randint(1, 3) + "".join(r.choice(["ram", "ique", "tion", "es", "ab", "le", "wh", "or"]) for _ in range(r.randint(1, 5)))
              for _ in range(400)]
    for w, ids in zip(words, tok.encode_batch(words)):
        assert ids == best_path(tok, w), w[:40]


@needs_vocab
def test_pieces_as_the_library_scores_them():
    """On single words the library, told that the model is a Unigram one, agrees."""
    import sentencepiece

    tok = pieces.load()
    raw, out = open(pieces.MODEL, "rb").read(), b""

    def varint(v):
        b = b""
        while v > 127:
            b, v = b + bytes([v & 127 | 128]), v >> 7
        return b + bytes([v])

    for n, v in pieces._fields(raw):
        v = v + varint(3 << 3) + varint(1) if n == 2 else v
        out += varint(n << 3 | 2) + varint(len(v)) + v
    lib = sentencepiece.SentencePieceProcessor(model_proto=out)
    words = ["the", "Onatorsh", "straße", "x1y2", "tionables", "reéchan"]
    score = lambda ids: sum(float(tok.score[i]) for i in ids)
    for w, ids in zip(words, tok.encode_batch(words)):
        assert score(ids) >= score(lib.encode(w)) - 1e-3


def part_distance(p, t):
    """Least edits that turn p into a part of t."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        nxt = [i]
        for j, y in enumerate(t, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return min(row)


def test_decontamination(spark):
    r = random.Random(7)
    make = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))
    items = [(i, make(20), 1) for i in range(6)] + [(10, None, 1), (11, "", 1), (12, "short one", 1), (13, "X" * 60, 1)]
    docs = []
    for k in range(40):
        body = make(30)
        if k % 2:
            leak = list(items[k % 6][1])
            for _ in range(r.randint(0, 7)):
                leak[r.randrange(len(leak))] = r.choice(["", "z", "qq"])
            body += " " + "".join(leak).upper().replace(" ", "  \n") + " " + make(20)
        docs.append((k, body, 1, 1, 1))
    docs += [(60, "so a Short  one, here", 1, 1, 1), (61, "a short ones", 1, 1, 1), (62, "xshort one", 1, 1, 1), (63, "short one", 1, 1, 1)]
    docs += [(50, None, 1, 1, 1), (51, "", 1, 1, 1), (None, items[0][1], 1, 1, 1), (52, items[1][1] + make(40_000) + items[2][1], 1, 1, 1), (7, docs[7][1], 1, 1, 1)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string, doc_id int")
    got = sorted(((x.doc_id if x.doc_id is not None else -1), x.item_id, x.distance) for x in decontam.match_items(d, b).collect())
    want = []
    for i, t, *_ in docs:
        t = decontam.normal(t)
        for j, p, _ in items:
            p = decontam.normal(p)
            if p and len(p) < 40:
                if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", t):
                    want.append((i if i is not None else -1, j, 0))
            elif p and (len(t) < 10_000 or p in t):
                e = part_distance(p, t) if len(t) < 10_000 else 0
                if e <= decontam.budget(len(p), 0.05):
                    want.append((i if i is not None else -1, j, e))
    assert got == sorted(want) and len(got) > 15
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {w[0] for w in want}
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, *_ in docs if i is not None and i not in bad)
    assert decontam.match_items(d, b.limit(0)).count() == 0 and decontam.match_items(d.limit(0), b).count() == 0


def test_many_items_take_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    sent = []
    real = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or real(x))
    items = [(i, " ".join(f"{i}w{k}" for k in range(20)), 1) for i in range(5)]
    d = spark.createDataFrame([(i, "so " + t, 1, 1, 1) for i, t, _ in items], DOCS)
    b = spark.createDataFrame(items, "item_id bigint, text string, doc_id int")
    assert sorted((x.doc_id, x.item_id) for x in decontam.match_items(d, b).collect()) == [(i, i) for i in range(5)]
    assert len(sent) > 3 and sorted(i for x in sent for i, _ in x) == list(range(5))
    assert decontam.drop_contaminated(d, b).count() == 0


@needs_vocab
def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = common.table(spark, sf, "documents")
    counts = [docs.count()]
    for name, stage in p.STAGES:
        out = common.settle(stage(spark, docs, sf))
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.where("NOT round_trip").count() == 0
    whole = p.run(spark, sf)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    empty = common.table(spark, sf, "documents").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0


def least_part_distance(p, t):
    """part_distance, a row of the table at a time."""
    t = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    row, at = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(p, 1):
        new = np.minimum(row + 1, np.r_[i, row[:-1] + (t != ord(c))])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


@needs_vocab
def test_pipeline_by_hand(spark, tmp_path):
    """Every stage's decisions against plain loops over all documents."""
    import corpus_pipeline as p
    from test_dedup import covered, groups_of

    from graphlens.llm import labelled, quality, suffixes

    r = random.Random(17)
    prose = lambda n: " ".join("".join(r.choice(["an", "the", "er", "ing", "tion", "es", "ß", "ñé"]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."
    passage, items = prose(40), [(k, prose(25)) for k in range(3)]
    rows = [[k, prose(r.randint(40, 90))] for k in range(90)]
    for k in range(0, 90, 9):
        rows[k][1] = " ".join(w + "$$$" for w in rows[k][1].split())
    for k in range(1, 90, 11):
        rows[k][1] += " " + passage + " " + prose(12)
    for k in range(5, 90, 20):
        words = rows[k - 1][1].split()
        words[7] = "changed"
        rows[k][1] = " ".join(words)
    for k in range(7, 90, 30):
        rows[k][1] += " " + items[k % 3][1].replace("t", "z", 1).upper()
    rows += [[200, ""], [201, None], [202, "x"], [None, prose(50)]]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = [(i, t, "xx", "s", None if t is None else len(t)) for i, t in rows]
    labels = [(k, int(k % 9 != 0), 0) for k in range(0, 90) if k % 4]
    for name, data, schema in (("documents", full, kinds), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {x.doc_id: x for x in p.run(spark, str(tmp_path)).collect()}

    docs = common.table(spark, str(tmp_path), "documents")
    known = labelled.sample(docs, common.table(spark, str(tmp_path), "labels"), "quality", quality.LABELLED)
    model = quality.LatentVotes([t for _, t, _ in known], [y for _, _, y in known])
    left = [(i, t) for i, t in rows if model.score([t or ""])[0] >= 0.5]
    assert 0 < len(rows) - len(left) < 30
    groups = groups_of([(i, t or "") for i, t in left if i is not None])
    left = [(i, t) for i, t in left if i is None or groups[i] == i]
    gone = covered(sorted(((i, t) for i, t in left), key=lambda x: -1 << 63 if x[0] is None else x[0]), 100)

    def spans(cover):
        edges = [k for k in range(len(cover) + 1) if (k < len(cover) and cover[k]) != (k > 0 and cover[k - 1])]
        return list(zip(edges[::2], edges[1::2]))

    left = [(i, t if not spans(gone[i][1]) else suffixes.whole_characters(gone[i][0], spans(gone[i][1]))) for i, t in left]
    clean = lambda t: all(least_part_distance(decontam.normal(q), decontam.normal(t)) > int(len(decontam.normal(q)) * 0.05) for _, q in items)
    left = [(i, t) for i, t in left if clean(t or "")]
    tok = pieces.load()
    assert set(got) == {i for i, _ in left} and any(sum(gone[i][1]) for i, _ in left)
    for i, t in left:
        assert got[i].ids == best_path(tok, t or "") and got[i].round_trip


def test_entry_registers_all():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
