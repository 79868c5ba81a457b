"""A followed source tree, a postings index, rings of a stream, and components and levels of long chains."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from graphlens.operators import algo, postings, search
from graphlens.sources import python_code, readers, tree
from graphlens.streaming import rings, telemetry


def names(df):
    return {(r.path, r.name) for r in df.where("kind = 'function'").collect()}


def test_tree_follows(spark, tmp_path):
    """Edits, additions, deletions and edits that time and size don't show give the facts of a fresh parse; only changed files are parsed."""
    src, table = tmp_path / "src", str(tmp_path / "facts")
    folder = f"file://{src}"

    def put(path, text):
        (src / path).parent.mkdir(parents=True, exist_ok=True)
        (src / path).write_text(text)

    def refreshed():
        r = tree.refresh(spark, folder, table, python_code.parse, python_code.FACTS)
        fresh = python_code.parse(readers.source_tree(spark, folder))
        have = tree.current(spark, table, python_code.FACTS)
        assert sorted(map(str, have.collect())) == sorted(map(str, fresh.collect()))
        return tuple(r)

    src.mkdir()
    assert refreshed() == (0, 0, 0, 0)
    for k in range(6):
        put(f"a/m{k}.py", f"def f{k}():\n    pass\n")
    put("node_modules/x.py", "def no(): pass\n")
    put("a/[odd] name.py", "def odd(): pass\n")
    old = time.time() - 100
    for p in src.rglob("*.py"):
        os.utime(p, (old, old))
    assert refreshed() == (7, 7, 7, 0)
    assert refreshed() == (7, 0, 0, 0)
    put("a/m1.py", "def g1():\n    pass\n")  # young: read again next time
    assert refreshed() == (7, 1, 1, 0)
    seen = (src / "a/m1.py").stat()
    put("a/m1.py", "def h1():\n    pass\n")
    os.utime(src / "a/m1.py", ns=(seen.st_atime_ns, seen.st_mtime_ns))  # same time, same size
    assert refreshed() == (7, 1, 1, 0)
    os.utime(src / "a/m1.py", (old, old))
    assert refreshed() == (7, 1, 0, 0)
    (src / "a/m2.py").unlink()
    put("a/m3.py", "def broken(:\n")
    put("b/new.py", "def new(): pass\n")
    os.utime(src / "b/new.py", (old, old))
    assert refreshed() == (7, 2, 2, 1)
    put("a/[odd] name.py", "def odder(): pass\n")
    assert refreshed()[1:] == (2, 1, 0)
    assert ("a/[odd] name.py", "odder") in names(tree.current(spark, table, python_code.FACTS))


def test_tree_of_a_stopped_run(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "facts")
    src.mkdir()
    (src / "a.py").write_text("def a(): pass\n")
    folder = f"file://{src}"
    tree.refresh(spark, folder, table, python_code.parse, python_code.FACTS)
    (src / "b.py").write_text("def b(): pass\n")

    def fails(texts):
        return python_code.parse(texts).withColumn("name", F.raise_error(F.lit("stopped")).cast("string"))

    with pytest.raises(Exception, match="stopped"):
        tree.refresh(spark, folder, table, fails, python_code.FACTS)
    assert names(tree.current(spark, table, python_code.FACTS)) == {("a.py", "a")}
    assert names(tree.fresh(spark, folder, table, python_code.parse, python_code.FACTS)) == {("a.py", "a"), ("b.py", "b")}


def test_watch(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "facts")
    src.mkdir()
    (src / "a.py").write_text("def a(): pass\n")
    q = tree.watch(spark, f"file://{src}", table, python_code.parse, python_code.FACTS, str(tmp_path / "cp"), every="1 second")
    try:
        for want in ({("a.py", "a")}, {("a.py", "b")}):
            for _ in range(60):
                if names(tree.current(spark, table, python_code.FACTS)) == want:
                    break
                time.sleep(1)
            assert names(tree.current(spark, table, python_code.FACTS)) == want
            (src / "a.py").write_text("def b(): pass\n")
    finally:
        q.stop()


def texts(r, ids):
    return [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz"[: r.randint(2, 26)]) for _ in range(r.randint(0, 60)))) for i in ids]


@pytest.mark.parametrize("skip", [True, False])
def test_postings(spark, tmp_path, monkeypatch, skip):
    """Scores of the index are those of a scan of all texts, after removals and replacements too."""
    monkeypatch.setattr(postings, "BLOCK", 16)
    r = random.Random(4)
    have = dict(texts(r, range(-20, 400)))
    folder = f"file://{tmp_path}/index"
    put = lambda rows: postings.upsert(spark.createDataFrame(rows, "id bigint, text string"), folder)

    def same(at):
        docs = spark.createDataFrame(list(have.items()), "id bigint, text string")
        for query in ("a", "z q", "a B c, d!", "none", "a a z", ""):
            want = [tuple(x) for x in search.bm25(docs, query, 7).collect()]
            assert [tuple(x) for x in postings.search(spark, at, query, 7, skip=skip).collect()] == want

    assert postings.search(spark, folder, "a").collect() == []
    put(list(have.items()))
    same(folder)
    change = dict(texts(r, range(0, 60))) | {k: None for k in range(100, 120)} | {1000: "z z z q"}
    put(list(change.items()))
    have = {k: v for k, v in (have | change).items() if v is not None}
    same(folder)
    put([(5, "z"), (100, "a z"), (1000, None), (None, "z")])
    have = {k: v for k, v in (have | {5: "z", 100: "a z", 1000: None}).items() if v is not None}
    same(folder)
    postings.compact(spark, folder, f"file://{tmp_path}/one")
    same(f"file://{tmp_path}/one")


def test_postings_read_their_parts_only(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    postings.upsert(spark.createDataFrame(texts(random.Random(1), range(300)), "id bigint, text string"), folder)
    plan = postings._of_terms(spark, folder, "q", [0])._jdf.queryExecution().toString()
    assert "part#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_rings(spark, tmp_path):
    """Whatever the batches, the last calls are those of the whole."""
    r = random.Random(2)
    calls = [(k, r.choice("abc"), k % 3, k % 5 > 0, 1.5, f"2024-01-01 00:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}") for k in range(300)]
    kinds = "call_id bigint, tool string, project_id bigint, ok boolean, duration_ms double, at string"
    df = spark.createDataFrame(calls, kinds).withColumn("at", F.to_timestamp("at"))
    want = [x.call_id for x in df.orderBy(F.desc("at"), F.desc("call_id")).limit(20).collect()]
    table, inbox, cp = (str(tmp_path / x) for x in ("rings", "in", "cp"))
    assert rings.last_calls(spark, table).collect() == []
    for k in range(3):  # a call again comes in the last
        df.where(f"call_id % 3 = {k} OR call_id = 0").coalesce(1).write.mode("append").parquet(inbox)
        rings.follow_rings(telemetry.read_calls(spark, inbox, files_per_trigger=1), table, cp, 20).awaitTermination()
    assert [x.call_id for x in rings.last_calls(spark, table, 20).collect()] == want
    assert spark.read.parquet(table).groupBy("tool", "batch").count().agg(F.max("count")).first()[0] <= 20


def strong(edges):
    """Components of two or more by a walk in depth from each node."""
    to = {}
    for s, t in edges:
        to.setdefault(s, set()).add(t)

    def reach(v):
        seen, left = set(), [v]
        while left:
            for w in to.get(left.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    left.append(w)
        return seen

    far = {v: reach(v) for v in {x for e in edges for x in e}}
    return {(v, min(m), len(m)) for v in far if len(m := {w for w in far[v] if v in far[w]} | {v}) > 1}


@pytest.mark.parametrize("seed", (0, 3, 4))
def test_components(spark, seed):
    r = random.Random(seed)
    n = (12, 30, 60, 60, 80, 40)[seed]
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * (1.0, 1.3, 1.1, 2.0, 0.9, 3.0)[seed]))]
    edges += [(100 + k, 100 + (k + 1) % 25) for k in range(25)] + [(200 + k, 201 + k) for k in range(30)] + [(230, 200), (225, 3), (300, 301), (301, 302), (302, 300), (302, 5)]
    got = {tuple(x) for x in algo.components(spark.createDataFrame(edges, "s bigint, t bigint")).select("id", "component", "size").collect()}
    assert got == strong([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("seed", (0, 1))
def test_levels(spark, seed):
    r = random.Random(seed)
    edges = list({tuple(sorted((r.randrange(40), r.randrange(40)), reverse=True)) for _ in range(50)})
    edges = [(s, t) for s, t in edges if s != t] + [(100 + k + 1, 100 + k) for k in range(60)] + [(100, 7), (39, 130)]
    level = {}

    def of(v):
        if v not in level:
            level[v] = max((1 + of(t) for s, t in edges if s == v), default=0)
        return level[v]

    want = {(v, of(v), False) for e in edges for v in e}
    assert {tuple(x) for x in algo.reading_order(spark.createDataFrame(edges, "s bigint, t bigint")).collect()} == want


def test_long_chain(spark, monkeypatch):
    """A hundred thousand nodes in a row, and in a ring, take a few steps."""
    steps = []
    stage = algo.stage
    monkeypatch.setattr(algo, "stage", lambda df: steps.append(1) or stage(df))
    line = spark.range(100_000).select(F.col("id").alias("s"), (F.col("id") + 1).alias("t"))
    assert algo.components(line).count() == 0 and len(steps) <= 40
    steps.clear()
    assert algo.reading_order(line).agg(F.max("level")).first()[0] == 100_000
    ring = line.withColumn("t", F.col("t") % 100_000)
    assert algo.components(ring).agg(F.count("*"), F.max("component"), F.max("size")).first()[:] == (100_000, 0, 100_000)
