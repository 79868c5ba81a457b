"""Registered graph queries over all of their input: each root, each file, each edge."""

import os
import random

import duckdb
import pytest

from graphlens import queries as q
from graphlens.operators import algo
from graphlens.plans import binding

from test_queries import rows

ROOTED = ("indirect_callers", "deep_callers", "caller_tree", "downstream_edges", "call_graph_both", "impact_graph", "impact_by_feature", "risk_level",
          "overall_risk", "analyze_impact", "file_dependents")


def whole(sql):
    """The registered SQL, which mustn't leave out roots, files or edges."""
    assert "% 20 = 5" not in sql and "% 25 = 3" not in sql and "l_quantity <=" not in sql
    return sql


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", ROOTED)
def test_all_roots(spark, sf, duck, name):
    sql = whole(q.ORACLES[name])
    assert rows(q.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(sql).df())


def test_roots_by_hand(spark, sf):
    """Callers within three calls of every function, by a walk in Python."""
    g = binding.bind(spark, sf)
    functions = {r.id for r in g.symbols.where("type IN ('function', 'method')").collect()}
    plain = {r.id for r in g.symbols.where("type IN ('function', 'method') AND NOT is_test").collect()}
    up = {}
    for e in g.edges.where("relation = 'calls' AND confidence <> 'ambiguous'").collect():
        if e.source_id in plain:
            up.setdefault(e.target_id, set()).add(e.source_id)
    want = set()
    for root in functions:
        seen, front = {root}, {root}
        for depth in (1, 2, 3):
            front = {b for a in front for b in up.get(a, ())} - seen
            seen |= front
            want |= {(root, b, depth) for b in front}
    assert {tuple(r) for r in q.QUERIES["deep_callers"](spark, sf).select("root", "id", "depth").collect()} == want


@pytest.mark.parametrize("name", ["hotspots", "callers_split", "callees", "import_cycles", "shortest_loops", "boundary_map", "surprising"])
def test_all_edges(spark, sf, duck, name):
    sql = whole(q.ORACLES[name])
    assert rows(q.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(sql).df())


def test_edges_by_hand(spark, sf):
    """A line item leads to the next one of its order, so an order has one edge less than lines."""
    lines, orders = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("count(*)", "count(DISTINCT l_orderkey)").first()
    assert binding.bind(spark, sf).edges.count() == lines - orders


def brandes(out):
    """Betweenness by one walk from each source."""
    want = dict.fromkeys(out, 0.0)
    for s in out:
        depth, sigma, order = {s: 0}, {s: 1}, [s]
        for a in order:
            for b in out[a]:
                if b not in depth:
                    depth[b], sigma[b] = depth[a] + 1, 0
                    order.append(b)
                if depth[b] == depth[a] + 1:
                    sigma[b] += sigma[a]
        delta = dict.fromkeys(order, 0.0)
        for a in reversed(order):
            delta[a] = sum(sigma[a] / sigma[b] * (1 + delta[b]) for b in out[a] if depth[b] == depth[a] + 1)
            if a != s:
                want[a] += delta[a]
    return want


def test_betweenness_by_hand(spark, sf):
    """Brandes' sums over all edges, one source at a time."""
    g = binding.bind(spark, sf)
    functions = {r.id for r in g.symbols.where("type IN ('function', 'method')").collect()}
    out = {}
    for e in g.edges.where("relation = 'calls' AND confidence <> 'ambiguous' AND source_id <> target_id").collect():
        if e.source_id in functions and e.target_id in functions:
            out.setdefault(e.source_id, set()).add(e.target_id)
            out.setdefault(e.target_id, set())
    want = brandes(out)
    got = {r.id: r.betweenness for r in q.QUERIES["betweenness"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_health_by_parts(spark, sf):
    """The report's parts against betweenness by hand, cycles and surprising links of their own queries."""
    got = {(r.kind, r.subject): r.value for r in q.QUERIES["project_health"](spark, sf).collect()}
    g = binding.bind(spark, sf)
    plain = {r.id for r in g.symbols.where("type IN ('function', 'method') AND NOT is_test").collect()}
    out = {}
    for e in g.edges.where("relation = 'calls' AND confidence <> 'ambiguous' AND source_id <> target_id").collect():
        if e.source_id in plain and e.target_id in plain:
            out.setdefault(e.source_id, set()).add(e.target_id)
            out.setdefault(e.target_id, set())
    want = sorted(((v, -k) for k, v in brandes(out).items() if v > 1e-9), reverse=True)[:10]
    assert {s: v for (k, s), v in got.items() if k == "chokepoint"} == pytest.approx({str(-k): v for v, k in want}, abs=1e-4)
    cycles = {str(r.component): r.size for r in q.QUERIES["import_cycles"](spark, sf).collect()}
    assert {s: v for (k, s), v in got.items() if k == "import_cycle"} == cycles
    links = {f"{r.s_id}->{r.t_id}": r.score for r in q.QUERIES["surprising"](spark, sf).collect()}
    assert {s: v for (k, s), v in got.items() if k == "surprising"} == links


def test_cycles_and_levels(spark):
    """Components and reading order, cycles condensed."""
    r = random.Random(5)
    edges = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(85)} | {(100 + i, 101 + i) for i in range(8)} | {(r.randint(200, 206), r.randint(200, 206)) for _ in range(12)})
    edges = [e for e in edges if e[0] != e[1]]
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    to = {a: reach(a) for a in out}
    scc = {a: frozenset([a, *(b for b in to[a] if a in to[b])]) for a in out}
    df = spark.createDataFrame(edges, "s long, t long")
    assert {x.id: (x.component, x.size) for x in algo.components(df).collect()} == {a: (min(c), len(c)) for a, c in scc.items() if len(c) > 1}
    level = {}

    def height(c):
        if c not in level:
            level[c] = max((height(scc[b]) + 1 for a in c for b in out[a] if scc[b] != c), default=0)
        return level[c]

    assert {x.id: (x.level, x.in_cycle) for x in algo.reading_order(df).collect()} == {a: (height(c), len(c) > 1) for a, c in scc.items()}
    assert algo.components(df.limit(0)).count() == 0 and algo.reading_order(df.limit(0)).count() == 0


def test_betweenness_in_batches(spark):
    edges = spark.createDataFrame([(i, (i * 7 + k) % 40) for i in range(40) for k in (1, 3)], "s long, t long").where("s <> t")
    whole = {x.id: round(x.betweenness, 6) for x in algo.betweenness(edges).collect()}
    assert {x.id: round(x.betweenness, 6) for x in algo.betweenness(edges, batch=7).collect()} == whole
