"""What must not be made, written or shuffled, so that answers grow with their tables."""

import pytest

from graphlens import queries as q
from graphlens.operators import answers, features, modules, traverse
from graphlens.plans.binding import bind


@pytest.fixture
def graph(spark, sf):
    return bind(spark, sf)


def _never(*a, **k):
    raise AssertionError("made")


def test_deepest_level_is_not_written(spark, graph, monkeypatch):
    made, real = [], traverse.stage
    monkeypatch.setattr(traverse, "stage", lambda df, *a: made.append(1) or real(df, *a))
    assert traverse.caller_tree(graph, q._roots(graph), 1).count() > 0
    assert len(made) == 1  # the steps


def test_pairs_of_a_file_are_not_shuffled(spark, graph):
    plan = modules.impact_graph(graph, q._roots(graph))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_risk_lists_no_indirect_callers(spark, graph, monkeypatch):
    monkeypatch.setattr(traverse, "levels", _never)
    assert features.risk_levels(graph, q._spec(graph), q._roots(graph)).count() == q._roots(graph).count()


def test_capped_edges_are_not_all_made(spark, graph, monkeypatch):
    monkeypatch.setattr(traverse, "downstream_edges", _never)
    few = answers.downstream_capped(graph, q._roots(graph), most=3).collect()
    assert few and max(r.k for r in few) == 3


def test_totals_carry_files_along(spark, graph, monkeypatch):
    monkeypatch.setattr(traverse, "deep_callers", _never)
    assert answers.impact_totals(graph, q._spec(graph), q._roots(graph)).count() == q._roots(graph).count()


def test_parents_and_numbers_travel_along(spark):
    roots = spark.createDataFrame([(1, 7)], "id bigint, f int")
    steps = spark.createDataFrame([(1, 2, 5), (1, 3, 6), (3, 4, 8), (2, 4, 8), (4, 1, 7), (4, 2, 5)], "from_id bigint, to_id bigint, f int")
    got = {(r.id, r.depth, r.f, r.parent) for r in traverse.levels(roots, steps, 3, carry=("f",), parents=True).collect()}
    assert got == {(1, 0, 7, None), (2, 1, 5, 1), (3, 1, 6, 1), (4, 2, 8, 2)}
    assert got == {(r.id, r.depth, r.f, r.parent) for r in traverse.levels(roots, steps, 9, carry=("f",), parents=True).collect()}


def test_terms_are_counted_in_their_rows(spark):
    from graphlens.operators import postings

    docs = spark.createDataFrame([(1, "b a b c b"), (2, ""), (5000, "a a")], "id bigint, text string")
    made = postings._entries(docs)
    got = {(r.term, r.block, r.n, r.max_tf, r.min_len, tuple(map(tuple, r.entries))) for r in made.collect()}
    assert got == {("a", 0, 1, 1, 5, ((1, 1, 5),)), ("b", 0, 1, 3, 5, ((1, 3, 5),)), ("c", 0, 1, 1, 5, ((1, 1, 5),)), ("a", 1, 1, 2, 2, ((5000, 2, 2),))}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" in plan and "Exchange hashpartitioning" not in plan


def test_long_files_are_parsed_by_pieces(monkeypatch):
    import ast

    from graphlens.sources import python_code

    text = "import os\n" + "".join(
        f"@deco\n@deco(\n  {k})\ndef f{k}(x):\n    y = os\n    def g(z):\n        return y(z)\n    return g(f{k - 1}(x))\n\n\nclass C{k}(B):\n    def m(self):\n        return self.m(), f{k}(1)\n\n" for k in range(40))
    whole = python_code.facts("a.py", text, len(text) + 1)
    longest, real = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda t, *a: longest.append(len(t)) or real(t, *a))
    assert python_code.facts("a.py", text, 200) == whole and len(whole) > 200 and max(longest) < 600
    # a cut inside a string doesn't compile, so the text is read whole; what doesn't compile whole is an error
    quoted = "x = '''\ndef f(): pass\n" + "def g(): pass\n" * 9 + "'''\ndef h(): pass\n"
    assert [f[3] for f in python_code.facts("a.py", quoted, 20)] == ["h"]
    assert [f[1] for f in python_code.facts("a.py", text + "def (", 200)] == ["error"] and python_code.facts("a.py", "", 200) == []


def test_sources_are_parsed_once(spark, graph, monkeypatch):
    from graphlens.sources import python_code

    made, real = [], python_code.parse
    monkeypatch.setattr(python_code, "parse", lambda df: made.append(1) or real(df))
    assert q.QUERIES["edges_of_files"](spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1


def test_requests_are_dealt_to_all_tasks_and_meet_few_routes(spark):
    from graphlens.operators import routes

    forms = [("a/b1/<pk>/", "a/b1/(?:[0-9]+)/", "a/b1/[^/]+/"), ("a/b2/<pk>/", "a/b2/(?:[0-9]+)/", "a/b2/[^/]+/"), ("x/?y/", "x/?y/", "x/?y/"), ("c/d|e/f", "c/d|e/f", "c/d|e/f"), ("a/", "a/", "a/")]
    table = spark.createDataFrame([(k, d, r, w, d, "u.py", "ANY", "view", f"v{k}", None) for k, (d, r, w) in enumerate(forms)],
                                  "ordinal int, display string, regex string, wide string, bare string, urls_file string, method string, kind string, target string, action string")
    asked = spark.createDataFrame([(x,) for x in ("GET /a/b1/7/", "a/b2/x", "a/b2/<int:pk>/", "a", "a/b3/7/", "xy", "x/y/", "e/f", "c/d")], "request string").coalesce(1)
    got = routes.match(table, asked)
    assert {(r.request, r.target, r.loose) for r in got.collect()} == {
        ("GET /a/b1/7/", "v0", False), ("a/b2/x", "v1", True), ("a/b2/<int:pk>/", "v1", False), ("a", "v4", False), ("xy", "v2", False), ("x/y/", "v2", False), ("e/f", "v3", False), ("c/d", "v3", False)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [request" in plan and "explode(" in plan


def test_references_shuffle_no_names_with_edges(spark, graph, monkeypatch):
    from graphlens.operators import callers

    monkeypatch.setattr(callers, "PER_TASK", 100)
    plan = callers.references(graph)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [s_id" in plan and "Aggregate [name" not in plan
    assert "RepartitionByExpression [s_id" in plan and f", {graph.edges.count() // 100}" in plan
    assert callers.references(graph, include_tests=False).count() < callers.references(graph).count()


def test_files_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from graphlens.sources import tree

    made, real = [], tree.dealt
    monkeypatch.setattr(tree, "dealt", lambda df, *by: made.append(real(df, *by)) or made[-1])
    texts = spark.createDataFrame([(f"m{k}/f{k}.py", "x = 1\n") for k in range(40)], "path string, text string").coalesce(1)
    assert tree.write_files(texts, f"file://{tmp_path}") == 40 and made[0].rdd.getNumPartitions() >= 4


@pytest.fixture
def plans(monkeypatch):
    """Plans of the tables that steps leave, before they run."""
    from graphlens.operators import algo
    from graphlens.plans import stages
    from graphlens.sources import python_code

    made, real = [], stages.stage

    def seen(df, *a):
        made.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *a)

    for m in (stages, algo, answers, traverse, python_code, q):
        monkeypatch.setattr(m, "stage", seen)
    return made


def test_loops_broadcast_nothing(spark, plans):
    from graphlens.operators import algo

    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 10)] + [(s, t) for s in range(10, 17) for t in range(10, 17) if s != t], "s bigint, t bigint")
    members = algo.components(e)
    last = [members, algo.reading_order(e), algo.shortest_loops(e, members), answers.loops(e, members)]
    assert {(r.id, r.component) for r in last[0].collect()} == {(k, 1) for k in (1, 2, 3)} | {(4, 4), (5, 4)} | {(k, 10) for k in range(10, 17)}
    assert {(r.id, r.level) for r in last[1].collect()} == {(k, 2) for k in (1, 2, 3)} | {(4, 1), (5, 1)} | {(k, 0) for k in range(10, 17)}
    assert {(r.component, r.loop) for r in last[2].collect()} == {(1, 3), (4, 2), (10, 2)}
    assert {(r.component, tuple(r.cycle)) for r in last[3].collect()} == {(1, (1, 2, 3)), (4, (4, 5)), (10, (10, 11))}
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in last]
    assert len(plans) > 40 and sum("SortMergeJoin" in p for p in plans) > 20 and not any("Broadcast" in p for p in plans)


def test_python_calls_broadcast_modules_and_files_alone(spark, sf, plans):
    import re

    last = q.QUERIES["python_calls_of_files"](spark, sf)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    sent = {k for p in plans for k in re.findall(r"BroadcastHashJoin \[(\w+)#", p)}
    assert sent <= {"module", "whole", "file_id"} and sum("SortMergeJoin" in p for p in plans) > 4


def test_pieces_are_found_in_few_rounds(spark, plans):
    from graphlens.operators import algo

    chain = [(k, k + 1) if k % 3 else (k + 1, k) for k in range(500)]
    e = chain + [(2000, s) for s in range(1000, 1040)] + [(1039, 999), (5001, 5000)]
    of = algo.pieces(spark.createDataFrame(e, "s bigint, t bigint"), len(e))
    made, got = len(plans), {r.id: r.piece for r in of.collect()}
    assert set(got) == {k for x in e for k in x} and made <= 14
    assert [len({got[k] for k in part}) for part in (range(501), [999, 2000, *range(1000, 1040)], (5000, 5001))] == [1, 1, 1] and len(set(got.values())) == 3
    assert algo.pieces(spark.createDataFrame([], "s bigint, t bigint"), 0).count() == 0


def test_betweenness_gives_a_task_its_piece_alone(spark, monkeypatch):
    import pyarrow as pa

    from graphlens.operators import algo

    ring = [(300 * c + k, 300 * c + (k + d) % 100) for c in range(3) for k in range(100) for d in (1, 3)]
    e = spark.createDataFrame(ring, "s bigint, t bigint")
    whole = {r.id: r.betweenness for r in algo.betweenness(e).collect()}
    assert len(whole) == 300 and min(whole.values()) > 0 and len({round(x, 6) for x in whole.values()}) == 1
    monkeypatch.setattr(type(e), "toArrow", _never)  # nothing goes through the driver
    monkeypatch.setattr(algo, "LITTLE", 1)
    monkeypatch.setattr(algo, "LEAST", 5000)
    assert {r.id: round(r.betweenness, 6) for r in algo.betweenness(e).collect()} == {k: round(x, 6) for k, x in whole.items()}

    def count(rows):
        t = pa.Table.from_batches(rows)
        s, to = t["s"].to_pylist(), t["t"].to_pylist()
        rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, b in zip(s, to) if b is None]), pa.array([float(len([b for b in to if b is not None])) for b in to if b is None])], names=["id", "b"])

    monkeypatch.setattr(algo, "_shares", count)
    nodes = spark.createDataFrame([(k, True, k // 300, 3) for k in whole], "id bigint, starts boolean, by bigint, parts int")
    got = algo._by_arrays(e, nodes, 8).collect()
    assert sorted(r.id for r in got) == sorted(whole) and {r.b for r in got} == {200.0}


def test_shares_by_lists_and_by_matrices():
    import random

    import numpy as np

    from graphlens.functions import paths
    from test_whole import brandes

    r = random.Random(3)
    graphs = [{(r.randint(0, 199), r.randint(0, 199)) for _ in range(900)}, {(k, k + 1) for k in range(300)},
              {(k, 1000) for k in range(90)} | {(1000, k) for k in range(200, 290)} | {(k, k - 150) for k in range(200, 240)}, {(1, 2)}]
    for e in graphs:
        e = sorted((7 * a - 50, 7 * b - 50) for a, b in e if a != b)
        out = {}
        for a, b in e:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
        s, t = (np.array(x) for x in zip(*e))
        ids, b = paths.shares(s, t, np.array(list(out)))
        assert dict(zip(ids.tolist(), b.tolist())) == pytest.approx(brandes(out), abs=1e-9)


def test_chokepoints_send_no_edges_through_the_driver(spark, sf, graph, monkeypatch):
    monkeypatch.setattr(type(graph.edges), "toArrow", _never)
    assert q.QUERIES["health_chokepoints"](spark, sf).count() == 10


def test_ties_of_chokepoints_go_by_id(spark, graph, monkeypatch):
    from graphlens.operators import reports

    found = spark.createDataFrame([(5, 3 + 1e-9), (2, 3.0), (7, 1.0), (9, 1e-5)], "id bigint, betweenness double")
    monkeypatch.setattr(reports.algo, "betweenness", lambda e: found)
    monkeypatch.setattr(reports.algo, "components", lambda e: spark.createDataFrame([], "id bigint, component bigint, size bigint"))
    got = [{r.subject: r.value for r in reports.project_health(graph, n).collect() if r.kind == "chokepoint"} for n in (1, 10)]
    assert got == [{"2": 3.0}, {"2": 3.0, "5": 3.0, "7": 1.0}]


def test_pairs_of_a_file_are_made_by_many_tasks(spark, graph, monkeypatch):
    roots = q._roots(graph)
    whole = {tuple(r) for r in modules.impact_graph(graph, roots).collect()}
    pairs = sum(r.grp == "same_file" for r in modules.impact_graph(graph, roots).collect())
    monkeypatch.setattr(modules, "PAIRS", 5)
    many = modules.impact_graph(graph, roots)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    tasks = {int(line.rsplit(", ", 1)[1]) for line in plan.splitlines() if "RepartitionByExpression [root_file" in line}
    assert len(tasks) == 1 and min(tasks) >= pairs // 5 > 4
    got = many.collect()
    assert len(got) == len(whole) and {tuple(r) for r in got} == whole
