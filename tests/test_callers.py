"""Facts on a small graph that the bound tables don't show."""

import pytest

from graphlens.operators import algo, callers, incremental, intervals, traverse
from graphlens.schema import Graph


@pytest.fixture(scope="module")
def g(spark):
    files = spark.createDataFrame([(1, "a/x.py"), (2, "a/y.py"), (3, "tests/test_z.py")], "id long, path string")
    nodes = spark.createDataFrame(
        [(1, 1, "function", "f", None, 1, 5), (2, 1, "function", "g", None, 10, 20), (3, 2, "function", "f", None, 1, 3),
         (4, 3, "function", "test_it", None, 1, 9), (5, 1, "class", "C", None, 30, None), (6, 1, "method", "m", "C.m", 31, 35),
         (7, 2, "function", "h", None, 5, 9), (8, 1, "function", "Tester", None, 50, 51)],
        "id long, file_id long, type string, name string, qualified_name string, start_line int, end_line int")
    edges = spark.createDataFrame(
        [(2, 1, "calls", "ambiguous"), (2, 1, "calls", "extracted"),  # parallel, one of them sure
         (7, 1, "calls", "ambiguous"), (7, 3, "calls", None),  # a guess, and a sure call of the same name
         (4, 1, "calls", "extracted"), (1, 1, "calls", "extracted"), (6, 2, "calls", "extracted"), (2, 6, "calls", "inferred")],
        "source_id long, target_id long, relation string, confidence string")
    return Graph(files, nodes, edges)


def test_buckets(g):
    got = {(r.t_id, r.s_id): r.bucket for r in callers.callers_split(g).collect()}
    assert got[1, 2] == "callers" and got[1, 4] == "test_callers" and got[3, 7] == "callers"
    assert (1, 7) not in got and (1, 1) not in got


def test_missing_confidence_column(spark, g):
    bare = Graph(g.raw_files, g.raw_nodes, g.raw_edges.drop("confidence"))
    assert (1, 7) in {(r.t_id, r.s_id) for r in callers.callers_split(bare).collect()}


def test_wildcards_and_case(g):
    assert callers.function_count(g).first()[0] == 5  # neither test_it nor Tester


def test_open_class_end(g):
    assert {(r.method_id, r.class_id) for r in intervals.enclosing_class(g).collect()} == {(6, 5)}
    assert callers.class_methods(g).count() == 0  # this one needs an end


def test_cycles_in_traversal(g):
    roots = g.nodes.where("id = 1").select("id")
    got = {(r.id, r.depth) for r in traverse.deep_callers(g, roots, 5).collect()}
    assert got == {(2, 1), (6, 2)}
    walked = {(r.s_id, r.t_id) for r in traverse.downstream_edges(g, g.nodes.where("id = 2").select("id"), 4).collect()}
    assert walked == {(2, 1), (2, 6), (1, 1), (6, 2)}  # self edges and edges back too


def test_callees_skip_tests(g):
    assert {r.t_id for r in callers.callees(g).where("s_id = 4").collect()} == {1}


def test_components_on_rings(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (5, 7)], "s long, t long")
    got = {(r.id, r.component, r["size"]) for r in algo.components(e).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2)}
    assert {(r.component, r.loop) for r in algo.shortest_loops(e, algo.components(e)).collect()} == {(1, 3), (4, 2)}
    assert {r.id: r.level for r in algo.reading_order(e).collect()} == {7: 0, 4: 1, 5: 1, 1: 2, 2: 2, 3: 2, 6: 3}


def test_betweenness_of_a_long_chain_takes_few_tables(spark, monkeypatch):
    made, real = [], algo.stage
    monkeypatch.setattr(algo, "stage", lambda df, *a: made.append(1) or real(df, *a))
    e = spark.range(60).selectExpr("id AS s", "id + 1 AS t")
    assert {r.id: r.betweenness for r in algo.betweenness(e).collect()} == {k: float(k * (60 - k)) for k in range(61)}
    assert len(made) < 5


def test_betweenness_by_arrays_and_by_joins(spark):
    e = spark.range(300).selectExpr("(id * 7919) % 61 AS s", "(id * id + 3 * id) % 53 AS t").distinct()
    by = [{r.id: round(r.betweenness, 6) for r in algo.betweenness(e, held=held).collect()} for held in (0, 1000)]
    assert by[0] == by[1] and max(by[0].values()) > 0
    some = spark.createDataFrame([(3,), (5,), (5,), (900,)], "id bigint")
    by = [{r.id: round(r.betweenness, 6) for r in algo.betweenness(e, some, held=held).collect()} for held in (0, 1000)]
    assert by[0] == by[1]


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)], "s long, t long")
    assert {r.id: r.betweenness for r in algo.betweenness(e).collect()} == {1: 0.0, 2: 1.0, 4: 1.0, 3: 3.0, 5: 0.0}


def test_diff_twice_changes_nothing(g):
    edges = g.edges
    added, removed = incremental.edge_diff(edges.where("source_id <> 2"), edges)
    now = incremental.apply_diff(edges.where("source_id <> 2"), added, removed)
    added, removed = incremental.edge_diff(now, edges)
    assert added.count() == removed.count() == 0


def test_empty_graph(spark, g):
    none = Graph(g.raw_files.limit(0), g.raw_nodes.limit(0), g.raw_edges.limit(0))
    assert callers.hotspots(none).count() == 0
    assert algo.components(algo.node_imports(none)).count() == 0
    assert algo.reading_order(algo.node_imports(none)).count() == 0
    assert algo.betweenness(algo.node_imports(none)).count() == 0
