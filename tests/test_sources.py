"""Facts from source text: call edges, routes, specifications, JavaScript, diffs, reports, streams."""

import pytest
from pyspark.sql import functions as F

from graphlens.operators import diff, routes
from graphlens.sources import js_code, python_code, readers
from graphlens.streaming import telemetry

CODE = {
    "app/lib/__init__.py": "",
    "app/lib/pay.py": "def pay(x):\n    return x\n\ndef find(u):\n    return u\n",
    "app/lib/ship.py": "def pay(x):\n    return x\n",
    "app/lib/base.py": "class Root:\n    def keep(self):\n        return 1\n",
    "app/lib/kinds.py": (
        "from lib.base import Root\n\nclass Leaf(Root):\n    def sum(self):\n        return self.keep()\n\n"
        "    def end(self):\n        return self.sum()\n\n    def keep(self):\n        return super().keep()\n"),
    "app/pack/__init__.py": "from pack.impl import shown\n",
    "app/pack/impl.py": "def shown():\n    return 1\n",
    "app/pack/rel.py": "from .impl import shown\n\ndef use():\n    return shown()\n",
    "app/main.py": (
        "from lib.pay import pay\nfrom lib import ship as boat\nimport lib.pay\nfrom pack import shown\nfrom lib.kinds import Leaf\n\n"
        "def deco(f):\n    return f\n\n@deco\ndef view(cart):\n    pay(1)\n    boat.pay(2)\n    lib.pay.find(3)\n    cart.find(4)\n"
        "    shown()\n    Leaf.end()\n    return local()\n\ndef local():\n    def inner():\n        return 1\n    return inner()\n"),
    "app/shade.py": "def b():\n    return 0\n\ndef by(items, b):\n    return b(items)\n\ndef other():\n    b = len\n    return b([])\n",
    "app/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame(list(CODE.items()), "path string, text string")


def test_call_edges(code):
    got = {(r.s_path[4:], r.s_line, r.t_path[4:], r.t_line) for r in python_code.call_edges(code, ("", "app/")).collect()}
    assert got == {
        ("main.py", 10, "lib/pay.py", 1), ("main.py", 10, "lib/ship.py", 1), ("main.py", 10, "lib/pay.py", 4), ("main.py", 10, "pack/impl.py", 1),
        ("main.py", 10, "lib/kinds.py", 7), ("main.py", 10, "main.py", 20), ("main.py", 20, "main.py", 21), ("pack/rel.py", 3, "pack/impl.py", 1),
        ("lib/kinds.py", 4, "lib/kinds.py", 10), ("lib/kinds.py", 7, "lib/kinds.py", 4), ("lib/kinds.py", 10, "lib/base.py", 2)}


def test_broken_file_keeps_an_entry(code):
    assert python_code.parse(code).where("path LIKE '%broken.py'").select("kind").collect()[0][0] == "error"


URLS = {
    "site/settings.py": "ROOT_URLCONF = 'site.urls'\n",
    "site/urls.py": (
        "from django.urls import include, path, re_path\nfrom site import views\nurlpatterns = [path('api/', include('shop.urls')),\n"
        "    path('users/me/', views.me), path('users/<int:pk>/', views.User.as_view())]\n"
        "urlpatterns += [re_path(r'^old/(?P<slug>[-a-z]+)/$', views.old), re_path(r'^.*$', views.spa)]\n"),
    "shop/urls.py": (
        "from rest_framework.routers import DefaultRouter\nfrom shop import views\nrouter = DefaultRouter()\nrouter.register('orders', views.Orders)\n"
        "urlpatterns = [path('health/', views.health), path('', include(router.urls))]\n"
        "for kind in ['items', 'parts']:\n    urlpatterns.append(path(f'{kind}/', views.listing))\n"),
}


def test_routes(spark):
    src = spark.createDataFrame(list(URLS.items()), "path string, text string")
    mods = python_code.module_index(src)
    found = routes.patterns(src)
    roots = routes.root_files(src, found, mods)
    assert [r[0] for r in roots.collect()] == ["site/urls.py"]
    table = routes.expand(found, mods, roots)
    asked = ["GET /api/health/", "POST /api/orders/", "GET /api/orders/12/?q=1", "/api/parts/", "/users/me/", "/users/12/", "GET /users/abc/",
             "/old/blue-shoes/", "/users/<pk>/", "/nowhere/at/all"]
    got = {}
    for r in routes.match(table, spark.createDataFrame([(a,) for a in asked], "request string")).collect():
        got.setdefault(r.request, set()).add((r.display, r.method, r.target.split(".")[-1], r.action, r.loose))
    assert got == {
        asked[0]: {("api/health/", "ANY", "health", None, False)}, asked[1]: {("api/orders/", "POST", "Orders", "create", False)},
        asked[2]: {("api/orders/<pk>/", "GET", "Orders", "retrieve", False)}, asked[3]: {("api/parts/", "ANY", "listing", None, False)},
        asked[4]: {("users/me/", "ANY", "me", None, False)}, asked[5]: {("users/<pk>/", "ANY", "User", None, False)},
        asked[6]: {("users/<pk>/", "ANY", "User", None, True)}, asked[7]: {("old/<slug>/", "ANY", "old", None, False)},
        asked[8]: {("users/<pk>/", "ANY", "User", None, False)}, asked[9]: {(".*", "ANY", "spa", None, False)}}


SPEC = """# Project
## Overview
- not a feature
## Feature: Login
Description: Signs people in
### Decisions
- DEC-001: Use tokens (because: stateless)
  - Constraint: must not store passwords
- plain words
### Files
- `src/auth/**`
### Dependencies
- Feature: Users
## How it works
text
## Feature: **Users**
- **Files**: a.py, b/*.py
- **Dependencies**: none
### Status: deprecated
"""


def test_spec(spark):
    a, b = readers.spec(spark.createDataFrame([(SPEC,)], "text string")).orderBy("ordinal").collect()
    assert (a.name, a.description, a.file_patterns, a.dependencies) == ("Login", "Signs people in", ["src/auth/**"], ["Users"])
    assert [(d.id, d.description, d.rationale, d.constraints) for d in a.decisions] == [
        ("DEC-001", "Use tokens", "stateless", ["must not store passwords"]), ("GEN-001", "plain words", "", [])]
    assert (b.name, b.file_patterns, b.dependencies, b.status) == ("Users", ["a.py", "b/*.py"], [], "deprecated")


def test_notes_folder(spark, tmp_path):
    (tmp_path / "n1.md").write_text("---\ntitle: A note\ntags: x, y\nis_code_note: true\n---\nBody [[b]]\n")
    (tmp_path / "n2.md").write_text("no header")
    got = {r.id: r for r in readers.notes(spark, str(tmp_path)).collect()}
    assert (got["n1"].title, got["n1"].tags, got["n1"].content, got["n1"].is_code_note) == ("A note", ["x", "y"], "Body [[b]]", True)
    assert (got["n2"].title, got["n2"].tags, got["n2"].content) == ("", [], "no header")


def test_source_tree(spark, tmp_path):
    for p in ("a/x.py", "node_modules/y.py", ".hidden/z.py", "a/w.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert [r.path for r in readers.source_tree(spark, str(tmp_path)).collect()] == ["a/x.py"]


def test_registry_skips_broken(spark, tmp_path):
    for name, text in (("p1", '{"id": "p1", "path": "/x"}'), ("p2", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "project.json").write_text(text)
    assert [r.project for r in readers.registry(spark, str(tmp_path)).collect()] == ["p1"]


def test_reports(spark):
    text = "risk: HIGH\nmain (a.py:1)\n  one (b.py:2)\n    deep (c.py:3)\n  two (d.py:4)\n"
    got = [(r.depth, r.name, r.parent) for r in readers.impact_tree(spark.createDataFrame([(1, text)], "report_id int, text string")).orderBy("pos").collect()]
    assert got == [(0, "main", None), (1, "one", "main"), (2, "deep", "one"), (1, "two", "main")]
    rows = readers.json_rows(spark.createDataFrame([('note\n[{"a": 1}, {"a": 2}]',)], "text string"), "a: int").collect()
    assert [r.a for r in rows] == [1, 2]


def test_usage_document_repairs(spark):
    r = readers.usage_document(spark.createDataFrame([('{"total_calls": "x", "errors": {"a": 2}}',), ("{",)], "json string")).collect()
    assert [x.total_calls for x in r] == [0, 0] and [x.calls_by_tool for x in r] == [{}, {}]


def test_javascript(spark):
    src = spark.createDataFrame([
        ("src/a.js", "import Loader from './lib/loader';\nconst LOAD = 'load';\nclass Editor {\n  go() { this.x = new Loader(); this.x.run(); bus.execute('load'); }\n}\n// new Ghost()\n"),
        ("src/lib/loader.js", "export class Loader {}\nbus.register('load', onLoad);\n"), ("src/lib/index.js", "")], "path string, text string")
    f = js_code.facts(src).cache()
    assert {(r.path, r.target) for r in js_code.import_edges(f, src).collect()} == {("src/a.js", "src/lib/loader.js")}
    assert {(r.path, r.class_path) for r in js_code.created_classes(f).collect()} == {("src/a.js", "src/lib/loader.js")}
    assert {(r.command, r.handler) for r in js_code.command_edges(f).collect()} == {("load", "onLoad")}
    assert f.where("kind = 'constant'").select("name", "value").collect()[0] == ("LOAD", "load")


EDITOR = """import factory from './factory';
import { names as parts, other } from '@/lib/consts';
const commands = { ADD: 'add', [x]: 1 };
export class Graphics {
  constructor() { this.make(); this.views = { a: new Panel(), b: new Cropper() }; }
  make() { this.cut = this.getComponent(parts.CROPPER); this.cut.clip(); this.views.a.show(); }
}
const KINDS = { shape: Panel, Cropper };
class Panel { show() { return new KINDS[kind](); } }
class Editor {
  constructor(w) { this.g = new Graphics(w); }
  add() { this.g.make(); return this.execute(commands.ADD, this.g); }
}
const addCommand = { name: commands.ADD, execute(g) { return /[}/]new Ghost/.test(g) ? `new Ghost()` : 1 / 2 / 3; } };
factory.register(addCommand);
"""
CONSTS = "export const names = keyMirror({ CROPPER: null });\nexport const parts = { CROPPER: 'CROPPER' };\nexport class Cropper { constructor() {}\n  clip() {} }\n"


def test_javascript_dispatch(spark):
    """The five families of edges, from where their patterns stand to the nodes they mean."""
    from graphlens.schema import Graph

    src = spark.createDataFrame([("src/editor.js", EDITOR), ("src/lib/consts.js", CONSTS), ("src/factory.js", ""), ("tests/cropper.js", "class Cropper {}")], "path string, text string")
    f = js_code.facts(src)
    got = {(r.kind, r.owner, r.name, r.value) for r in f.where("path = 'src/editor.js'").collect()}
    assert {("execute", "", "add", ""), ("register", "", "", "addCommand"), ("component", "", "CROPPER", ""), ("property", "Graphics", "views.a", "Panel"),
            ("own_call", "Graphics", "make", ""), ("this_call", "Graphics", "views.a", "show"), ("this_call", "Editor", "g", "make"), ("import", "", "factory", "./factory")} <= got
    assert {x[2] for x in got if x[0] == "create"} == {"Panel", "Cropper", "Graphics"} and not any("Ghost" in x[2] for x in got)
    files = spark.createDataFrame([(1, "src/editor.js"), (2, "src/lib/consts.js"), (3, "src/factory.js"), (4, "tests/cropper.js")], "id long, path string")
    nodes = spark.createDataFrame([
        (10, 1, "module", "editor", 1, 99), (11, 1, "class", "Graphics", 4, 7), (12, 1, "method", "constructor", 5, 5), (13, 1, "method", "make", 6, 6), (14, 1, "class", "Panel", 9, 9),
        (15, 1, "method", "show", 9, 9), (16, 1, "class", "Editor", 10, 13), (17, 1, "method", "constructor", 11, 11), (18, 1, "method", "add", 12, 12), (19, 1, "method", "execute", 14, 14),
        (20, 2, "class", "Cropper", 3, 4), (21, 2, "method", "constructor", 3, 3), (22, 2, "method", "clip", 4, 4), (23, 4, "class", "Cropper", 1, 1)],
        "id long, file_id long, type string, name string, start_line int, end_line int")
    edges = spark.createDataFrame([], "source_id long, target_id long, relation string")
    have = {(r.family, r.source_id, r.target_id) for r in js_code.graph_edges(f, Graph(files, nodes, edges)).collect()}
    assert have == {
        ("command", 18, 19), ("create", 12, 14), ("create", 12, 12), ("create", 12, 20), ("create", 12, 21), ("create", 15, 14), ("create", 15, 12), ("create", 15, 20), ("create", 15, 21),
        ("create", 17, 11), ("create", 17, 12), ("component", 13, 20), ("property", 13, 22), ("property", 13, 15), ("property", 18, 13), ("own", 12, 13), ("own", 18, 19)}
    assert js_code.graph_edges(f.limit(0), Graph(files, nodes, edges)).count() == 0


def test_import_specifiers(spark):
    files = spark.createDataFrame([(p,) for p in ("src/js/ui.js", "src/js/ui/shape.js", "src/js/ui/index.js", "src/js/component/shape.js", "lib/ui/shape.js")], "path string")
    f = spark.createDataFrame([("src/js/ui.js", "import", str(k), s) for k, s in enumerate(["./ui/shape", "../js/ui/shape.js", "./ui", "@/ui/shape", "react"])],
                              "path string, kind string, name string, value string")
    got = {}
    for r in js_code.imported(f, files).collect():
        got.setdefault(r.name, set()).add(r.target)
    assert got == {"0": {"src/js/ui/shape.js"}, "1": {"src/js/ui/shape.js"}, "2": {"src/js/ui/index.js"}, "3": {"src/js/ui/shape.js", "lib/ui/shape.js"}}


def test_diff_of_nothing(spark):
    d = spark.createDataFrame([(1, ""), (2, "+x\n@@ -1 +4 @@\n+y\n+++ b/f\n+z"), (3, None)], "diff_id int, diff string")
    assert {(r.diff_id, r.path, r.line) for r in diff.changed_lines(d).collect()} == {(2, "f", 0)}


def test_streams(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", i % 2, i % 5 != 0, 1.0, f"2024-01-01 0{i % 4}:00:00") for i in range(40)]
    calls = spark.createDataFrame(rows, "call_id bigint, tool string, project_id int, ok boolean, duration_ms double, at string").select(
        "call_id", "tool", F.col("project_id").cast("bigint").alias("project_id"), "ok", "duration_ms", F.to_timestamp("at").alias("at"))
    calls.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = telemetry.read_calls(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = telemetry.drain(telemetry.counters(stream), "counted", str(tmp_path / "c1"))
    assert {(r.tool, r.calls, r.errors) for r in got.collect()} == {("a", 26, 5), ("b", 14, 3)}
    wins = telemetry.drain(telemetry.tumbling(telemetry.read_calls(spark, str(tmp_path / "in"))), "wins", str(tmp_path / "c2"))
    assert wins.agg(F.sum("calls")).first()[0] == 40
    s = telemetry.drain(telemetry.sessions(telemetry.read_calls(spark, str(tmp_path / "in"))), "sess", str(tmp_path / "c3"))
    assert s.agg(F.sum("calls")).first()[0] == 40


def test_index_follows_sources(spark, tmp_path):
    schema = "path string, text string, modified bigint"
    inbox, table = str(tmp_path / "in"), str(tmp_path / "facts")

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        telemetry.follow_sources(stream, table, python_code.parse, str(tmp_path / "cp")).awaitTermination()
        return {(r.path, r.name) for r in telemetry.current(spark, table, python_code.FACTS).where("kind = 'function'").collect()}

    assert arrive(("a.py", "def f(): pass", 1), ("b.py", "def g(): pass", 1)) == {("a.py", "f"), ("b.py", "g")}
    assert arrive(("a.py", "def h(): pass", 2)) == {("a.py", "h"), ("b.py", "g")}
    assert arrive(("c.py", "x = 1", 3), ("b.py", "def g(): pass\ndef k(): pass", 3)) == {("a.py", "h"), ("b.py", "g"), ("b.py", "k")}
    # a version that was written but not noted as done doesn't count
    telemetry.current(spark, table, python_code.FACTS).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table}/facts/version=99")
    spark.createDataFrame([("a.py", "def z(): pass", 4)], schema).write.mode("append").parquet(inbox)
    fresh = telemetry.refreshed(spark.readStream.schema(schema).parquet(inbox), table, python_code.parse, str(tmp_path / "cp"), python_code.FACTS)
    assert {r.name for r in fresh.where("kind = 'function'").collect()} == {"z", "g", "k"}


def test_back_off(spark):
    failed = spark.createDataFrame([("js", "2024-01-01 00:00:00"), ("js", "2024-01-01 00:00:30"), ("py", "2024-01-01 00:00:00")], "kind string, at string")
    now = spark.createDataFrame([("2024-01-01 00:01:10",)], "at string")
    got = telemetry.backed_off(*(d.withColumn("at", F.to_timestamp("at")) for d in (failed, now))).collect()
    assert {(r.kind, r.tries, r.may_run) for r in got} == {("js", 2, False), ("py", 1, True)}


SCOPES = """
import os, a.c
from .c import go as run
from ...zz import no
import a.q as a
def f(x, *y):
    try:
        run()
    except E as caught:
        caught()
    class K(base()):
        z = run()
        def m(self):
            run()
            self.n()
    [each() for each in y]
    if x:
        def late(): x()
    late()
class C(a.c.B):
    v = run()
    @deco()
    def g(self):
        self.h()
        def inner():
            super().h()
        inner()
    class D:
        def w(self): self.t()
"""


def test_scopes_of_calls():
    """Names that are local call nothing; what stands in a class body counts for no function."""
    got = [(k, o, n, m, line) for _, k, o, n, m, line, *_ in python_code.facts("a/b.py", SCOPES) if k.startswith(("call", "from", "import"))]
    assert got == [
        ("import", "", "os", "os", 0), ("import", "", "a", "a", 0), ("from", "", "run", "/a.c", 0), ("import", "", "a", "a.q", 0),
        ("call", "", "run", "", 6), ("call", "", "run", "", 13), ("call_line", "", "", "18", 6), ("call_self", "C", "h", "", 22),
        ("call_super", "C", "h", "", 25), ("call", "C", "super", "", 25), ("call_line", "C", "", "25", 22)]
    assert [x[1] for x in python_code.facts("x.py", "def f(:")] == ["error"]


def test_roots_and_trees(spark, tmp_path):
    (tmp_path / "roots.json").write_text('{"roots": [' + ", ".join(f'"r{k}/"' for k in range(1500)) + "]}")
    assert len(readers.source_roots(spark, str(tmp_path / "roots.json"))) == 1500
    text = "a (x.py:1)\n  b (x.py:2)\n    c (x.py:3)\n  d (x.py:4)\n    e (x.py:5)\nf (x.py:6)\n  g (x.py:7)\n    h (x.py:8)"
    rows = readers.impact_tree(spark.createDataFrame([(1, text)], "report_id int, text string")).collect()
    assert {(r.name, r.depth, r.parent) for r in rows} == {
        ("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 1, "a"), ("e", 2, "d"), ("f", 0, None), ("g", 1, "f"), ("h", 2, "g")}


def test_small_readers(spark, tmp_path):
    present = spark.createDataFrame([("b.md",), ("c.md",)], "path string")
    wanted = spark.createDataFrame([(0, "a.md"), (1, "b.md"), (2, "c.md")], "ordinal int, path string")
    assert readers.first_existing(wanted, present).first().path == "b.md" and readers.first_existing(wanted, present.limit(0)).first().path is None
    text = spark.createDataFrame([("# T\n## One\nx\ny\n## Two\nz",), ("## One",), (None,)], "t string")
    assert [r[0] for r in text.select(readers.section(F.col("t"), "One")).collect()] == ["x\ny", "", None]
    for kind in ("parquet", "json"):
        readers.write_table(present, str(tmp_path / kind), kind)
        readers.write_table(present.limit(1), str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 1
