import pytest
from pyspark.sql import functions as F

from graphlens.functions import expr
from graphlens.operators import search


@pytest.mark.parametrize("path,want", [
    ("a/tests/x.py", True), ("a/TESTS/x.py", True), ("tests.py", True), ("a/test_x.py", True), ("a/x_test.py", True), ("x.test.js", True),
    ("x.spec.ts", True), ("conftest.py", True), ("a\\spec\\x.py", True), ("a/contest.py", False), ("latest/x.py", False), ("a/testing.py", False)])
def test_is_test_path(spark, path, want):
    assert spark.range(1).select(expr.is_test_path(F.lit(path))).first()[0] is want


@pytest.mark.parametrize("pattern,path,want", [
    ("src/auth/**", "src/auth/login.py", True), ("auth", "src/auth/x/y.py", True), ("src/*.py", "src/a/b.py", False), ("**/a?.js", "x/y/ab.js", True),
    ("./src/a.py", "src/a.py", True), ("a.c", "abc", False)])
def test_glob(spark, pattern, path, want):
    assert spark.range(1).select(F.lit(path).rlike(expr.glob_regex(pattern))).first()[0] is want


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_small_expressions(spark):
    lit = F.lit
    assert tuple(one(spark, expr.split_symbol(lit("a/b.py:C.m")))) == ("a/b.py", "C.m")
    assert tuple(one(spark, expr.split_symbol(lit("a\\b.py::f")))) == ("a/b.py", "f")
    assert tuple(one(spark, expr.split_symbol(lit("charge")))) == (None, "charge")
    assert tuple(one(spark, expr.location(lit("f.py:10-15")))) == ("f.py", 10, 15)
    assert tuple(one(spark, expr.location(lit("f.py:12")))) == ("f.py", 12, 12)
    assert tuple(one(spark, expr.location(lit("f.py")))) == ("f.py", None, None)
    assert one(spark, expr.module_path(lit("a/b/__init__.py"))) == "a.b"
    assert one(spark, expr.module_matches(lit("src/a/b.py"), lit("a.b"))) is True
    assert one(spark, expr.path_matches(lit("./src/a.py"), lit("a.py"))) is True
    assert one(spark, expr.camel_key(lit("IMAGE_LOADER"))) == "ImageLoader"
    assert one(spark, expr.slug(lit("  Ä Note: Two! "))) == "note-two"
    assert one(spark, expr.truncated(lit("abcdef"), 3)) == "abc... [truncated, 6 chars total]"
    assert one(spark, expr.symbol_line(lit("a.py"), lit(3), lit(3), lit("function"), lit("f"), lit("(x,\n  y)"), lit("int"))) == "a.py:3 function f (x, y) -> int"
    assert one(spark, expr.note_mentions(lit("@TwoWords @Function @a.b @x_y @API @project @f.py"))) == ["API", "TwoWords", "a.b", "f.py", "x_y"]


def test_mentions_in_capitals(spark):
    names = ["A1", "API", "X", "Function", "tests", "HTTP2", "12", "TwoWords", "a.b", "a_b"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", expr.code_like(F.col("n")).alias("y")).collect()
    assert {r.n for r in got if r.y} == {"A1", "API", "HTTP2", "TwoWords", "a.b", "a_b"}


def test_queries_are_cut_like_documents(spark):
    docs = spark.createDataFrame([(1, "call foo.bar now"), (2, "other text")], "id int, text string")
    assert [r.id for r in search.bm25(docs, "foo.bar").collect()] == [1] and search.bm25(docs, " . ").count() == 0
