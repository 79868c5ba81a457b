"""Who uses a symbol: callers, callees, counts, hotspots, and which definition a name means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.stages import dealt, stage
from ..schema import FUNCTIONS, SYMBOLS, Graph

#: Edges that a task tells apart at a time.
PER_TASK = 400_000


def caller_pairs(g: Graph) -> DataFrame:
    """(t_id, s_id, s_name, s_qname, s_path, s_start_line, s_is_test, confident), a row per target and calling function.

    One confident edge makes a caller confident, whatever its other edges are.
    Aggregated before the source's columns are joined, so parallel edges don't travel.
    """
    pairs = (
        g.linked(("calls",), confident=False).where("s_id <> t_id")
        .groupBy("t_id", "s_id").agg(F.bool_or(F.col("confidence") != "ambiguous").alias("confident"))
    )
    s = g.end("source", "name", "qname", "path", "start_line", "type", "is_test").where(F.col("s_type").isin(*FUNCTIONS))
    return pairs.join(s.drop("s_type"), "s_id")


def suppressed(g: Graph, pairs: DataFrame) -> DataFrame:
    """(t_id, s_id) of ambiguous callers that confidently call another node of the target's name."""
    names = g.nodes.select(F.col("id").alias("t_id"), F.col("name").alias("t_name"))
    sure = (
        g.linked(("calls",)).select("s_id", F.col("t_id").alias("other")).distinct()
        .join(names.select(F.col("t_id").alias("other"), "t_name"), "other")
    )
    guesses = pairs.where("NOT confident").select("t_id", "s_id").join(names, "t_id")
    return guesses.join(sure, ["s_id", "t_name"]).where("other <> t_id").select("t_id", "s_id").distinct()


def callers_split(g: Graph) -> DataFrame:
    """Each target's callers with a bucket: callers, test_callers or ambiguous; suppressed guesses are out."""
    pairs = stage(caller_pairs(g))  # read twice
    kept = pairs.join(suppressed(g, pairs), ["t_id", "s_id"], "left_anti")
    bucket = F.when(~F.col("confident"), "ambiguous").when(F.col("s_is_test"), "test_callers").otherwise("callers")
    return kept.select("t_id", "s_id", "s_qname", "s_path", "s_start_line", bucket.alias("bucket"))


def class_methods(g: Graph) -> DataFrame:
    """(class_id, method_id): methods that start after their class does and not after its end, in one file."""
    c = g.nodes.where("type = 'class'").select(
        F.col("id").alias("class_id"), "file_id", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    m = g.nodes.where("type = 'method'").select(F.col("id").alias("method_id"), "file_id", F.col("start_line").alias("m_start"))
    return c.join(m, "file_id").where("m_start > c_start AND m_start <= c_end").select("class_id", "method_id")


def callers_of_classes(g: Graph) -> DataFrame:
    """Callers of a class or any of its methods, themselves left out; a confident bucket wins."""
    members = class_methods(g)
    own = g.nodes.where("type = 'class'").select(F.col("id").alias("class_id"), F.col("id").alias("t_id"))
    targets = own.unionByName(members.withColumnRenamed("method_id", "t_id"))
    rank = F.when(F.col("bucket") == "callers", 0).when(F.col("bucket") == "test_callers", 1).otherwise(2)
    calls = callers_split(g).withColumn("rank", rank).join(targets, "t_id")
    calls = calls.join(targets.withColumnRenamed("t_id", "s_id"), ["class_id", "s_id"], "left_anti")
    return calls.groupBy("class_id", "s_id", "s_qname", "s_path", "s_start_line").agg(F.min("rank").alias("rank")).select(
        "class_id", "s_id", "s_qname", "s_path", "s_start_line",
        F.element_at(F.array(F.lit("callers"), F.lit("test_callers"), F.lit("ambiguous")), F.col("rank") + 1).alias("bucket"))


def callees(g: Graph, most: int = 50) -> DataFrame:
    """Distinct confident targets of each function; test targets only for test code, at most `most` by (path, line, id)."""
    e = g.linked(("calls",), ("is_test",), ("qname", "path", "start_line", "type", "is_test")).where(
        (F.col("s_id") != F.col("t_id")) & F.col("t_type").isin(*SYMBOLS) & (~F.col("t_is_test") | F.col("s_is_test")))
    e = e.select("s_id", "t_id", "t_qname", "t_path", "t_start_line").distinct()
    w = Window.partitionBy("s_id").orderBy("t_path", "t_start_line", "t_id")
    return e.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def caller_counts(g: Graph) -> DataFrame:
    """Distinct confident non-test callers of each node."""
    e = g.linked(("calls",), ("type", "is_test")).where(
        F.col("s_type").isin(*FUNCTIONS) & ~F.col("s_is_test") & (F.col("s_id") != F.col("t_id")))
    return e.groupBy("t_id").agg(F.countDistinct("s_id").alias("callers"))


def named_callers(g: Graph) -> DataFrame:
    """Distinct confident non-test callers by the target's path, name and type."""
    e = g.linked(("calls",), ("type", "is_test"), ("path", "name", "type")).where(
        F.col("s_type").isin(*FUNCTIONS) & ~F.col("s_is_test") & (F.col("s_id") != F.col("t_id")))
    return e.groupBy("t_path", "t_name", "t_type").agg(F.countDistinct("s_id").alias("callers"))


def hotspots(g: Graph, most: int = 20) -> DataFrame:
    """Non-test functions with the most distinct non-test users: functions that call them, modules that import them."""
    e = g.linked(("calls", "imports"), ("type", "is_test"), ("qname", "path", "start_line", "type", "is_test")).where(
        F.col("t_type").isin(*FUNCTIONS) & F.col("s_type").isin(*FUNCTIONS, "module") & (F.col("s_id") != F.col("t_id"))
        & ~F.col("s_is_test") & ~F.col("t_is_test"))
    return (
        e.groupBy("t_id").agg(F.countDistinct("s_id").alias("used_by"), F.first("t_qname").alias("qname"),
                              F.first("t_path").alias("path"), F.first("t_start_line").alias("line"))
        .orderBy(F.desc("used_by"), "t_id").limit(most)
        .select(F.col("t_id").alias("id"), "qname", "path", "line", "used_by"))


def ranked_definitions(g: Graph, most: int = 10) -> DataFrame:
    """Definitions of each name, best first: not test code, qualified, short path, early line; then by id."""
    s = g.symbols.where(F.col("type").isin(*SYMBOLS))
    w = Window.partitionBy("name").orderBy("is_test", (F.col("qname") != F.col("name")), F.length("path"), "start_line", "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("name", "rank", "id", "path", "start_line")


def central_definition(g: Graph, hint: str = "") -> DataFrame:
    """The most used non-test definition of each name; paths that contain hint come first."""
    score = g.edges.where(F.col("relation").isin("calls", "imports", "implements")).groupBy(
        F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("score"))
    out = g.symbols.where(F.col("type").isin(*SYMBOLS))
    for shape in ("%/tests/%", "%/test_%", "%.spec.%", "%.test.%"):
        out = out.where(~F.col("path").ilike(shape))
    out = out.join(score, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    hinted = F.col("path").ilike(f"%{hint}%") if hint else F.lit(False)
    w = Window.partitionBy("name").orderBy(hinted.desc(), F.desc("score"), "start_line", "id")
    return out.withColumn("k", F.row_number().over(w)).where("k = 1").select("name", "id", "path", "score")


def references(g: Graph, include_tests: bool = True) -> DataFrame:
    """What refers to each name, by any relation: (name, relation, s_id, location).

    Names go as numbers and are told apart where their source is, so neither
    they nor places are shuffled with the edges. Parts grow in number with the
    edges, so what a task tells apart stays as large.
    """
    names = stage(g.nodes.where("name IS NOT NULL").select("name").distinct().withColumn("n", F.monotonically_increasing_id()))
    target = g.nodes.select(F.col("id").alias("t_id"), "name").join(names, "name", "left").select("t_id", "n")
    source = g.end("source", "path", "start_line", "is_test")
    if not include_tests:
        source = source.where("NOT s_is_test")
    source = source.select("s_id", F.concat_ws(":", "s_path", F.col("s_start_line").cast("string")).alias("location")).distinct()
    e = g.linked(("calls", "imports", "inherits", "implements", "references"), confident=False).select("s_id", "t_id", "relation")
    met = dealt(e.join(target, "t_id").select("s_id", "relation", "n"), "s_id", parts=g.edges.count() // PER_TASK).distinct()
    return met.join(source, "s_id").join(names, "n", "left").select("name", "relation", "s_id", "location")


def function_count(g: Graph) -> DataFrame:
    return g.nodes.where(F.col("type").isin(*FUNCTIONS)).where(expr.visible_name(F.col("name"))).agg(F.count(F.lit(1)).alias("functions"))


def representative_per_file(g: Graph, most: int = 30) -> DataFrame:
    """The first visible function of each file, in `most` files by path."""
    w = Window.partitionBy("path").orderBy("start_line", "id")
    f = g.symbols.where(F.col("type").isin(*FUNCTIONS)).where(expr.visible_name(F.col("name")))
    return f.withColumn("k", F.row_number().over(w)).where("k = 1").orderBy("path").limit(most).select("path", "id", "name", "start_line")


def inherited_classes(g: Graph) -> DataFrame:
    return g.linked(("inherits",), target=("name",), confident=False).select(F.col("t_name").alias("name")).distinct()
