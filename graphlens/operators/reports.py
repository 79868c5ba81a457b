"""Answers composed of several operators, a row per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.stages import stage
from ..schema import FUNCTIONS, SYMBOLS, Graph
from . import algo, callers, features, intervals, traverse


def analyze_impact(g: Graph, spec: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, callers, test_callers, ambiguous, indirect, risk): who is hit if a symbol changes, and how bad it is."""
    r = roots.select(F.col("id").alias("root")).distinct()
    found = stage(callers.callers_split(g).join(r, F.col("t_id") == F.col("root"), "left_semi").select("t_id", "s_id", "s_path", "bucket"))
    split = found.groupBy(F.col("t_id").alias("root")).agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("callers", "test_callers", "ambiguous")])
    far = traverse.indirect_callers(g, roots, depth).groupBy("root").agg(F.count(F.lit(1)).alias("indirect"))
    zero = F.lit(0).cast("bigint")
    risk = features.risk_levels(g, spec, roots, depth, found).select("root", "risk")
    return r.join(split, "root", "left").join(far, "root", "left").join(risk, "root").select(
        "root", *[F.coalesce(c, zero).alias(c) for c in ("callers", "test_callers", "ambiguous", "indirect")], "risk")


def function_info(g: Graph, most_callers: int = 15, most_callees: int = 30) -> DataFrame:
    """(id, callers, callees, others): of each function, its first callers and callees by name, and how many symbols share its name."""
    first = lambda c, most: F.slice(F.sort_array(F.collect_set(c)), 1, most)
    into = callers.callers_split(g).where("bucket = 'callers'").groupBy(F.col("t_id").alias("id")).agg(first("s_qname", most_callers).alias("callers"))
    out = callers.callees(g).groupBy(F.col("s_id").alias("id")).agg(first("t_qname", most_callees).alias("callees"))
    same = g.nodes.where(F.col("type").isin(*SYMBOLS)).groupBy("name").agg((F.count(F.lit(1)) - 1).alias("others"))
    none = F.array().cast("array<string>")
    f = g.nodes.where(F.col("type").isin(*FUNCTIONS)).select("id", "name")
    return f.join(into, "id", "left").join(out, "id", "left").join(same, "name").select(
        "id", F.array_join(F.coalesce("callers", none), ";").alias("callers"), F.array_join(F.coalesce("callees", none), ";").alias("callees"), "others")


def feature_info(g: Graph, spec: DataFrame) -> DataFrame:
    """(feature, files, functions, decisions, affected): what each feature owns, and its decisions on sensitive matters."""
    f = features.feature_files(spec, g.files).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))
    n = features.feature_functions(g, spec)
    a = features.affected_decisions(spec).groupBy("feature").agg(F.count(F.lit(1)).alias("affected"))
    zero = F.lit(0).cast("bigint")
    return spec.select(F.col("name").alias("feature"), F.size("decisions").alias("decisions")).join(f, "feature", "left").join(n, "feature", "left").join(
        a, "feature", "left").select("feature", F.coalesce("files", zero).alias("files"), F.coalesce("functions", zero).alias("functions"), "decisions",
                                     F.coalesce("affected", zero).alias("affected"))


def project_health(g: Graph, chokepoints: int = 10) -> DataFrame:
    """(kind, subject, value): chokepoints by betweenness, import cycles by size, and odd couplings; no test code."""
    calls = traverse.call_edges(g).where("NOT s_is_test AND NOT t_is_test").select(F.col("s_id").alias("s"), F.col("t_id").alias("t"))
    between = algo.betweenness(calls).select("id", F.round("betweenness", 4).alias("value")).where("value > 0")  # what sums of doubles leave beyond decides no ties
    choke = between.orderBy(F.desc("value"), "id").limit(chokepoints).select(F.lit("chokepoint").alias("kind"), F.col("id").cast("string").alias("subject"), "value")
    cycles = algo.components(algo.node_imports(g)).groupBy("component").agg(F.first("size").alias("n")).select(
        F.lit("import_cycle").alias("kind"), F.col("component").cast("string").alias("subject"), F.col("n").cast("double").alias("value"))
    odd = algo.surprising(g).select(F.lit("surprising").alias("kind"), F.concat_ws("->", F.col("s_id").cast("string"), F.col("t_id").cast("string")).alias("subject"),
                                    F.col("score").cast("double").alias("value"))
    return choke.unionByName(cycles).unionByName(odd)


def chokepoints(g: Graph, most: int = 10) -> DataFrame:
    """(id, path, name, type, normalized, callers) of the functions on most shortest paths, no test code; callers are confident ones outside tests, by path, name and type."""
    calls = traverse.call_edges(g).where("NOT s_is_test AND NOT t_is_test").select(F.col("s_id").alias("s"), F.col("t_id").alias("t"))
    top = algo.betweenness(calls).where("betweenness > 0").orderBy(F.desc(F.round("betweenness", 4)), "id").limit(most)
    named = callers.named_callers(g).withColumnsRenamed({"t_path": "path", "t_name": "name", "t_type": "type"})
    n = top.join(g.symbols.select("id", "path", "name", "type"), "id").join(named, ["path", "name", "type"], "left")
    return n.select("id", "path", "name", "type", F.round("normalized", 6).alias("normalized"), F.coalesce("callers", F.lit(0)).alias("callers"))


#: Files and symbols of a diff that are looked at.
DIFF_FILES, DIFF_SYMBOLS = 50, 25


def analyze_diff(g: Graph, spec: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, qname, changed_lines, callers, risk) of the symbols a diff touches, most changed first."""
    files = changed.select("path").distinct().orderBy("path").limit(DIFF_FILES)
    hit = intervals.diff_overlap(g, changed.join(files, "path", "left_semi")).orderBy(F.desc("changed_lines"), "id").limit(DIFF_SYMBOLS)
    risk = features.risk_levels(g, spec, hit.select("id"))
    return hit.join(risk, hit["id"] == risk["root"]).select("id", "qname", "changed_lines", "callers", "risk")


def compact(g: Graph, hits: DataFrame) -> DataFrame:
    """hits (id, ...) as one line each."""
    s = g.symbols.select("id", expr.symbol_line(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("type"), F.col("qname")).alias("line"))
    return hits.select("id").join(s, "id")
