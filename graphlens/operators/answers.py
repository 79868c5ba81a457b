"""Whole answers: the lists behind a question, cut where an answer would get too long, and whether they were.

Lists are cut by rank before they are collected, so a symbol with a million
callers costs a window over its callers and a row of a few names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.stages import met, stage
from ..schema import FUNCTIONS, SYMBOLS, Graph
from . import algo, callers, features, intervals, traverse

#: Entries an answer lists.
CALLERS, TESTS, AMBIGUOUS, INDIRECT, DEFINITIONS = 50, 10, 10, 200, 9
EDGES, DIRECT, AROUND = 60, 20, 10
#: Files, symbols and functions of other answers.
FILES, NAMES, KEYS = 50, 50, 3


def first_of(rows: DataFrame, key: str, order: Sequence[str | Column], text: Column, most: int, name: str) -> DataFrame:
    """(key, name, name_truncated): the first `most` texts of each key in order, and whether there were more."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most + 1).select(key, "k", text.alias("t"))
    got = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "t")))).alias("l"), (F.max("k") > most).alias(f"{name}_truncated"))
    return got.select(key, F.transform("l", lambda x: x["t"]).alias(name), f"{name}_truncated")


def place(path: str, line: str, qname: str) -> Column:
    return F.concat(F.col(path), F.lit(":"), F.col(line).cast("string"), F.lit(" "), F.col(qname))


def indirect_ranked(roots: DataFrame, steps: DataFrame, depth: int = 3, most: int = INDIRECT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(root, k, depth, id, more, *carry): callers of callers by depth and id, the first `most`; more tells whether any were cut."""
    far = traverse.levels(roots, steps, depth, most, 2, carry).where("depth > 1")
    w = Window.partitionBy("root").orderBy("depth", "id")
    k = far.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most + 1)
    return k.withColumn("more", F.max("k").over(Window.partitionBy("root")) > most).where(F.col("k") <= most).select("root", "k", "depth", "id", "more", *carry)


def indirect_capped(g: Graph, roots: DataFrame, depth: int = 3, most: int = INDIRECT) -> DataFrame:
    """(root, k, depth, id, qname, path, line, more): callers of callers by depth and id, the first `most`; more tells whether any were cut."""
    names = g.symbols.select("id", "qname", "path", F.col("start_line").alias("line"))
    return indirect_ranked(roots, traverse._steps(g, True), depth, most).join(names, "id").select("root", "k", "depth", "id", "qname", "path", "line", "more")


def downstream_capped(g: Graph, roots: DataFrame, depth: int = 3, most: int = EDGES) -> DataFrame:
    """(root, k, depth, from, to, line, more): edges walked forward by depth, source and place of the target, the first `most`.

    Each source's edges are put in order once. A root's sources with their
    numbers of edges tell which of them its answer takes, so no other edge of
    a root is made.
    """
    w = Window.partitionBy("from_id")
    steps = traverse._steps(g, False, carry=("path", "qname", "start_line")).select("*", F.col("start_line").alias("line"))
    steps = steps.withColumn("o", F.row_number().over(w.orderBy("path", "line", "to_id"))).withColumn("out", F.count(F.lit(1)).over(w))
    steps = stage(steps.select("from_id", "to_id", "o", "out", F.concat_ws(":", "path", "qname").alias("to"), "line"))
    out = steps.where("o = 1").select("from_id", "out")
    seen = traverse.downstream_sources(steps.select("from_id", "to_id"), out, roots, depth, most)
    w = Window.partitionBy("root").orderBy("depth", "id")
    n = seen.join(out, F.col("id") == F.col("from_id")).select("root", "depth", "id", "out")
    n = n.withColumn("before", F.sum("out").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("out"))
    n = n.withColumn("more", F.sum("out").over(Window.partitionBy("root")) > most).where(F.col("before") < most).drop("out")
    first = steps.where(F.col("o") <= most).select(F.col("from_id").alias("id"), "o", "to", "line")
    s = g.symbols.select("id", F.concat_ws(":", "path", "qname").alias("from"))
    k = (F.col("before") + F.col("o")).cast("int")
    return n.join(s, "id").join(first, "id").where(k <= most).select("root", k.alias("k"), (F.col("depth") + 1).alias("depth"), "from", "to", "line", "more")


def impact(g: Graph, spec: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """What a change of each root touches, a row per root.

    symbol, its other definitions, risk (guessed: from ambiguous callers alone),
    callers, test_callers, ambiguous_callers and indirect_callers as lists with
    their counts and whether they were cut, affected functions and files, the
    features that own what is affected with the number of functions and their
    sensitive decisions, and how many affected functions no feature owns. A
    class is asked for with callers_of_classes.
    """
    r = roots.select(F.col("id").alias("root")).distinct()
    split = stage(callers.callers_split(g).join(r, F.col("t_id") == F.col("root"), "left_semi").withColumnRenamed("t_id", "root"))
    names, owned = features.owners(spec, g)
    own = r.select(F.col("root").alias("id")).join(owned, "id", "left").select("id", "f")
    steps = traverse._steps(g, True).join(owned.withColumnRenamed("id", "to_id"), "to_id", "left").select("from_id", "to_id", "f")
    far = stage(indirect_ranked(own, steps, depth, carry=("f",)))
    listed = far.where(F.col("k") <= CALLERS).join(g.symbols.select("id", "qname", "path", F.col("start_line").alias("line")), "id")
    out = r.join(g.symbols.select(F.col("id").alias("root"), "name", F.concat_ws(":", "path", "qname").alias("symbol")), "root")
    ranked = callers.ranked_definitions(g, DEFINITIONS + 1).join(g.symbols.select("id", F.concat_ws(":", "path", "qname").alias("d")), "id")
    others = out.select("root", "name").join(ranked, "name").where("root <> id")
    parts = [first_of(others, "root", ("rank",), F.col("d"), DEFINITIONS, "other_definitions").drop("other_definitions_truncated")]
    for bucket, name, most in (("callers", "callers", CALLERS), ("test_callers", "test_callers", TESTS), ("ambiguous", "ambiguous_callers", AMBIGUOUS)):
        some = split.where(F.col("bucket") == bucket)
        parts.append(first_of(some, "root", ("s_path", "s_start_line", "s_id"), place("s_path", "s_start_line", "s_qname"), most, name))
        parts.append(some.groupBy("root").agg(F.count(F.lit(1)).alias(f"{name[:-1]}_count")))
    parts.append(first_of(listed, "root", ("k",), F.concat(F.lit("depth "), F.col("depth").cast("string"), F.lit(": "), place("path", "line", "qname")), CALLERS, "indirect_callers").drop("indirect_callers_truncated"))
    parts.append(far.groupBy("root").agg(F.count(F.lit(1)).alias("indirect_caller_count"), F.bool_or("more").alias("indirect_more")).withColumn(
        "indirect_callers_truncated", F.col("indirect_caller_count") > CALLERS))
    parts.append(split.where("bucket = 'callers'").groupBy("root").agg(F.countDistinct("s_path").alias("affected_files")))
    # callers are those at depth 1, so they are none of far, and neither are the root
    sure = split.where("bucket = 'callers'").select("root", F.col("s_id").alias("id")).join(owned, "id", "left").select("root", "f")
    around = sure.unionByName(far.select("root", "f")).withColumn("affected", F.lit(1)).unionByName(own.select(F.col("id").alias("root"), "f", F.lit(0).alias("affected")))
    counts = stage(around.groupBy("root", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("affected").alias("affected")).join(F.broadcast(names), "f", "left"))
    parts.append(counts.groupBy("root").agg(F.sum("affected").alias("affected_functions")))
    parts.append(counts.where("f = 0").select("root", F.col("n").alias("unmapped_functions")))
    named = counts.where("feature IS NOT NULL")
    sorted_list = lambda c, n: F.sort_array(F.collect_set(c)).alias(n)
    # a specification has few features, so these lists are short
    parts.append(named.groupBy("root").agg(sorted_list(F.concat_ws(":", "feature", F.col("n").cast("string")), "features")))
    parts.append(named.join(F.broadcast(features.affected_decisions(spec)), "feature").groupBy("root").agg(sorted_list("decision", "decisions")))
    parts.append(features.risk_levels(g, spec, roots, depth, split.withColumnRenamed("root", "t_id")).select("root", F.col("risk").alias("risk_level"), "guessed"))
    for p in parts:
        out = out.join(p, "root", "left")
    empty, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    lists = ("other_definitions", "callers", "test_callers", "ambiguous_callers", "indirect_callers", "features", "decisions")
    numbers = ("caller_count", "test_caller_count", "ambiguous_caller_count", "indirect_caller_count", "affected_functions", "affected_files", "unmapped_functions")
    flags = ("callers_truncated", "test_callers_truncated", "ambiguous_callers_truncated", "indirect_callers_truncated", "indirect_more", "guessed")
    return out.select("root", "symbol", "risk_level", *[F.coalesce(c, empty).alias(c) for c in lists], *[F.coalesce(c, zero).alias(c) for c in numbers],
                      *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def function_details(g: Graph, most_callers: int = 15, most_callees: int = 30) -> DataFrame:
    """(id, symbol, caller_count, callers, callees, callees_truncated, other_definitions) of each function, lists as places."""
    f = g.symbols.where(F.col("type").isin(*FUNCTIONS)).select("id", "name", F.concat_ws(":", "path", "qname").alias("symbol"))
    split = callers.callers_split(g).where("bucket = 'callers'").withColumnRenamed("t_id", "id")
    into = first_of(split, "id", ("s_path", "s_start_line", "s_id"), place("s_path", "s_start_line", "s_qname"), most_callers, "callers").drop("callers_truncated")
    counts = split.groupBy("id").agg(F.count(F.lit(1)).alias("caller_count"))
    out = callers.callees(g).withColumnRenamed("s_id", "id")
    out = first_of(out, "id", ("t_path", "t_start_line", "t_id"), place("t_path", "t_start_line", "t_qname"), most_callees, "callees")
    ranked = callers.ranked_definitions(g, DEFINITIONS + 1).join(g.symbols.select("id", F.concat_ws(":", "path", "qname").alias("d")), "id")
    others = f.select(F.col("id").alias("own"), "name").join(ranked, "name").where("own <> id")
    others = first_of(others, "own", ("rank",), F.col("d"), DEFINITIONS, "other_definitions").select(F.col("own").alias("id"), "other_definitions")
    empty, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    for p in (into, counts, out, others):
        f = f.join(p, "id", "left")
    return f.select("id", "symbol", F.coalesce("caller_count", zero).alias("caller_count"), *[F.coalesce(c, empty).alias(c) for c in ("callers", "callees", "other_definitions")],
                    F.coalesce("callees_truncated", F.lit(False)).alias("callees_truncated"))


def feature_details(g: Graph, spec: DataFrame) -> DataFrame:
    """(feature, files, files_truncated, functions, functions_truncated, decisions, affected_decisions, dependencies) as lists."""
    f = features.feature_files(spec, g.files)
    files = first_of(f, "feature", ("path",), F.col("path"), FILES, "files")
    n = g.symbols.where(F.col("type").isin(*FUNCTIONS)).where(expr.visible_name(F.col("name"))).select("file_id", F.col("id").alias("n_id"), "path", "start_line", "qname")
    own = f.select("feature", F.col("id").alias("file_id")).join(n, "file_id")
    functions = first_of(own, "feature", ("path", "start_line", "n_id"), place("path", "start_line", "qname"), NAMES, "functions")
    touched = features.affected_decisions(spec).groupBy("feature").agg(F.sort_array(F.collect_set("decision")).alias("affected_decisions"))
    out = spec.select(F.col("name").alias("feature"), F.transform("decisions", lambda d: d["id"]).alias("decisions"), "dependencies")
    for p in (files, functions, touched):
        out = out.join(p, "feature", "left")
    empty = F.array().cast("array<string>")
    return out.select("feature", *[F.coalesce(c, empty).alias(c) for c in ("files", "functions", "decisions", "affected_decisions", "dependencies")],
                      *[F.coalesce(c, F.lit(False)).alias(c) for c in ("files_truncated", "functions_truncated")])


def alignment_details(g: Graph, spec: DataFrame) -> DataFrame:
    """features.alignment with the lists behind its counts: covered_files, function_names, decision_ids, constraint_texts."""
    f = features.feature_files(spec, g.files)
    files = first_of(f, "feature", ("path",), F.col("path"), FILES, "covered_files")
    n = g.symbols.where(F.col("type").isin(*SYMBOLS)).select("file_id", F.col("id").alias("n_id"), "path", "start_line", "qname")
    names = first_of(f.select("feature", F.col("id").alias("file_id")).join(n, "file_id"), "feature", ("path", "start_line", "n_id"), F.col("qname"), NAMES, "function_names")
    told = spec.select(F.col("name").alias("feature"), F.transform("decisions", lambda d: d["id"]).alias("decision_ids"), F.col("constraints").alias("constraint_texts"))
    out, empty = features.alignment(g, spec), F.array().cast("array<string>")
    for p in (files, names, told):
        out = out.join(p, "feature", "left")
    return out.select("feature", "issues", "fully_aligned", *[F.coalesce(c, empty).alias(c) for c in ("covered_files", "function_names", "decision_ids", "constraint_texts")],
                      *[F.coalesce(c, F.lit(False)).alias(c) for c in ("covered_files_truncated", "function_names_truncated")])


def diff_details(g: Graph, spec: DataFrame, changed: DataFrame, most_files: int = 50, most_symbols: int = 25) -> DataFrame:
    """(id, symbol, changed_lines, files_truncated, symbols_truncated, ...): the most changed symbols of a diff, each with its impact's lists."""
    files = changed.select("path").distinct()
    first = files.orderBy("path").limit(most_files)
    hit = stage(intervals.diff_overlap(g, changed.join(first, "path", "left_semi")).orderBy(F.desc("changed_lines"), "id").limit(most_symbols + 1))
    kept = hit.orderBy(F.desc("changed_lines"), "id").limit(most_symbols)
    # counts of a diff and of at most most_symbols + 1 rows
    cut = files.agg((F.count(F.lit(1)) > most_files).alias("files_truncated")).crossJoin(hit.agg((F.count(F.lit(1)) > most_symbols).alias("symbols_truncated")))
    report = impact(g, spec, kept.select("id"), 1)
    return kept.select("id", "changed_lines").crossJoin(F.broadcast(cut)).join(report.withColumnRenamed("root", "id"), "id")


def trace_report(g: Graph, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(leg, edges, truncated) between two sets of files: lines 'a.py:f -> b.py:g (calls)', 20 direct and 10 on either side."""
    from .modules import trace

    legs = trace(g, ours, theirs)
    text = F.concat(F.concat_ws(":", "s_path", "s_name"), F.lit(" -> "), F.concat_ws(":", "t_path", "t_name"), F.lit(" ("), F.col("relation"), F.lit(")"))
    w = Window.partitionBy("leg").orderBy("s_path", "s_name", "relation", "t_path", "t_name")
    most = F.when(F.col("leg") == "direct", DIRECT).otherwise(AROUND)
    k = legs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most + 1).withColumn("most", most)
    out = k.groupBy("leg", "most").agg(F.sort_array(F.collect_list(F.when(F.col("k") <= F.col("most"), F.struct("k", text.alias("t"))))).alias("l"), F.max("k").alias("n"))
    return out.select("leg", F.transform("l", lambda x: x["t"]).alias("edges"), (F.col("n") > F.col("most")).alias("truncated"))


def loops(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, cycle): the ids of a shortest loop through each component's smallest node, from it on.

    Going back from the smallest of the nearest nodes that lead to it, always
    to the smallest node a step nearer.
    """
    members = stage(members)
    m = members.select("id", "component")
    steps = stage(met(met(edges, m.select(F.col("id").alias("s"), F.col("component").alias("cs")), "s"),
                      m.select(F.col("id").alias("t"), F.col("component").alias("ct")), "t").where("cs = ct").select(F.col("s").alias("from_id"), F.col("t").alias("to_id")))
    deepest = members.agg(F.max("size")).first()[0] or 0
    seen = stage(traverse.levels(m.select(F.col("component").alias("id")).distinct(), steps, int(deepest)))
    back = steps.where("from_id <> to_id")
    last = met(seen, back, (seen["id"] == back["from_id"]) & (seen["root"] == back["to_id"])).groupBy("root").agg(F.min(F.struct("depth", "id")).alias("e"))
    state = stage(last.select("root", F.col("e.id").alias("id"), F.col("e.depth").alias("depth"), F.array("e.id").alias("cycle")))
    done = None
    while True:
        here = state.where("depth = 0")
        done = here if done is None else done.unionByName(here)
        state = state.where("depth > 0")
        if state.isEmpty():
            break
        nearer = seen.select("root", F.col("id").alias("p"), (F.col("depth") + 1).alias("depth"))
        state = stage(met(met(state, back.withColumnsRenamed({"from_id": "p", "to_id": "id"}), "id"), nearer, ["root", "p", "depth"]).groupBy("root", "id", "depth", "cycle").agg(
            F.min("p").alias("p")).select("root", F.col("p").alias("id"), (F.col("depth") - 1).alias("depth"), F.concat(F.array("p"), "cycle").alias("cycle")))
    return done.select(F.col("root").alias("component"), "cycle")


def tour(g: Graph) -> DataFrame:
    """(path, level, role, in_cycle, depends_on, depended_on_by, key_symbols): files in the order to read them.

    Edges are imports between files. A file that imports none outside its cycle
    is foundational, one that nobody imports is an entry, others are core. Key
    symbols are the three with most callers.
    """
    e = g.linked(("imports",), ("file_id",), ("file_id",), confident=False).where("s_file_id <> t_file_id").select(
        F.col("s_file_id").alias("s"), F.col("t_file_id").alias("t")).distinct()
    e = stage(e)
    order = algo.reading_order(e)
    path = g.files.select("id", "path")
    lists = lambda own, other, name: first_of(
        e.join(path.withColumnRenamed("id", other), other).select(F.col(own).alias("id"), "path"), "id", ("path",), F.col("path"), AROUND, name).drop(f"{name}_truncated")
    n = callers.caller_counts(g).withColumnRenamed("t_id", "n_id").join(g.symbols.select(F.col("id").alias("n_id"), "file_id", "qname"), "n_id")
    keys = first_of(n.withColumnRenamed("file_id", "id"), "id", (F.desc("callers"), "n_id"), F.col("qname"), KEYS, "key_symbols").drop("key_symbols_truncated")
    out, empty = order.join(path, "id"), F.array().cast("array<string>")
    for p in (lists("s", "t", "depends_on"), lists("t", "s", "depended_on_by"), keys):
        out = out.join(p, "id", "left")
    role = F.when(F.col("level") == 0, "foundational").when(F.col("depended_on_by").isNull(), "entry").otherwise("core")
    return out.select("path", "level", role.alias("role"), "in_cycle", *[F.coalesce(c, empty).alias(c) for c in ("depends_on", "depended_on_by", "key_symbols")])


def impact_totals(g: Graph, spec: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, risk, direct, total, files): the head of an impact tree, whose lines are traverse.caller_tree's."""
    deep = traverse.deep_callers_with_files(g, roots, depth)
    per = deep.groupBy("root").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count(F.lit(1)).alias("total"), F.countDistinct("file_id").alias("files"))
    zero = F.lit(0).cast("bigint")
    return features.risk_levels(g, spec, roots, depth).select("root", "risk").join(per, "root", "left").select(
        "root", "risk", *[F.coalesce(c, zero).alias(c) for c in ("direct", "total", "files")])
