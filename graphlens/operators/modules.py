"""Folders as modules: overviews, boundaries, traces between them, and graphs to draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.stages import dealt, met, stage
from ..schema import FUNCTIONS, SYMBOLS, Graph


def list_modules(g: Graph) -> DataFrame:
    """(module, files, functions, classes, other, symbols) of each top folder."""
    s = g.symbols.select("file_id", "type")
    per_file = s.groupBy("file_id").agg(
        F.count_if(F.col("type").isin(*FUNCTIONS)).alias("functions"), F.count_if(F.col("type") == "class").alias("classes"),
        F.count_if(~F.col("type").isin(*SYMBOLS)).alias("other"))
    zero = F.lit(0).cast("bigint")
    counts = [F.sum(F.coalesce(c, zero)).alias(c) for c in ("functions", "classes", "other")]
    out = (g.files.join(per_file, F.col("id") == F.col("file_id"), "left").groupBy(expr.folder(F.col("path")).alias("module"))
           .agg(F.count(F.lit(1)).alias("files"), *counts))
    return out.withColumn("symbols", F.col("functions") + F.col("classes") + F.col("other"))


def module_entries(g: Graph) -> DataFrame:
    """list_modules with each module's languages, by file extension, as one text."""
    lang = g.files.select(expr.folder(F.col("path")).alias("module"), F.substring_index("path", ".", -1).alias("language"))
    lang = lang.groupBy("module").agg(F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("languages"))
    return list_modules(g).join(lang, "module")


def used_modules(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Modules that have symbols, import or are imported; and how many were left out."""
    b = boundary_map(g, 1 << 30)
    linked = b.select(F.col("from_module").alias("module")).union(b.select("to_module")).distinct().withColumn("linked", F.lit(True))
    all_of = list_modules(g).join(linked, "module", "left")
    empty = (F.col("symbols") == 0) & F.col("linked").isNull()
    return all_of.where(~empty).drop("linked"), all_of.agg(F.count_if(empty).alias("skipped"))


def boundary_map(g: Graph, most: int = 150) -> DataFrame:
    """(from_module, to_module, imports) between different top folders, most first."""
    e = g.linked(("imports",), ("path",), ("path",)).select(
        expr.folder(F.col("s_path")).alias("from_module"), expr.folder(F.col("t_path")).alias("to_module"))
    return (e.where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("imports"))
            .orderBy(F.desc("imports"), "from_module", "to_module").limit(most))


def matching(files: DataFrame, prefix: str) -> tuple[Column, str]:
    """The path condition for a prefix, and whether it is one or, as nothing is below it, a substring."""
    if not prefix or not files.where(_below(prefix)).limit(1).isEmpty():
        return _below(prefix), "prefix"
    return F.expr(f"path ILIKE '%{_quoted(prefix)}%' ESCAPE '!'"), "substring"


def _quoted(prefix: str) -> str:
    return expr.escaped_like(prefix).replace("\\", "\\\\").replace("'", "\\'")


def _below(prefix: str) -> Column:
    if not prefix:
        return F.lit(True)
    return F.expr(f"path = '{prefix.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}' OR path ILIKE '{_quoted(prefix)}/%' ESCAPE '!'")


def outgoing(g: Graph, prefix: str, most: int = 30) -> DataFrame:
    """(path, relation, edges): confident calls and imports that leave a prefix, most first."""
    inside, _ = matching(g.files, prefix)
    own = g.files.where(inside).select("path")
    e = g.linked(("calls", "imports"), ("path",), ("path",))
    e = e.join(own.withColumnRenamed("path", "s_path"), "s_path", "left_semi").join(own.withColumnRenamed("path", "t_path"), "t_path", "left_anti")
    return (e.groupBy(F.col("t_path").alias("path"), "relation").agg(F.count(F.lit(1)).alias("edges"))
            .orderBy(F.desc("edges"), "path", "relation").limit(most))


def overview(g: Graph, prefix: str, most_files: int = 50, most_symbols: int = 50) -> DataFrame:
    """(path, k, line, type, qname) of the first symbols of the first files under a prefix."""
    inside, _ = matching(g.files, prefix)
    s = g.symbols.where(F.col("type").isin(*SYMBOLS)).where(inside)
    files = s.select("path").distinct().orderBy("path").limit(most_files)
    w = Window.partitionBy("path").orderBy("start_line", "id")
    return (s.join(files, "path", "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_symbols)
            .select("path", "k", F.col("start_line").alias("line"), "type", "qname"))


def files_named(files: DataFrame, needle: str) -> DataFrame:
    """Paths that contain needle, whatever its case."""
    return files.where(F.contains(F.lower("path"), F.lit(needle.lower()))).select("path")


def trace(g: Graph, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(leg, s_path, s_name, relation, t_path, t_name): edges between two sets of files, and one hop out of or into them.

    leg is direct, outbound (ours to neither) or inbound (neither to theirs).
    """
    e = g.linked(("calls", "imports"), ("path", "name"), ("path", "name")).where("s_path <> t_path")
    e = e.select("s_path", "s_name", "relation", "t_path", "t_name").distinct()
    mark = lambda df, side, name: df.distinct().select(F.col("path").alias(side), F.lit(True).alias(name))
    for df, name in ((ours, "ours"), (theirs, "theirs")):
        for side in ("s_path", "t_path"):
            e = e.join(mark(df, side, f"{side[0]}_{name}"), side, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    leg = (F.when(yes("s_ours") & yes("t_theirs"), "direct")
           .when(yes("s_ours") & ~yes("t_ours") & ~yes("t_theirs"), "outbound")
           .when(yes("t_theirs") & ~yes("s_ours") & ~yes("s_theirs"), "inbound"))
    return e.withColumn("leg", leg).where("leg IS NOT NULL").select("leg", "s_path", "s_name", "relation", "t_path", "t_name")


def trace_capped(g: Graph, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """trace() with 20 direct, 10 outbound and 10 inbound edges by path and name."""
    w = Window.partitionBy("leg").orderBy("s_path", "s_name", "relation", "t_path", "t_name")
    most = F.when(F.col("leg") == "direct", 20).otherwise(10)
    return trace(g, ours, theirs).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def shared_files(ours: DataFrame, theirs: DataFrame, most: int = 10) -> DataFrame:
    return ours.intersect(theirs).orderBy("path").limit(most)


def full_graph(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and links to draw: folders and functions; belongs_to and depends_on."""
    functions = g.symbols.where(F.col("type").isin(*FUNCTIONS)).where(expr.visible_name(F.col("name")))
    member = functions.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("node"), "type", F.col("qname").alias("label"),
                              expr.folder(F.col("path")).alias("module"))
    modules = g.files.select(expr.folder(F.col("path")).alias("module")).distinct()
    nodes = member.select("node", "type", "label").unionByName(
        modules.select(F.concat(F.lit("m:"), "module").alias("node"), F.lit("module").alias("type"), F.col("module").alias("label")))
    depends = boundary_map(g, 1 << 30).select(
        F.concat(F.lit("m:"), "from_module").alias("source"), F.concat(F.lit("m:"), "to_module").alias("target"), F.lit("depends_on").alias("type"))
    links = member.select(F.col("node").alias("source"), F.concat(F.lit("m:"), "module").alias("target"), F.lit("belongs_to").alias("type"))
    return nodes, links.unionByName(depends)


def simplified_graph(g: Graph) -> DataFrame:
    """Links of the small drawing: folder dependencies, and one function of each of the first files."""
    from .callers import representative_per_file

    one = representative_per_file(g).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("m:"), expr.folder(F.col("path"))).alias("target"),
        F.lit("belongs_to").alias("type"))
    return full_graph(g)[1].where("type = 'depends_on'").unionByName(one)


def graph_stats(g: Graph, most: int = 5000) -> DataFrame:
    nodes, links = full_graph(g)
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type") != "module").alias("functions"),
                  F.count_if(F.col("type") == "module").alias("modules"))
    return n.crossJoin(links.agg(F.count(F.lit(1)).alias("links"))).withColumn(
        "view_mode", F.when(F.col("nodes") > most, "simplified").otherwise("full"))


#: Pairs of one file that a task makes, about.
PAIRS = 20_000_000


def impact_graph(g: Graph, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, grp): callers, indirect ones and functions of the same file; a node's first group counts.

    Pairs of one file are many where files are long, and a caller is seldom in
    its callee's file: each root takes its list of those along, so pairs go
    from the join to the answer and are neither grouped nor shuffled. Roots
    are dealt by file, those of a file with over PAIRS pairs in parts that
    each meet the whole file, in tasks that grow in number with the pairs.
    """
    from .traverse import deep_callers_with_files, with_files

    own = with_files(g, roots.select("id").distinct()).select(F.col("id").alias("root"), F.col("file_id").alias("root_file"))
    found = deep_callers_with_files(g, roots, depth).join(own, "root", "left")
    found = stage(found.select("root", "id", F.when(F.col("depth") == 1, "caller").otherwise("indirect").alias("grp"), F.coalesce(F.col("file_id") == F.col("root_file"), F.lit(False)).alias("near")), "zstd")
    near = found.where("near").groupBy("root").agg(F.collect_list("id").alias("known"))
    members = g.nodes.where(F.col("type").isin(*FUNCTIONS)).select("id", F.col("file_id").alias("root_file"))
    count = F.count(F.lit(1))
    pairs = own.groupBy("root_file").agg(count.alias("roots")).join(members.groupBy("root_file").agg(count.alias("members")), "root_file").select("root_file", (F.col("roots") * F.col("members")).alias("pairs"))
    files = stage(pairs.select("root_file", "pairs", F.ceil(F.col("pairs") / PAIRS).cast("int").alias("parts")))
    tasks = int(files.agg(F.sum("pairs")).first()[0] or 0) // PAIRS
    each = own.join(near, "root", "left").join(files, "root_file").select("root", "root_file", "known", F.pmod(F.xxhash64("root"), F.col("parts")).cast("int").alias("part"))
    whole = members.join(files, "root_file").select("id", "root_file", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    by = ["root_file", "part"]
    same = met(dealt(each, *by, parts=tasks), dealt(whole, *by, parts=tasks), by).where("id <> root AND NOT coalesce(array_contains(known, id), false)")
    return found.select("root", "id", "grp").unionByName(same.select("root", "id", F.lit("same_file").alias("grp")))
