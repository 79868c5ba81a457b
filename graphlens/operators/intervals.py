"""Line intervals: innermost definitions, changed lines, and modules by path prefix.

All are equi-joins on the file (or on exploded prefixes) with a range
condition, so no plan compares every pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import small
from ..schema import FUNCTIONS, SYMBOLS, Graph


def innermost(g: Graph, points: DataFrame, types: tuple[str, ...] = FUNCTIONS) -> DataFrame:
    """(file_id, line, node_id): the narrowest definition around each point, else the file's first module, else null.

    An open end reaches to the file's end. Ties go to the later start, then the smaller id.
    """
    d = g.nodes.where(F.col("type").isin(*types)).select(
        F.col("id").alias("d_id"), "file_id", "start_line", F.coalesce("end_line", F.lit(2**31 - 1)).alias("last"))
    width = F.col("last").cast("bigint") - F.col("start_line")
    inside = points.join(d, "file_id").where("line BETWEEN start_line AND last").groupBy("file_id", "line").agg(
        F.min_by("d_id", F.struct(width, -F.col("start_line"), "d_id")).alias("d_id"))
    m = g.nodes.where("type = 'module'").groupBy("file_id").agg(F.min_by("id", F.struct("start_line", "id")).alias("m_id"))
    return (points.distinct().join(inside, ["file_id", "line"], "left").join(m, "file_id", "left")
            .select("file_id", "line", F.coalesce("d_id", "m_id").alias("node_id")))


def enclosing_class(g: Graph) -> DataFrame:
    """(method_id, class_id): the narrowest class around each method; an open end has no limit."""
    m = g.nodes.where("type = 'method'").select(F.col("id").alias("method_id"), "file_id", F.col("start_line").alias("line"))
    c = g.nodes.where("type = 'class'").select(
        F.col("id").alias("class_id"), "file_id", "start_line", F.coalesce("end_line", F.lit(2**31 - 1)).alias("last"))
    width = F.col("last").cast("bigint") - F.col("start_line")
    return m.join(c, "file_id").where("line BETWEEN start_line AND last").groupBy("method_id").agg(
        F.min_by("class_id", F.struct(width, "class_id")).alias("class_id"))


def diff_overlap(g: Graph, changed: DataFrame) -> DataFrame:
    """(id, qname, path, changed_lines) of the symbols that hold changed lines (path, line).

    A file of the graph is meant if its path contains the changed path, with
    % and _ as wildcards and without regard to case.
    """
    paths = changed.select(F.col("path").alias("c_path")).distinct()
    # wildcards leave no key to join on, so the diff's paths must be few
    files = g.files.join(F.broadcast(small(paths)), F.expr("path ILIKE concat('%', c_path, '%')")).select(F.col("id").alias("file_id"), "c_path")
    s = g.symbols.where(F.col("type").isin(*SYMBOLS)).join(files, "file_id")
    lines = changed.distinct().select(F.col("path").alias("c_path"), "line")
    return (s.join(lines, "c_path").where("line BETWEEN start_line AND end_line")
            .groupBy("id", "qname", "path").agg(F.countDistinct("c_path", "line").alias("changed_lines")))


def belongs_to(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, path, module): the longest module that is a folder of the path; <root> for files without folder, else null.

    Each path is exploded into its folders and joined on equality.
    """
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    cut = files.select("id", "path", F.explode(prefixes).alias("module"))
    best = cut.join(modules.select("module").distinct(), "module").groupBy("id").agg(F.max_by("module", F.length("module")).alias("best"))
    return files.join(best, "id", "left").select(
        "id", "path", F.when(~F.col("path").contains("/"), "<root>").otherwise(F.col("best")).alias("module"))


def first_symbols(g: Graph, most_files: int = 50, most_symbols: int = 50) -> DataFrame:
    """(path, k, line, type, qname): the first symbols of the first files by path."""
    s = g.symbols.where(F.col("type").isin(*SYMBOLS))
    files = s.select("path").distinct().orderBy("path").limit(most_files)
    w = Window.partitionBy("path").orderBy("start_line", "id")
    return (s.join(files, "path", "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_symbols)
            .select("path", "k", F.col("start_line").alias("line"), "type", "qname"))
