"""Files as tables: source trees, notes, specifications, registries, reports; and where results go."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph
from .spec import spec as spec

#: Folders that hold no sources of one's own.
SKIPPED = ("node_modules", "bower_components", "venv", "env", "dist", "build", "out", "__pycache__")


def graph(spark: SparkSession, folder: str) -> Graph:
    """files, nodes and edges as Parquet tables of a folder."""
    return Graph(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("files", "nodes", "edges")))


def source_tree(spark: SparkSession, folder: str, suffix: str = ".py") -> DataFrame:
    """(path, text, modified, bytes) of the sources below a folder, without hidden and skipped ones; paths are relative."""
    raw = (spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
           .select("value", "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size"))
    base = re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/"))
    named = F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B")))  # the metadata's path is that of an URI
    path = F.regexp_replace(F.regexp_replace(named, r"^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return raw.select(path.alias("path"), F.col("value").alias("text"), F.col("file_modification_time").alias("modified"),
                      F.col("file_size").alias("bytes")).where(~hidden)


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a folder of Markdown files with a --- header of key: value lines."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", "_metadata.file_name")
    head = F.when(F.col("value").startswith("---"), F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?(.*)$", 1)).otherwise("")
    body = F.when(F.col("value").rlike(r"(?s)^---\n.*?\n---"), F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?(.*)$", 2)).otherwise(F.col("value"))
    key = lambda k: F.trim(F.regexp_extract(F.concat(F.lit("\n"), head), rf"\n{k}:[ \t]*([^\n]*)", 1))
    return raw.select(
        F.regexp_replace("file_name", r"\.md$", "").alias("id"), key("title").alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"),
        F.filter(F.transform(F.split(key("tags"), ","), lambda t: F.trim(t)), lambda t: t != "").alias("tags"),
        key("created").alias("created_at"), key("updated").alias("updated_at"), (F.lower(key("is_code_note")) == "true").alias("is_code_note"))


def first_existing(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """Of candidates (ordinal, path) the first that is present (path)."""
    return candidates.join(present.select("path").distinct(), "path", "left_semi").agg(F.min_by("path", "ordinal").alias("path"))


def section(text, heading: str):
    """The part of a Markdown text below a level-2 heading, up to the next."""
    return F.trim(F.regexp_extract(F.concat(F.lit("\n"), text), rf"(?s)\n## {re.escape(heading)}[ \t]*\n(.*?)(?=\n## |$)", 1))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """(project, path) of projects/*/project.json; broken files are left out."""
    schema = "id string, path string, _corrupt string"
    raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/*/project.json")
    return raw.select(F.col("id").alias("project"), "path", "_corrupt").where("_corrupt IS NULL AND path IS NOT NULL").drop("_corrupt")


def usage_document(docs: DataFrame) -> DataFrame:
    """Counters of a usage document (json), each repaired to its default."""
    d = F.from_json("json", "total_calls bigint, calls_by_tool map<string,bigint>, errors map<string,bigint>, first_call_at string, last_call_at string")
    return docs.select(d.alias("d")).select(
        F.coalesce("d.total_calls", F.lit(0)).alias("total_calls"), F.coalesce("d.calls_by_tool", F.create_map().cast("map<string,bigint>")).alias("calls_by_tool"),
        F.coalesce("d.errors", F.create_map().cast("map<string,bigint>")).alias("errors"), "d.first_call_at", "d.last_call_at")


def source_roots(spark: SparkSession, path: str) -> list[str]:
    """Roots that a source-roots.json declares, all that its array has; without any, the repository itself."""
    rows = spark.read.schema("roots array<string>").option("multiLine", True).json(path).select(F.explode("roots").alias("r")).collect()
    return [r.r.rstrip("/") + "/" if r.r else "" for r in rows] or [""]


#: Shapes of report lines and what their groups hold.
LINES = {
    "reference": (r"^\s*(\w+)\s+([\w.$<>]+)\s+\(?([^\s():]+:\d+(?:-\d+)?)\)?\s*$", ("relation", "name", "location")),
    "dead_code": (r"^\s*[-*]?\s*(\w+)\s+([\w.$<>]+)\s+([^\s():]+:\d+(?:-\d+)?)\s+\((\d+) lines\)\s*$", ("kind", "name", "location", "lines")),
    "module": (r"^\s*([\w./<>-]+)/?: (\d+) files?, (\d+) symbols?\s*$", ("module", "files", "symbols")),
    "dependency": (r"^\s*([\w./-]+) -> ([\w./-]+)(?: \((\d+)\))?\s*$", ("from", "to", "count")),
    "call": (r"^\s*([^\s():]+:[\w.$<>]+) (->|<-) ([^\s():]+:[\w.$<>]+)\s*$", ("left", "direction", "right")),
    "overview": (r"^\s*(\d+) (function|method|class) ([\w.$<>]+)\s*$", ("line", "kind", "name")),
    # fixed formats: what the engine prints for references, callers, dependencies, maps, overviews, symbols and impact
    "tagged_reference": (r"^\s+\[(\w+)\]\s+(\S.*?)\s+\(([^()]+)\)", ("relation", "name", "location")),
    "called_by": (r"^\s+← called by:\s+(\S.*?)\s+\(([^()]+)\)\s+\[([^\]]+)\]", ("name", "location", "kind")),
    "file_symbols": (r"^\s+(\S+\.\w+)\s+\((\d+) symbols?\)\s*$", ("path", "symbols")),
    "file_depth": (r"^\s+(\S+\.\w+)\s+\(depth (\d+)\)\s*$", ("path", "depth")),
    "module_map": (r"^(\S+)\s+\((\d+) files?, (\d+) symbols?(?:, ([^()]+))?\)\s*$", ("module", "files", "symbols", "language")),
    "module_imports": (r"^\s+(\S+)\s+→\s+(\S+)\s+\((\d+) imports?\)\s*$", ("from", "to", "imports")),
    "names_by_kind": (r"^\s+(\w+):\s+(\S.*?)(?:\s+\((\d+)×\))?\s*$", ("kind", "names", "count")),
    "symbol": (r"^(\w+)\s+(\S+)\s+(\S+\.\w+:\d+(?:-\d+)?)\s*(\(.*)?$", ("kind", "name", "location", "signature")),
    "impact_head": (r"^Impact:\s*(\S.*?)\s+\S\s+Risk:\s*(\w+)", ("symbol", "risk")),
    "impact_counts": (r"(\d+) direct(?: callers?)?, (\d+) (?:callers total|total|callers), (\d+) files?, (\d+) routes?", ("direct", "total", "files", "routes")),
    "impact_caller": (r"^(\s+)(\S.*?)\s+\(([^()]+)\)\s+(\S+:\d+)\s*$", ("indent", "name", "kind", "location")),
}


def report_lines(reports: DataFrame, shape: str) -> DataFrame:
    """(report_id, pos, ...) of the lines of reports (report_id, text) that have a known shape; others are left out."""
    rx, names = LINES[shape]
    rows = reports.select("report_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(rx))
    return rows.select("report_id", "pos", *[F.regexp_extract("line", rx, k + 1).alias(n) for k, n in enumerate(names)])


def under(reports: DataFrame, shape: str, headings: list[str]) -> DataFrame:
    """report_lines with the heading that each stands under; lines before any of them are left out."""
    from pyspark.sql import Window

    rows = reports.select("report_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.regexp_extract(F.trim("line"), "^(.*?):$", 1)
    w = Window.partitionBy("report_id").orderBy("pos")
    at = rows.select("report_id", "pos", F.last(F.when(head.isin(headings), head), ignorenulls=True).over(w).alias("heading"))
    return report_lines(reports, shape).join(at.where("heading IS NOT NULL"), ["report_id", "pos"])


def said(reports: DataFrame) -> DataFrame:
    """(report_id, message) of reports that say they failed: 'error: ...' lines, or an object with an error."""
    line = F.regexp_extract("text", r"(?im)^\s*error:\s*(.+)$", 1)
    told = F.get_json_object("text", "$.error")
    return reports.select("report_id", F.coalesce(told, F.when(line != "", F.trim(line))).alias("message")).where("message IS NOT NULL")


def enveloped(reports: DataFrame, field: str, schema: str) -> DataFrame:
    """Rows of the array that a JSON object holds under a field; other texts and other kinds of values have none."""
    inner = F.get_json_object("text", f"$.{field}")
    return reports.select("report_id", F.posexplode(F.from_json(inner, f"array<struct<{schema}>>")).alias("pos", "r")).select("report_id", "pos", "r.*")


def impact_tree(reports: DataFrame) -> DataFrame:
    """(report_id, pos, depth, name, location, parent) of indented caller lines 'name (file:line)', two blanks a level."""
    from pyspark.sql import Window

    rows = reports.select("report_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    shape = r"^( *)(?:[-*] )?([\w.<>$]+) \(([^()]+:\d+)\)\s*$"
    rows = rows.where(F.col("line").rlike(shape)).select(
        "report_id", "pos", (F.length(F.regexp_extract("line", shape, 1)) / 2).cast("int").alias("depth"),
        F.regexp_extract("line", shape, 2).alias("name"), F.regexp_extract("line", shape, 3).alias("location"))
    # the parent is the last line before that is one level up: lines of each pair of levels are gone through once, without lists
    w = Window.partitionBy("report_id", "level").orderBy("pos", F.desc("above")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = rows.select("*", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("above")),
                                               F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("above")))).alias("side")).select("*", "side.*")
    parent = F.last(F.when(F.col("above"), F.col("name")), ignorenulls=True).over(w)
    return sides.withColumn("parent", parent).where("NOT above").select("report_id", "pos", "depth", "name", "location", "parent")


def json_rows(reports: DataFrame, schema: str) -> DataFrame:
    """Rows of reports (text) that hold a JSON array of the schema, whatever stands before it."""
    return reports.select(F.explode(F.from_json(F.regexp_extract("text", r"(?s)(\[.*\])", 1), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace a table; Spark's committer makes that whole or not at all."""
    df.write.mode("overwrite").format(kind).save(path)
