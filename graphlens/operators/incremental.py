"""Keeping an index current: fingerprints, digests, and edges that are added and removed rather than rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph

KEY = ("source_id", "target_id", "relation", "metadata")


def fingerprint(g: Graph) -> DataFrame:
    """One row that changes when the index does: counts of files, nodes, edges and edges of ours (tagged with an object), the largest ids and pair of ends."""
    f = g.files.agg(F.count(F.lit(1)).alias("files"), F.max("id").alias("last_file"))
    n = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.max("id").alias("last_node"))
    owned = F.coalesce(F.startswith("metadata", F.lit("{")), F.lit(False))
    e = g.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(owned).alias("owned_edges"), F.max(F.struct("source_id", "target_id")).alias("last")).select(
        "edges", "owned_edges", F.concat_ws("-", F.col("last.source_id").cast("string"), F.col("last.target_id").cast("string")).alias("last_edge"))
    return f.crossJoin(n).crossJoin(e)  # one row each


def snapshot(g: Graph) -> DataFrame:
    """(path, last_node): the largest node id of each file, null for files without nodes."""
    n = g.nodes.groupBy("file_id").agg(F.max("id").alias("last_node"))
    return g.files.join(n, F.col("id") == F.col("file_id"), "left").select("path", "last_node")


def digests(g: Graph) -> DataFrame:
    """(language, files, digest) over files by extension; the digest is a sum, so it doesn't depend on order and merges by parts."""
    s = snapshot(g).withColumn("language", F.substring_index("path", ".", -1))
    row = F.md5(F.concat_ws("|", "path", F.coalesce("last_node", F.lit(0)).cast("string")))
    part = F.conv(F.left(row, F.lit(12)), 16, 10).cast("decimal(38,0)")
    return s.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(part).cast("string").alias("digest"))


def _keyed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("metadata", F.coalesce("metadata", F.lit(""))).select(*KEY).distinct()


def edge_diff(current: DataFrame, desired: DataFrame, upstream: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(added, removed) edges that turn current into desired.

    A pair that upstream (source_id, target_id, confidence) has confidently
    needs no edge of ours; an ambiguous one doesn't count.
    """
    want, have = _keyed(desired), _keyed(current)
    if upstream is not None:
        sure = upstream.where("confidence <> 'ambiguous'").select("source_id", "target_id").distinct()
        want = want.join(sure, ["source_id", "target_id"], "left_anti")
    return want.join(have, list(KEY), "left_anti"), have.join(want, list(KEY), "left_anti")


def apply_diff(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    return _keyed(current).join(removed, list(KEY), "left_anti").unionByName(added)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): new, changed or gone, by content hash."""
    b = before.select("path", F.col("hash").alias("old"))
    a = after.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def without_files(g: Graph, paths: DataFrame) -> Graph:
    """The graph without the given files, their nodes and all edges at either end of those."""
    files = g.files.join(paths.select("path").distinct(), "path", "left_anti")
    nodes = g.nodes.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    ids = nodes.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return Graph(files, nodes, edges)


def replace_owned(edges: DataFrame, prefix: str, wanted: DataFrame) -> DataFrame:
    """edges with those whose metadata starts with prefix replaced by wanted, except pairs that a confident edge has already."""
    owned = F.coalesce(F.startswith("metadata", F.lit(prefix)), F.lit(False))
    rest = edges.where(~owned)
    sure = rest.where("confidence <> 'ambiguous'").select("source_id", "target_id", "relation").distinct()
    return rest.unionByName(wanted.select(*rest.columns).dropDuplicates(list(KEY)).join(sure, ["source_id", "target_id", "relation"], "left_anti"))


def legacy_js_edges(g: Graph) -> DataFrame:
    """Calls without metadata, extracted, that leave a .js file: what an older release wrote."""
    path = g.symbols.select("id", "path")
    e = g.edges.where("relation = 'calls' AND metadata IS NULL AND confidence = 'extracted'")
    e = e.join(path.select(F.col("id").alias("source_id"), F.col("path").alias("s_path")), "source_id").join(
        path.select(F.col("id").alias("target_id"), F.col("path").alias("t_path")), "target_id")
    return e.where("s_path LIKE '%.js' AND s_path <> t_path").select("source_id", "target_id")


#: Seconds for which a kind of edges that failed to relink is left alone.
BACK_OFF = 60


def relink_due(stored: DataFrame, now: DataFrame, failures: DataFrame, at) -> DataFrame:
    """(language) whose digest (language, digest) isn't the stored one, and that hasn't failed (language, failed_at) in the last BACK_OFF seconds."""
    s = stored.select("language", F.col("digest").alias("old"))
    changed = now.join(s, "language", "left").where("NOT digest <=> old").select("language")
    last = failures.groupBy("language").agg(F.max("failed_at").alias("failed_at"))
    wait = F.unix_timestamp(at) - F.unix_timestamp("failed_at") < BACK_OFF
    return changed.join(last, "language", "left").where(~F.coalesce(wait, F.lit(False))).select("language")
