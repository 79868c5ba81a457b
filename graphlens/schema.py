"""The property graph's tables, and how incomplete ones are brought into shape."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import expr

FILES = {"id": "bigint", "path": "string"}
NODES = {
    "id": "bigint", "file_id": "bigint", "type": "string", "name": "string", "qualified_name": "string",
    "start_line": "int", "end_line": "int",
}
EDGES = {"source_id": "bigint", "target_id": "bigint", "relation": "string", "metadata": "string", "confidence": "string"}

FUNCTIONS = ("function", "method")
SYMBOLS = ("function", "method", "class")


def ensure_columns(df: DataFrame, wanted: dict[str, str], defaults: dict | None = None) -> DataFrame:
    """df with the wanted columns: absent ones and nulls get their default, if there is one."""
    defaults, have = defaults or {}, set(df.columns)
    out = []
    for name, kind in wanted.items():
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name in defaults:
            c = F.coalesce(c, F.lit(defaults[name]).cast(kind))
        out.append(c.alias(name))
    return df.select(*out)


@dataclass(frozen=True)
class Graph:
    """Files, nodes and edges, in any state of completeness. A null confidence counts as extracted."""

    raw_files: DataFrame
    raw_nodes: DataFrame
    raw_edges: DataFrame

    @cached_property
    def files(self) -> DataFrame:
        return ensure_columns(self.raw_files, FILES)

    @cached_property
    def nodes(self) -> DataFrame:
        return ensure_columns(self.raw_nodes, NODES)

    @cached_property
    def edges(self) -> DataFrame:
        return ensure_columns(self.raw_edges, EDGES, {"confidence": "extracted"})

    @cached_property
    def symbols(self) -> DataFrame:
        """Nodes with their file's path, the name to show, and whether they are test code."""
        f = self.files.select(F.col("id").alias("file_id"), "path", expr.is_test_path(F.col("path")).alias("is_test"))
        return self.nodes.join(f, "file_id").select(
            "id", "file_id", "type", "name", F.coalesce("qualified_name", "name").alias("qname"),
            "path", "start_line", "end_line", "is_test")

    def end(self, side: str, *columns: str) -> DataFrame:
        """Symbols renamed for one end of an edge: s_... or t_... ."""
        wanted = ("id", *columns)
        return self.symbols.select(*[F.col(c).alias(f"{side[0]}_{c}") for c in wanted])

    def linked(self, relations: tuple[str, ...], source: tuple[str, ...] = (), target: tuple[str, ...] = (),
               confident: bool = True) -> DataFrame:
        """Edges of the relations with the asked columns of both ends, s_... and t_... .

        Unused ends aren't joined, so their columns never reach the scan.
        """
        e = self.edges.where(F.col("relation").isin(*relations))
        if confident:
            e = e.where("confidence <> 'ambiguous'")
        e = e.withColumnsRenamed({"source_id": "s_id", "target_id": "t_id"}).select("s_id", "t_id", "relation", "confidence")
        if source:
            e = e.join(self.end("source", *source), "s_id")
        if target:
            e = e.join(self.end("target", *target), "t_id")
        return e
