"""Level-by-level traversals with a true visited set.

Each level is a join of the frontier with the edges and an anti-join with what
was seen, written to the shared folder; cyclic graphs cost each edge once a
root and level, never each walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import met, stage
from ..schema import FUNCTIONS, Graph

#: Levels for which Spark may choose broadcasts; of more their sum is too much for the driver.
FEW = 4


def call_edges(g: Graph, confident: bool = True) -> DataFrame:
    """Distinct (s_id, t_id) calls between functions, with whether either end is test code."""
    ends = ("type", "is_test")
    e = g.linked(("calls",), ends, ends, confident).where(F.col("s_type").isin(*FUNCTIONS) & F.col("t_type").isin(*FUNCTIONS))
    return e.select("s_id", "t_id", "s_is_test", "t_is_test").distinct()


def levels(roots: DataFrame, steps: DataFrame, depth: int, most: int | None = None, first: int = 0, carry: tuple[str, ...] = (), parents: bool = False) -> DataFrame:
    """(root, id, depth): what each root reaches over steps (from_id, to_id), at its least depth from 0 on.

    With `most`, a root that has more than so many at depths from `first` on
    goes no further: its answer is full with what is there, by depth. So a
    hub costs one level of its own and not the next. Numbers that belong to an
    id travel along where roots and steps (for to_id) have them as `carry`.
    With `parents`, the smallest of the nodes one level nearer that lead to an
    id is its parent. The deepest level, which has most of the rows, is never
    written: it comes dealt by root, so what groups by root needs no other
    shuffle; a caller that reads it twice stages it. Walks of more than FEW
    levels broadcast nothing.
    """
    seen = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), *carry, *[F.lit(None).cast("bigint").alias("parent")] * parents).distinct()
    frontier = seen
    steps = stage(steps)
    join = met if depth > FEW else DataFrame.join
    for d in range(1, depth + 1):
        if most is not None and d > max(first, 1):
            frontier = frontier.join(full(seen.where(F.col("depth") >= first), most), "root", "left_anti")
        walked = join(frontier.select("root", "id"), steps, F.col("id") == F.col("from_id")).select(
            "root", F.col("to_id").alias("id"), F.lit(d).alias("depth"), *carry, *[F.col("from_id").alias("parent")] * parents)
        if d == depth:
            known = [F.max(F.when(F.col("depth") < d, F.col("parent"))).alias("known"), F.min(F.when(F.col("depth") == d, F.col("parent"))).alias("new")] * parents
            both = seen.unionByName(walked).repartition("root").groupBy("root", "id").agg(F.min("depth").alias("depth"), *[F.max(c).alias(c) for c in carry], *known)
            parent = [F.when(F.col("depth") < d, F.col("known")).otherwise(F.col("new")).alias("parent")] * parents
            return both.select("root", "id", "depth", *carry, *parent)
        reached = walked.groupBy("root", "id", "depth").agg(*[F.max(c).alias(c) for c in carry], *[F.min("parent").alias("parent")] * parents) if carry or parents else walked.distinct()
        frontier = stage(join(reached, seen.select("root", "id"), ["root", "id"], "left_anti").select(seen.columns))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def full(found: DataFrame, most: int) -> DataFrame:
    """(root) of roots with more than `most` rows."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("root")


def _steps(g: Graph, backward: bool, confident: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (from_id, to_id) of calls from or to functions outside tests, with the symbol's columns `carry` of to_id."""
    own, other = ("s", "t") if backward else ("t", "s")
    ends = ("type", "is_test", *carry)
    e = g.linked(("calls",), ends if backward else (), () if backward else ends, confident).where(F.col(f"{own}_type").isin(*FUNCTIONS) & ~F.col(f"{own}_is_test"))
    return e.select(F.col(f"{other}_id").alias("from_id"), F.col(f"{own}_id").alias("to_id"), *[F.col(f"{own}_{c}").alias(c) for c in carry]).distinct()


def indirect_callers(g: Graph, roots: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """(root, id, depth): callers of callers, from depth 2; test code is neither found nor passed through.

    With `most`, all up to the depth where a root has more than that.
    """
    return levels(roots, _steps(g, True), depth, most, 2).where("depth > 1")


def deep_callers(g: Graph, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Direct and indirect callers with their depth."""
    return levels(roots, _steps(g, True), depth).where("depth > 0")


def downstream_sources(steps: DataFrame, out: DataFrame, roots: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """(root, id, depth): the nodes whose edges forward are within depth; out (from_id, out) has their numbers of edges.

    With `most`, all up to the depth where a root has more edges than that;
    edges are counted by their sources' numbers of them, and not made.
    """
    seen = frontier = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    for d in range(1, depth):
        if most is not None:
            have = seen.join(out, F.col("id") == F.col("from_id")).groupBy("root").agg(F.sum("out").alias("n")).where(F.col("n") > most)
            frontier = frontier.join(have.select("root"), "root", "left_anti")
        reached = frontier.join(steps, F.col("id") == F.col("from_id")).select("root", F.col("to_id").alias("id")).distinct()
        frontier = stage(reached.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def downstream_edges(g: Graph, roots: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """(root, depth, s_id, t_id): call edges walked forward, each at the depth its source is left, edges to seen nodes too.

    With `most`, all up to the depth where a root has more than that.
    """
    steps = stage(_steps(g, False))
    seen = downstream_sources(steps, steps.groupBy("from_id").agg(F.count(F.lit(1)).alias("out")), roots, depth, most)
    return seen.join(steps, F.col("id") == F.col("from_id")).select("root", (F.col("depth") + 1).alias("depth"), F.col("from_id").alias("s_id"), F.col("to_id").alias("t_id"))


def call_graph(g: Graph, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, direction, id, depth) in both directions, guesses included."""
    up = levels(roots, _steps(g, True, False), depth).where("depth > 0").withColumn("direction", F.lit("callers"))
    down = levels(roots, _steps(g, False, False), depth).where("depth > 0").withColumn("direction", F.lit("callees"))
    return up.unionByName(down).select("root", "direction", "id", "depth")


def file_edges(g: Graph) -> DataFrame:
    """(from_file, to_file, symbols): distinct used symbols between different files, by confident calls and imports."""
    e = g.linked(("calls", "imports"), ("file_id",), ("file_id",)).where("s_file_id <> t_file_id")
    return e.groupBy(F.col("s_file_id").alias("from_file"), F.col("t_file_id").alias("to_file")).agg(F.countDistinct("t_id").alias("symbols"))


def file_dependents(g: Graph, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, id, depth): files that depend on the root files."""
    steps = file_edges(g).select(F.col("to_file").alias("from_id"), F.col("from_file").alias("to_id"))
    return levels(roots, steps, depth).where("depth > 0")


def caller_tree(g: Graph, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, depth, parent): callers with the smallest of the nodes one level nearer that they call."""
    return levels(roots, _steps(g, True), depth, parents=True).where("depth > 0").select("root", "id", "depth", "parent")


def with_files(g: Graph, roots: DataFrame) -> DataFrame:
    """roots (id) with their file_id."""
    return roots.select("id").join(g.nodes.select("id", "file_id"), "id")


def deep_callers_with_files(g: Graph, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, depth, file_id): deep_callers with the file of each."""
    return levels(with_files(g, roots), _steps(g, True, carry=("file_id",)), depth, carry=("file_id",)).where("depth > 0")
