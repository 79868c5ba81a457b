"""Whole-graph algorithms as loops of joins: components, reading order, centrality, unused code, odd couplings.

Textbook definitions: forward-backward colouring for strongly connected
components, Kahn's peeling of the condensed graph, Brandes' accumulation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, paths
from ..plans.stages import counted, met, stage
from ..schema import FUNCTIONS, Graph


def node_imports(g: Graph) -> DataFrame:
    """Distinct (s, t) imports between different nodes, of any confidence."""
    return g.linked(("imports",), confident=False).where("s_id <> t_id").select(F.col("s_id").alias("s"), F.col("t_id").alias("t")).distinct()


def _spread(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, label) with the least label that reaches each id over steps (a, b); start has a label for all."""
    label = stage(start)
    changed = label
    while True:
        offer = met(changed, steps, changed["id"] == steps["a"]).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("offer"))
        both, many = counted(met(label, offer, "id", "left").select("id", F.least("label", "offer").alias("label"), F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("new")), F.col("new"))
        label, changed = both.select("id", "label"), both.where("new").select("id", "label")
        if not many:
            return label


def _twice(a: DataFrame) -> DataFrame:
    """Pointers (id, to, w, least) followed for as many steps again."""
    b = a.select(F.col("id").alias("at"), F.col("to").alias("b_to"), F.col("w").alias("b_w"), F.col("least").alias("b_least"))
    return met(a, b, F.col("to") == F.col("at"), "left").select(
        "id", F.coalesce("b_to", "to").alias("to"), (F.col("w") + F.coalesce("b_w", F.lit(0))).alias("w"), F.least("least", "b_least").alias("least"))


def _jump(ptr: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, to, w, least) at the end of each id's pointers (id, to, w), of which there are `most` at most; and the tables of 1, 4, 16, ... steps.

    w is summed on the way, least is the least id passed, the start included.
    An end is an id without a pointer; where pointers run in a circle, to is
    some id on it and least covers the circle for ids on it. Four steps become
    one each round, so a chain of n pointers takes log4(n) rounds.
    """
    now = ptr.select("id", "to", "w", F.col("id").alias("least"))
    tables, reach = [now], 1
    more = ptr.select(F.col("id").alias("to"), F.lit(True).alias("more"))
    while reach < max(most, 2):
        reach *= 4
        far, going = counted(met(_twice(_twice(now)), more, "to", "left").select("id", "to", "w", "least", F.coalesce("more", F.lit(False)).alias("more")), F.col("more"))
        now = far.drop("more")
        tables.append(now)
        if not going:
            break
    return now, tables


def _contract(e: DataFrame, n: int) -> tuple[DataFrame, int, DataFrame, tuple]:
    """Edges (s, t) without the nodes that have one edge out, and how many are left; circles found (id, component); and what puts those nodes back.

    A node with one edge out is on a circle only with where that edge leads,
    so its edges in go on to the end of its chain. Chains that end in nothing,
    or in a circle of such nodes, can't come back and go.
    """
    out = stage(e.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("to")))
    ends, tables = _jump(out.where("n = 1").select(F.col("s").alias("id"), "to", F.lit(1).cast("bigint").alias("w")), n)
    at_end = out.select(F.col("s").alias("to"), "n")
    kind = F.when(F.col("n").isNull(), "nothing").when(F.col("n") == 1, "circle").otherwise("open")
    chain = met(ends, at_end, "to", "left").select("id", F.col("to").alias("end"), "least", kind.alias("kind"))
    circle = chain.where("kind = 'circle'")
    found = met(circle, circle.select(F.col("end").alias("id")).distinct(), "id", "left_semi").select("id", F.col("least").alias("component"))
    forks = out.where("n > 1").select("s")
    rest = stage(met(met(e, forks, "s", "left_semi"), chain.select(F.col("id").alias("t"), "end", "kind"), "t", "left"))
    onward = rest.where("kind IS NULL OR kind = 'open'").select("s", F.coalesce("end", "t").alias("t")).where("s <> t").distinct()
    left, many = counted(met(onward, forks.select(F.col("s").alias("t")), "t", "left_semi").select("s", "t"))
    return left, many, found, (rest.where("kind = 'open'").select("s", "t", "end"), tables)


def _put_back(of: DataFrame, entries: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """of (id, component) with the nodes of chains that lead from a component into itself, and the ends of such chains."""
    a = of.select(F.col("id").alias("s"), F.col("component").alias("cs"))
    b = of.select(F.col("id").alias("end"), F.col("component").alias("ce"))
    come = met(met(entries, a, "s", "left"), b, "end", "left").select(F.col("t").alias("id"), "end", F.coalesce("cs", "s").alias("cs"), F.coalesce("ce", "end").alias("component"))
    come, many = counted(come.where("cs = component").select("id", "end", "component").distinct())
    if not many:
        return of
    marked = come.select("id", "component").distinct()
    ends = come.where("end = component").select(F.col("end").alias("id"), "component")
    for k, steps in enumerate(tables):  # by tables of 1, 4, 16, ... steps: after each, all within four times as many are marked
        p = steps.select("id", "to")
        ahead, onward = marked, marked
        for _ in range(3):
            ahead = met(ahead, p, "id").select(F.col("to").alias("id"), "component")
            onward = onward.unionByName(ahead)
        marked = onward.distinct() if k % 2 == 0 else stage(onward.distinct())  # plans of six joins at most
    return stage(of.unionByName(met(marked, tables[0].select("id"), "id", "left_semi")).unionByName(ends).distinct())


def _turned(e: DataFrame) -> DataFrame:
    return e.select(F.col("t").alias("s"), F.col("s").alias("t"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component, size) of nodes in strongly connected components of two or more; component is the smallest id.

    Nodes with one edge out, then in, are taken out along whole chains while
    that makes the graph much smaller. What is left is coloured: a node takes
    the least id that reaches it; going back from that id inside its colour
    gives its component. Then the chains are put back. No step gathers the
    graph in one task.
    """
    layers, found, still = [], [], 0
    e, n = counted(edges.where("s <> t").select("s", "t").distinct())
    while n:
        if still < 2:
            left, many, circles, layer = _contract(e, n)
            found.append(circles)
            layers.append(layer)
            still = 0 if many < 0.8 * n else still + 1
            e, n = _turned(left), many
            continue
        ids = e.select(F.col("s").alias("id")).union(e.select("t")).distinct()
        colour = stage(_spread(ids.withColumn("label", F.col("id")), e.select(F.col("s").alias("a"), F.col("t").alias("b"))))
        c = colour.withColumnRenamed("label", "cs").withColumnRenamed("id", "s")
        d = colour.withColumnRenamed("label", "ct").withColumnRenamed("id", "t")
        inside = stage(met(met(e, c, "s"), d, "t").where("cs = ct").select(F.col("t").alias("a"), F.col("s").alias("b")))
        top = F.lit(2**63 - 1)
        back = _spread(colour.select("id", F.when(F.col("id") == F.col("label"), F.col("id")).otherwise(top).alias("label")), inside)
        done = stage(back.where(F.col("label") < top).withColumnRenamed("label", "component"))
        found.append(done)
        gone = done.select("id")
        e, n = counted(met(met(e, gone.withColumnRenamed("id", "s"), "s", "left_anti"), gone.withColumnRenamed("id", "t"), "t", "left_anti"))
        still = 0
    if not found:
        return edges.select(F.col("s").alias("id"), F.col("s").alias("component"), F.lit(1).cast("bigint").alias("size")).limit(0)
    of = stage(reduce(DataFrame.unionByName, found))
    for entries, tables in reversed(layers):
        of = _put_back(of, entries, tables)
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
    return met(of, sizes, "component").select("id", F.col("least").alias("component"), "size")


def shortest_loops(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, loop): length of the shortest loop through each component's smallest node."""
    from .traverse import levels

    members = stage(members)
    m = members.select("id", "component")
    inner = met(met(edges, m.select(F.col("id").alias("s"), F.col("component").alias("cs")), "s"),
                m.select(F.col("id").alias("t"), F.col("component").alias("ct")), "t").where("cs = ct").select(F.col("s").alias("from_id"), F.col("t").alias("to_id"))
    inner = stage(inner)
    deepest = members.agg(F.max("size")).first()[0] or 0
    seen = levels(m.select(F.col("component").alias("id")).distinct(), inner, int(deepest))
    return (met(seen, inner, (seen["id"] == inner["from_id"]) & (seen["root"] == inner["to_id"]))
            .groupBy(F.col("root").alias("component")).agg(F.min(F.col("depth") + 1).alias("loop")))


def reading_order(edges: DataFrame) -> DataFrame:
    """(id, level, in_cycle): level 0 imports nothing outside its cycle; others come after all they import.

    Cycles are condensed first, so all members of one share a level.
    """
    members = components(edges)
    ids = stage(met(edges.select(F.col("s").alias("id")).union(edges.select("t")).distinct(), members.select("id", "component"), "id", "left")
                .select("id", F.coalesce("component", "id").alias("c"), F.col("component").isNotNull().alias("in_cycle")))
    a, b = ids.select(F.col("id").alias("s"), F.col("c").alias("cs")), ids.select(F.col("id").alias("t"), F.col("c").alias("ct"))
    # w is what the level of a source is above that of its target at least
    level = _heights(*counted(met(met(edges, a, "s"), b, "t").where("cs <> ct").select("cs", "ct").distinct().withColumn("w", F.lit(1).cast("bigint"))))
    return met(ids, level, "c", "left").select("id", F.coalesce("level", F.lit(0)).cast("int").alias("level"), "in_cycle")


def _heights(e: DataFrame, n: int) -> DataFrame:
    """(c, level) of the ends of n edges (cs, ct, w) without cycles: 0 without edges out (or no row), else the most of w and the target's level together.

    A node with one edge out is as much higher than the end of its chain as
    the chain is long, so chains go at once; then nodes whose targets are all
    known get their level. Both are repeated until no edge is left.
    """
    known = e.select(F.col("cs").alias("c"), F.col("w").alias("level")).limit(0)
    chains = []
    while n:
        out = stage(e.groupBy("cs").agg(F.count(F.lit(1)).alias("n"), F.min("ct").alias("to"), F.min("w").alias("w")))
        ends, _ = _jump(out.where("n = 1").select(F.col("cs").alias("id"), "to", "w"), n)
        chains.append(ends.select("id", F.col("to").alias("end"), "w"))
        at = chains[-1].select(F.col("id").alias("ct"), "end", F.col("w").alias("more"))
        forks = out.where("n > 1").select("cs")
        e = stage(met(met(e, forks, "cs", "left_semi"), at, "ct", "left")
                  .groupBy("cs", F.coalesce("end", "ct").alias("ct")).agg(F.max(F.col("w") + F.coalesce("more", F.lit(0))).alias("w")))
        # a target that is no fork any more is at the level known of it, or at 0
        base = met(met(e, forks.select(F.col("cs").alias("ct"), F.lit(True).alias("open")), "ct", "left"), known.select(F.col("c").alias("ct"), "level"), "ct", "left")
        whole = base.groupBy("cs").agg(F.max(F.col("w") + F.coalesce("level", F.lit(0))).alias("level"), F.count("open").alias("waits"))
        done = stage(whole.where("waits = 0").select(F.col("cs").alias("c"), "level"))
        known = known.unionByName(done)
        e, n = counted(met(e, done.select(F.col("c").alias("cs")), "cs", "left_anti"))
    for ends in reversed(chains):  # what a chain ends in is known by now, or is at level 0
        up = met(ends, known.select(F.col("c").alias("end"), "level"), "end", "left").select(F.col("id").alias("c"), (F.col("w") + F.coalesce("level", F.lit(0))).alias("level"))
        known = known.unionByName(stage(up))
    return known


#: Edges of a piece that a task holds; edges of pieces that are laid together; sources times edges that are a task's at least.
HELD, LITTLE, LEAST = 8_000_000, 20_000, 20_000_000


def pieces(e: DataFrame, n: int) -> DataFrame:
    """(id, piece) of the ends of n edges (s, t): the same piece for all nodes that edges connect, whatever their direction; it is one of the nodes.

    Nodes point to their least neighbour if that is less than they are, and
    chains of pointers are one node from then on, until no edge is left. Two
    rounds leave half of the nodes at most: one that nothing points to and
    that stays is more than its neighbours' ends, so it points to one next.
    """
    ids = e.select(F.col("s").alias("id")).union(e.select("t")).distinct()
    of = []
    while n:
        both = e.select(F.col("s").alias("id"), F.col("t").alias("to")).unionByName(e.select(F.col("t").alias("id"), F.col("s").alias("to")))
        least, _ = counted(both.groupBy("id").agg(F.min("to").alias("to")).where("to < id").withColumn("w", F.lit(1).cast("bigint")))
        of.append(_jump(least, n)[0].select("id", "to"))
        a, b = of[-1].select(F.col("id").alias("s"), F.col("to").alias("a")), of[-1].select(F.col("id").alias("t"), F.col("to").alias("b"))
        onward = met(met(e, a, "s", "left"), b, "t", "left").select(F.coalesce("a", "s").alias("s"), F.coalesce("b", "t").alias("t"))
        e, n = counted(onward.where("s <> t").distinct())
    if not of:
        return ids.select("id", F.col("id").alias("piece"))
    last = of.pop()
    for ends in reversed(of):  # what stayed in a round may have gone in a later one
        last = last.unionByName(met(ends, last.select(F.col("id").alias("to"), F.col("to").alias("on")), "to", "left").select("id", F.coalesce("on", "to").alias("to")))
    return met(ids, last, "id", "left").select("id", F.coalesce("to", "id").alias("piece"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, batch: int = 4096, held: int = HELD) -> DataFrame:
    """(id, betweenness, normalized) over directed shortest paths of edges (s, t).

    Every source meets every edge it reaches, so the work of a connected piece
    is its nodes times its edges. The sources of a piece are dealt to as many
    tasks as its work asks for, each with the edges of that piece; pieces of
    few edges are laid together. A piece of more than `held` edges is joined a
    level at a time, `batch` sources at most at once. Given sources bound the
    work; then the sum is over those.
    """
    e, m = counted(edges.where("s <> t").select(F.col("s").cast("bigint").alias("s"), F.col("t").cast("bigint").alias("t")).distinct())
    nodes = met(pieces(e, m), e.groupBy(F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("out")), "id", "left")
    nodes = nodes.select("id", "piece", F.coalesce("out", F.lit(0)).alias("out"))
    asked = F.lit(True)
    if sources is not None:
        nodes, asked = nodes.join(sources.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left"), F.coalesce("asked", F.lit(False))
    nodes, n = counted(nodes.select("id", "piece", "out", (asked & (F.col("out") > 0)).alias("starts")))
    sizes = stage(nodes.groupBy("piece").agg(F.sum("out").alias("m"), F.count_if("starts").alias("n")).where("n > 0"))
    little, whole = F.col("m") <= LITTLE, F.col("m") <= held
    work, laid, far = sizes.agg(*[F.coalesce(c, F.lit(0)) for c in (
        F.sum(F.when(whole, F.col("n").cast("double") * F.col("m"))), F.sum(F.when(whole & little, F.col("m"))), F.sum(F.when(~whole, F.col("n"))))]).first()
    tasks = 4 * e.sparkSession.sparkContext.defaultParallelism
    share = F.ceil(F.col("n").cast("double") * F.col("m") / F.lit(max(work / tasks, LEAST))).cast("int")
    held_by = sizes.where(whole).select("piece", F.when(little, F.pmod(F.xxhash64("piece"), F.lit(-(-laid // LITTLE) or 1))).otherwise(F.col("piece")).alias("by"),
                                        F.when(little, 0).otherwise(share).alias("parts"))
    at = nodes.join(held_by, "piece").select("id", "starts", "by", "parts")
    parts = [_by_arrays(e, at, 2 * tasks)]
    if far:
        wide = nodes.join(sizes.where(~whole).select("piece"), "piece", "left_semi")
        reach, batches = stage(met(e, wide.select(F.col("id").alias("s")), "s", "left_semi")), -(-far // batch)
        parts += [_dependencies(reach, wide.where("starts").select("id").where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)) for k in range(batches)]
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    b = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("b").alias("b"))
    value = F.coalesce("b", F.lit(0.0))
    return nodes.select("id").join(b, "id", "left").select("id", value.alias("betweenness"), (value / scale).alias("normalized"))


def _by_arrays(e: DataFrame, at: DataFrame, tasks: int) -> DataFrame:
    """(id, b): what shortest paths owe to each node between; a row per part of a piece and node.

    at has (id, starts, by, parts): nodes with the same `by` are worked on
    together, in so many parts, which share the sources, or (0) in one.
    """
    at = stage(at)
    along = met(e, at.select(F.col("id").alias("s"), "by", "parts"), "s").select("by", F.explode(F.sequence(F.least(F.lit(1), "parts"), "parts")).alias("part"), "s", "t")
    own = at.where("starts").select("by", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("id"), F.col("parts")) + 1).otherwise(0).cast("int").alias("part"),
                                    F.col("id").alias("s"), F.lit(None).cast("bigint").alias("t"))
    place = F.pmod(F.pmod(F.xxhash64("by"), F.lit(tasks)) + F.col("part"), F.lit(tasks)).cast("int")  # parts of a piece go to tasks in turn

    def owed(batches):
        rows, now = [], None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(2)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for k, end in zip(cuts, cuts[1:]):
                if rows and tuple(keys[:, k]) != now:
                    yield from _shares(rows)
                    rows = []
                now = tuple(keys[:, k])
                rows.append(b.slice(k, end - k))
        if rows:
            yield from _shares(rows)

    rows = along.unionByName(own).repartitionById(tasks, place).sortWithinPartitions("by", "part")
    return rows.mapInArrow(owed, "id bigint, b double")


def _shares(rows: list[pa.RecordBatch]):
    """(id, b) of a part's rows (by, part, s, t); sources are those without t."""
    all_of = pa.Table.from_batches(rows)
    rows.clear()
    own, edges = all_of.filter(all_of["t"].is_null()), all_of.filter(all_of["t"].is_valid())
    ids, b = paths.shares(edges["s"].to_numpy(), edges["t"].to_numpy(), own["s"].to_numpy())
    some = np.flatnonzero(b)
    for k in range(0, len(some), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(ids[some[k:k + 65_536]]), pa.array(b[some[k:k + 65_536]])], names=["id", "b"])


def _dependencies(e: DataFrame, start: DataFrame) -> DataFrame:
    """(id, b): what shortest paths from the start nodes owe to each node between, as a table."""
    front = start.select(F.col("id").alias("src"), "id", F.lit(1.0).alias("sigma"), F.lit(0).alias("d"))
    seen, tiers = front, [stage(front)]
    while True:
        nxt = (tiers[-1].join(e, F.col("id") == F.col("s")).groupBy("src", F.col("t").alias("id")).agg(F.sum("sigma").alias("sigma"))
               .join(seen.select("src", "id"), ["src", "id"], "left_anti").withColumn("d", F.lit(len(tiers))))
        nxt = stage(nxt.select("src", "id", "sigma", "d"))
        if nxt.isEmpty():
            break
        tiers.append(nxt)
        seen = seen.unionByName(nxt)
    total, below = None, None
    for tier in reversed(tiers[1:]):
        if below is None:
            here = tier.select("src", "id", "sigma", F.lit(0.0).alias("delta"))
        else:
            w = below.select("src", F.col("id").alias("t"), F.col("sigma").alias("sw"), F.col("delta").alias("dw"))
            gain = (tier.join(e, F.col("id") == F.col("s")).join(w, ["src", "t"]).groupBy("src", "id")
                    .agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("gain")))
            here = tier.join(gain, ["src", "id"], "left").select("src", "id", "sigma", F.coalesce("gain", F.lit(0.0)).alias("delta"))
        below = stage(here)
        part = below.groupBy("id").agg(F.sum("delta").alias("b"))
        total = part if total is None else total.unionByName(part)
    if total is None:
        return start.select("id", F.lit(0.0).alias("b")).limit(0)
    return stage(total.groupBy("id").agg(F.sum("b").alias("b")))


def dead_code(g: Graph) -> DataFrame:
    """(kind, id, qname, path, lines): functions that nothing points to; orphan if they point to nothing either.

    Test code is left out, and so are the constructors of classes that others inherit from.
    """
    from .callers import inherited_classes
    from .intervals import enclosing_class

    e = g.edges.where("source_id <> target_id")
    used, uses = e.select(F.col("target_id").alias("id")).distinct(), e.select(F.col("source_id").alias("id")).distinct()
    s = g.symbols.where(F.col("type").isin(*FUNCTIONS) & ~F.col("is_test")).join(used, "id", "left_anti")
    heirs = g.nodes.join(inherited_classes(g), "name", "left_semi").select(F.col("id").alias("class_id"))
    built = enclosing_class(g).join(heirs, "class_id", "left_semi").select(F.col("method_id").alias("id"))
    makers = g.nodes.where(F.col("name").isin("__init__", "constructor")).select("id").join(built, "id", "left_semi")
    s = s.join(makers, "id", "left_anti").join(uses.withColumn("uses", F.lit(True)), "id", "left")
    return s.select(F.when(F.col("uses"), "unused").otherwise("orphan").alias("kind"), "id", "qname", "path",
                    (F.coalesce("end_line", "start_line") - F.col("start_line") + 1).alias("lines"))


def surprising(g: Graph, most: int = 20) -> DataFrame:
    """Calls and references ranked by doubt, by leaving their folder, and by being the only edge between two files."""
    e = g.linked(("calls", "references"), ("qname", "path", "is_test"), ("qname", "path", "is_test"), confident=False)
    e = e.where("s_id <> t_id AND NOT s_is_test AND NOT t_is_test").groupBy("s_id", "t_id", "s_qname", "t_qname", "s_path", "t_path").agg(
        F.max(F.when(F.col("confidence") == "ambiguous", 2).when(F.col("confidence") == "inferred", 1).otherwise(0)).alias("doubt"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("s_path", "t_path")) == 1
    across = expr.folder(F.col("s_path")) != expr.folder(F.col("t_path"))
    e = e.withColumn("across", across).withColumn("bridge", alone & (F.col("s_path") != F.col("t_path")))
    why = F.concat_ws(",", F.when(F.col("doubt") == 2, "ambiguous").when(F.col("doubt") == 1, "inferred"),
                      F.when(F.col("across"), "crosses_modules"), F.when(F.col("bridge"), "sole_bridge"))
    score = F.col("doubt") + F.col("across").cast("int") + F.col("bridge").cast("int")
    return e.select("s_id", "t_id", score.alias("score"), why.alias("why")).orderBy(F.desc("score"), "s_id", "t_id").limit(most)
