"""Hop distances, shortest paths and cycles. The driver loops over levels; rows stay in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..shared import drop_saved, save, save_measured


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, its lineage cut; the planner knows how small it is."""
    return save(df, "graph")


def reach_depth(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """id, depth: hops from the nearest source over directed edges; ids that can't be reached are left out.

    One join a level, of the newly reached ids with the edges, which are dealt out by their start once; a small level is
    broadcast and moves no edge. Levels are tables, so plans stay short, and each is counted while it is written: a level is
    one job. The loop ends with an empty level.
    """
    hops = edges.select("src", "dst").distinct().repartition("src").persist()
    everything = F.count(F.lit(1))
    level, told = save_measured(sources.select("id").distinct(), "level", n=everything)
    seen, depth = level.withColumn("depth", F.lit(0).cast("long")), 0
    while (most is None or depth < most) and told["n"]:
        depth += 1
        following = level.select(F.col("id").alias("src")).join(hops, "src").select(F.col("dst").alias("id")).distinct()
        level, told = save_measured(following.join(seen.select("id"), "id", "left_anti"), "level", n=everything)
        seen = seen.unionByName(level.withColumn("depth", F.lit(depth).cast("long")))
        if depth % 16 == 0:
            seen = checkpointed(seen)  # one table again, so that no plan reads very many
    hops.unpersist()
    return seen


def with_test_depth(g: Graph) -> DataFrame:
    """Nodes with test_depth: 0 if tested, else hops from the nearest tested node, null if none reaches it."""
    depth = reach_depth(g.edges, g.nodes.filter(F.coalesce("tested", F.lit(False))))
    return g.nodes.drop("test_depth").join(depth.withColumnRenamed("depth", "test_depth"), "id", "left")


def shortest_path(g: Graph, start: str, end: str, most: int = 12) -> DataFrame:
    """hop, id of the shortest directed path; among equals the one whose edges come first. No rows: not reachable.

    A path from a node to itself isn't one, and a path of more than ``most`` edges isn't told. Each level keeps, for a
    node, its least path as an array of edge numbers, which orders paths as a search in edge order would.
    """
    hops = g.edges.select("src", "dst", "edge_ord").repartition("src").persist()
    schema = "id string, path array<bigint>"
    level = g.spark.createDataFrame([(start, [])], schema)
    seen, found = level.select("id"), None
    if start == end:
        most = 0
    for step in range(most):
        grown = level.withColumnRenamed("id", "src").join(hops, "src").select(F.col("dst").alias("id"), F.concat("path", F.array("edge_ord")).alias("path"))
        grown = grown.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        level, told = save_measured(grown, "graph", n=F.count(F.lit(1)), path=F.min(F.when(F.col("id") == end, F.col("path"))))
        found = told["path"]
        if found or not told["n"]:
            break
        seen = seen.unionByName(level.select("id"))
        if step % 16 == 15:
            seen = checkpointed(seen)
    hops.unpersist()
    nodes = g.nodes.select("id", F.col("short").alias("name"))
    if not found:
        return nodes.limit(0).select(F.lit(0).cast("long").alias("hop"), "id", "name")
    steps = [(i + 1, e) for i, e in enumerate(found)]
    rows = g.spark.createDataFrame(steps, "hop long, edge_ord long").join(g.edges, "edge_ord").select("hop", F.col("dst").alias("id"))
    first = g.spark.createDataFrame([(0, start)], "hop long, id string")
    return first.unionByName(rows).join(nodes, "id").select("hop", "id", "name")


#: Rounds of trimming before labels are sent; doublings of the hops that one step of labels takes, and the pairs that one
#: doubling may form, in edges of the graph.
TRIMS, DOUBLINGS, PAIRS = 4, 4, 32


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its least id): strongly connected components of more than one node.

    Colouring in both directions at once: after trimming nodes that nothing enters or leaves, every node takes the least id
    that reaches it and the least that it reaches. Where both are the same, they name the node's component; edges between
    nodes that differ in either lie in none. What is left goes round again. Every step is a join on the edges left; no
    closure is built, so it serves large graphs as well as module graphs.
    """
    left, told = save_measured(edges.select("src", "dst").filter("src <> dst").distinct(), "graph", n=F.count(F.lit(1)))
    found = None
    while True:
        left, n = _trimmed(left, told["n"])
        if not n:
            break
        label = _least_both_ways(_with_shortcuts(left, n))
        members = label.filter("came = goes").select("id", F.col("came").alias("component"))
        found = members if found is None else found.unionByName(members)
        open_ = label.filter("came <> goes")
        same = ["came", "goes"]
        rest = left.join(open_.withColumnRenamed("id", "src"), "src").join(open_.withColumnRenamed("id", "dst"), ["dst", *same])
        left, told = save_measured(rest.select("src", "dst"), "graph", n=F.count(F.lit(1)))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return found.join(sizes, "component").select("id", "component", F.col("size").cast("long").alias("size"))


def _trimmed(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``edges`` (``n``) without most of those that are on no way back, and their number. What stays only costs time."""
    for _ in range(TRIMS if n else 0):
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept, told = save_measured(kept, "graph", n=F.count(F.lit(1)))
        edges, before, n = kept, n, told["n"]
        if n in (0, before):
            break
    return edges, n


def _with_shortcuts(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` (``n``) with edges along ways of up to 2, 4, 8 ... of them: what reaches what stays, in fewer steps.

    A doubling is made only if it forms at most ``PAIRS`` pairs an edge of the graph, which sums over nodes tell before, so
    the edges grow no faster than the graph.
    """
    most, of = PAIRS * n, lambda c, name: edges.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(name))
    for _ in range(DOUBLINGS):
        ways = of("dst", "into").join(of("src", "out"), "id").agg(F.sum(F.col("into") * F.col("out"))).first()[0] or 0
        if ways > most:
            break
        longer = edges.select("src", F.col("dst").alias("by")).join(edges.select(F.col("src").alias("by"), "dst"), "by").filter("src <> dst").select("src", "dst")
        both, told = save_measured(edges.unionByName(longer).distinct(), "graph", n=F.count(F.lit(1)))
        edges, before, n = both, n, told["n"]
        if n == before:
            break
    return edges


def _least_both_ways(edges: DataFrame) -> DataFrame:
    """id, came (the least id that reaches it), goes (the least that it reaches). Only what a round has lowered goes on to the next."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    yes = F.lit(True)
    label, told = save_measured(ids.select("id", F.col("id").alias("came"), F.col("id").alias("goes"), yes.alias("new_came"), yes.alias("new_goes")), "graph", n=F.count(F.lit(1)))
    none = F.lit(None).cast("string")
    while told["n"]:
        ahead = label.filter("new_came").select(F.col("id").alias("src"), "came").join(edges, "src").select(F.col("dst").alias("id"), F.col("came").alias("o_came"), none.alias("o_goes"))
        back = label.filter("new_goes").select(F.col("id").alias("dst"), "goes").join(edges, "dst").select(F.col("src").alias("id"), none.alias("o_came"), F.col("goes").alias("o_goes"))
        offered = ahead.unionByName(back).groupBy("id").agg(F.min("o_came").alias("o_came"), F.min("o_goes").alias("o_goes"))
        less = lambda c: F.coalesce(F.col(f"o_{c}") < F.col(c), F.lit(False))
        joined = label.join(offered, "id", "left").select("id", F.least("came", "o_came").alias("came"), F.least("goes", "o_goes").alias("goes"), less("came").alias("new_came"), less("goes").alias("new_goes"))
        before = label
        label, told = save_measured(joined, "graph", n=F.count_if(F.col("new_came") | F.col("new_goes")))
        drop_saved(before)
    return label
