"""Aggregations that build and summarise a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def edge_counts(sites: DataFrame) -> DataFrame:
    """src, dst, cnt of call sites (src, dst), without calls of oneself or unknown ends."""
    known = sites.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return known.groupBy("src", "dst").agg(F.count("*").alias("cnt"))


def merge_edges(*parts: DataFrame) -> DataFrame:
    """Edges of several sources, added up."""
    out = parts[0].select("src", "dst", "cnt")
    for p in parts[1:]:
        out = out.unionByName(p.select("src", "dst", "cnt"))
    return out.filter("src <> dst").groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def merge_nodes(*parts: DataFrame) -> DataFrame:
    """Nodes of several sources; of one id the last source's node stays, at the place of the first."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("__source", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    last = out.groupBy("id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "id"]), F.struct("__source", "node_ord")).alias("n"), F.min(F.struct("__source", "node_ord")).alias("place"))
    columns = [c for c in out.columns if c not in ("id", "__source", "node_ord")]
    return last.select("id", *[F.col(f"n.{c}").alias(c) for c in columns], F.col("place.__source").alias("source"), F.col("place.node_ord").alias("node_ord"))


def stats(g: Graph) -> DataFrame:
    """files, functions, edges, modules."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(g.files, "files")
    for df, name in ((g.nodes, "functions"), (g.edges, "edges"), (g.module_nodes, "modules")):
        one = one.join(count(df, name))  # one row with one row
    return one


def module_coverage(g: Graph) -> DataFrame:
    """tested and total functions of every module, and the colour of their ratio."""
    own = g.nodes.filter(F.col("kind").isin("function", "method")).groupBy("module").agg(F.count_if(F.coalesce("tested", F.lit(False))).alias("tested"), F.count("*").alias("total"))
    m = g.module_nodes.select("module").join(own, "module", "left")
    ratio = F.col("tested") / F.col("total")
    colour = F.when(F.col("total").isNull(), "#3a4453").when(ratio > 0.66, "#7ee787").when(ratio > 0.2, "#f5a623").otherwise("#ff6b6b")
    return m.withColumn("color", colour).fillna(0, ["tested", "total"])


def group_census(g: Graph) -> DataFrame:
    return g.nodes.groupBy("grp").agg(F.count("*").alias("n"))


def depth_histogram(depths: DataFrame) -> DataFrame:
    """test_depth, n (null: not reached)."""
    return depths.groupBy("test_depth").agg(F.count("*").alias("n"))


def adjacency(g: Graph) -> DataFrame:
    """id, callees, callers in edge order, of known ends."""
    ends = g.edge_ends("id")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", c))), lambda x: x[c])
    outs, ins = ends.groupBy(F.col("src").alias("id")).agg(listed("dst").alias("callees")), ends.groupBy(F.col("dst").alias("id")).agg(listed("src").alias("callers"))
    none = F.array().cast("array<string>")
    return g.nodes.select("id").join(outs, "id", "left").join(ins, "id", "left").withColumns({"callees": F.coalesce("callees", none), "callers": F.coalesce("callers", none)})


def module_adjacency(g: Graph) -> DataFrame:
    """module, out, into: the modules that a module depends on and is used by, each in the order of the dependencies."""
    listed = lambda near, far, name: g.module_edges.groupBy(F.col(near).alias("module")).agg(F.transform(F.sort_array(F.collect_list(F.struct("medge_ord", far))), lambda x: x[far]).alias(name))
    none = F.array().cast("array<string>")
    both = g.module_nodes.select("module").join(listed("src", "dst", "out"), "module", "left").join(listed("dst", "src", "into"), "module", "left")
    return both.select("module", F.coalesce("out", none).alias("out"), F.coalesce("into", none).alias("into"))
