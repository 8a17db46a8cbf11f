"""What changed between two snapshots of a graph, and whether a stored graph is out of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..graph import Graph
from . import rollups


def modules(base: Graph, current: Graph) -> DataFrame:
    """module, change (added or removed), fns."""
    b, c = base.module_nodes.select("module", "fns"), current.module_nodes.select("module", "fns")
    both = b.withColumnRenamed("fns", "was").join(c.withColumnRenamed("fns", "now"), "module", "full_outer")
    one = both.filter("was IS NULL OR now IS NULL")
    return one.select("module", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"), F.coalesce("now", "was").alias("fns"))


def sizes(base: Graph, current: Graph) -> DataFrame:
    """module, was, now, delta, now_god of modules whose number of functions changed."""
    god = current.config.god_functions
    b, c = base.module_nodes.select("module", F.col("fns").alias("was")), current.module_nodes.select("module", F.col("fns").alias("now"))
    return b.join(c, "module").filter("was <> now").withColumns({"delta": F.abs(F.col("now") - F.col("was")), "now_god": (F.col("now") > god) & (F.col("was") <= god)})


def dependencies(base: Graph, current: Graph) -> DataFrame:
    """src, dst, change of module dependencies that are new or gone, whatever their counts."""
    b, c = base.module_edges.select("src", "dst"), current.module_edges.select("src", "dst")
    return c.subtract(b).withColumn("change", F.lit("new")).unionByName(b.subtract(c).withColumn("change", F.lit("gone")))


def totals(base: Graph, current: Graph) -> DataFrame:
    """what, was, now, delta (signed text) of functions, edges and modules."""
    kinds = ("functions", "edges", "modules")
    long = lambda g, name: rollups.stats(g).select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(k).alias(name)) for k in kinds])).alias("s")).select("s.*")
    return long(base, "was").join(long(current, "now"), "what").withColumn("delta", names.signed(F.col("now") - F.col("was")))


def changed_files_stale(changed: DataFrame, files: DataFrame, extensions: list[str], built: Column) -> DataFrame:
    """Of the changed paths (path, mtime; null: deleted) those that are known files or have a known suffix, and are newer than the graph or gone."""
    known = files.select(F.col("file").alias("path")).distinct().withColumn("known", F.lit(True))
    covered = changed.join(known, "path", "left").filter(F.coalesce("known", F.lit(False)) | names.extension(F.col("path")).isin(*extensions))
    return covered.filter(F.col("mtime").isNull() | (F.col("mtime") > built)).drop("known")


def is_stale(meta: DataFrame, stale_files: DataFrame) -> DataFrame:
    """stale and the reason, from one row (kind, has_git, has_graph, graph_commit, head_commit, built_dirty, dirty_now) and the stale files."""
    n = stale_files.agg(F.count("*").alias("n_stale"))
    reason = (
        F.when(F.col("kind") == "filesystem", "filesystem").when(~F.col("has_git"), "no git").when(~F.col("has_graph"), "no graph").when(F.col("graph_commit").isNull(), "no stamp")
        .when(F.col("graph_commit") != F.col("head_commit"), "commit").when(F.col("built_dirty") & ~F.col("dirty_now"), "cleaned").when(F.col("n_stale") > 0, "files").otherwise("fresh")
    )
    return meta.join(n).withColumn("reason", reason).withColumn("stale", F.col("reason").isin("commit", "cleaned", "files"))
