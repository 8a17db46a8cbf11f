"""A property graph as DataFrames, and the tables that follow from its nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import names

NODES = (
    "node_ord long, id string, name string, short string, file string, module string, grp string, line long, end_line long, kind string, class_name string, "
    "exported boolean, signature string, doc string, humanized string, descr string, loc long, chars long, numeric_ops long, tested boolean, test_depth long, "
    "in_degree long, out_degree long, legacy_reactive long, module_used boolean, nested boolean, parent string, lang string"
)
EDGES = "edge_ord long, src string, dst string, cnt long"


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: tables of a row a node or edge are exchanged between tasks.

    Left to itself, the planner goes by the bytes of the file and its share of columns, which for packed columns is far below
    what their rows take, and sends millions of nodes through the driver.
    """
    return df.hint("merge")


@dataclass(frozen=True)
class Graph:
    """``nodes`` and ``edges`` as given; every other table is derived unless it is given too."""

    nodes: DataFrame
    edges: DataFrame
    config: Config
    descriptions: DataFrame | None = None
    adrs: DataFrame | None = None
    given_module_nodes: DataFrame | None = None
    given_module_edges: DataFrame | None = None
    given_files: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @cached_property
    def module_nodes(self) -> DataFrame:
        """mod_ord, module, grp, file, fns: group and file are those of a module's first node."""
        if self.given_module_nodes is not None:
            return self.given_module_nodes
        first = F.min_by(F.struct("grp", "file"), "node_ord")
        rolled = self.nodes.groupBy("module").agg(F.min("node_ord").alias("mod_ord"), first.alias("f"), F.count("*").alias("fns"))
        return rolled.select("mod_ord", "module", "f.grp", "f.file", "fns")

    @cached_property
    def module_edges(self) -> DataFrame:
        """medge_ord, src, dst, cnt: calls between different modules, summed."""
        if self.given_module_edges is not None:
            return self.given_module_edges
        ends = self.edge_ends("module").filter("a_module <> b_module")
        return ends.groupBy(F.col("a_module").alias("src"), F.col("b_module").alias("dst")).agg(F.sum("cnt").alias("cnt"), F.min("edge_ord").alias("medge_ord"))

    @cached_property
    def files(self) -> DataFrame:
        if self.given_files is not None:
            return self.given_files
        by = self.nodes.groupBy("file").agg(F.min("node_ord").alias("file_ord"), F.min_by(F.struct("module", "grp"), "node_ord").alias("f"), F.count("*").alias("fns"))
        return by.select("file_ord", "file", "f.module", "f.grp", "fns")

    @cached_property
    def described(self) -> DataFrame:
        """Nodes with ``description`` and ``description_source``: curated text, else the doc's, else one inferred."""
        out = self.nodes
        if self.descriptions is None:
            out = out.withColumn("curated", F.lit(None).cast("string"))
        else:
            curated = self.descriptions.filter("scope = 'function'").select(F.col("key").alias("d_key"), F.col("text").alias("curated"))
            out = out.join(curated, F.concat("module", F.lit("::"), "short") == F.col("d_key"), "left").drop("d_key")
        has, inferred = F.col("curated") != "", F.coalesce(F.nullif(F.col("descr"), F.lit("")), F.col("humanized"))
        doc = F.coalesce(F.col("doc"), F.lit("")) != ""
        return out.withColumns({
            "description": F.when(has, F.col("curated")).when(doc, F.col("descr")).otherwise(inferred),
            "description_source": F.when(has, "curated").when(doc, "jsdoc").otherwise("inferred"),
        }).drop("curated")

    def edge_ends(self, *columns: str) -> DataFrame:
        """Edges with columns of both ends as a_<column> and b_<column>."""
        a = self.nodes.select(F.col("id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in columns])
        b = self.nodes.select(F.col("id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in columns])
        return self.edges.join(sorted_side(a), "src").join(sorted_side(b), "dst")

    def short_module(self, column: str = "module"):
        return names.short_module(F.col(column), self.config.namespace_prefix)

    def having(self, **changes) -> Graph:
        return replace(self, **changes)


def with_degrees(nodes: DataFrame, edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Nodes with in_degree and out_degree: the number of distinct edges, or the sum of their counts."""
    n = F.sum("cnt") if weighted else F.count("*")
    ins, outs = edges.groupBy(F.col("dst").alias("id")).agg(n.alias("in_degree")), edges.groupBy(F.col("src").alias("id")).agg(n.alias("out_degree"))
    return nodes.drop("in_degree", "out_degree").join(sorted_side(ins), "id", "left").join(sorted_side(outs), "id", "left").fillna(0, ["in_degree", "out_degree"])
