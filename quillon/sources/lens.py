"""A graph over the star schema: parts are functions, parts that follow each other in an order are calls, brands are modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, Rule
from ..functions import names
from ..graph import Graph, with_degrees

LAYERS = {"core": 0, "utils": 1, "services": 2, "systems": 3, "stores": 4, "components": 5, "dev": -1}
CONFIG = Config(
    name="lens", namespace_prefix="lib", layers=LAYERS, god_functions=80,
    rules=(
        Rule("ADR-001", "forbidden-callee-module", "error", module="lib/core/Brand6", allow_from=("lib/core/Brand12", "lib/utils/Brand1")),
        Rule("ADR-002", "restricted-callee", "warn", callees=("bolt11", "gear11", "plate11", "ring11", "rod11", "widget11", "bolt17", "ring18"), allow_from=("bolt1", "gear2", "plate8", "ring9", "core/Brand6::ring18")),
        Rule("ADR-003", None, checkable=False),
    ),
)
ADRS = [("ADR-001", "Core stays closed"), ("ADR-004", "No cycles"), ("ADR-005", "Small modules")]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, brand = F.col("p_partkey"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    words = F.split("p_name", " ")
    groups = F.array(*[F.lit(x) for x in ("core", "utils", "services", "systems", "stores", "components")])
    p = p.select("*", brand.alias("bn"), F.get(words, F.lit(0)).alias("w1"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("w2"))
    p = p.withColumn("grp", F.when(F.col("bn") == 25, "dev").otherwise(F.get(groups, F.col("bn") % 6)))
    p = p.withColumn("kind", F.when(key % 8 <= 3, "function").when(key % 8 == 4, "method").when(key % 8 == 5, "accessor").when(key % 8 == 6, "component").otherwise("store"))
    owned, num = F.col("kind").isin("method", "accessor"), (key % 300).cast("string")
    short = (
        F.when(owned, F.concat("w1", F.lit("."), "w2", num)).when((F.col("kind") == "function") & (key % 16 == 1), F.concat("w1", F.lit("."), "w2"))
        .when(F.col("kind") == "function", F.concat("w2", num)).otherwise(F.concat("w1", key.cast("string")))
    )
    module = F.concat(F.lit("lib/"), "grp", F.lit("/Brand"), F.col("bn").cast("string"))
    out = p.select(
        key.cast("long").alias("node_ord"), F.concat(F.lit("part/"), key.cast("string")).alias("id"), short.alias("short"), module.alias("module"), "grp", "kind",
        F.when(owned, F.col("w1")).alias("class_name"), (F.col("p_size") % 2 == 0).alias("exported"), (F.col("p_size") == 50).alias("tested"), (F.col("p_size") == 1).alias("module_used"),
        (key % 13 == 0).alias("nested"), (F.col("p_size") * 3).cast("long").alias("loc"), F.floor("p_retailprice").cast("long").alias("chars"), (key % 11).cast("long").alias("numeric_ops"),
        F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(" "), "p_name")).otherwise("").alias("doc"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Handle "), "p_name", F.lit("."))).alias("descr"),
        F.when(F.col("kind") == "component", key % 4).otherwise(0).cast("long").alias("legacy_reactive"),
    )
    return out.withColumns({
        "name": F.col("short"), "file": F.concat(F.lit("src/"), "module", F.lit(".ts")), "line": F.col("node_ord"), "humanized": names.humanize(F.col("short")), "signature": F.concat("short", F.lit("()")),
    })


def call_sites(spark: SparkSession, sf_dir: str, q: int, until: str | None = None) -> DataFrame:
    """src, dst of every pair of parts that follow each other in an order with quantities of at least ``q``."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(F.col("l_quantity") >= q)
    if until:
        items = items.filter(F.col("l_shipdate") < F.lit(until).cast("timestamp"))
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = items.select(F.col("l_partkey").alias("a"), after.alias("b"))
    return pairs.select("a", "b", F.concat(F.lit("part/"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("part/"), F.col("b").cast("string")).alias("dst"))


def edges(spark: SparkSession, sf_dir: str, q: int, until: str | None = None) -> DataFrame:
    """Calls by both ends; their numbers order them by the ends' keys."""
    sites = call_sites(spark, sf_dir, q, until).filter("b IS NOT NULL AND a <> b")
    out = sites.groupBy("a", "b").agg(F.count("*").alias("cnt"))
    number = (F.col("a") * 10_000_000_000 + F.col("b")).cast("long")
    return out.select(number.alias("edge_ord"), F.concat(F.lit("part/"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("part/"), F.col("b").cast("string")).alias("dst"), "cnt")


def descriptions(n: DataFrame) -> DataFrame:
    f = n.filter("node_ord % 17 = 0").select(F.lit("function").alias("scope"), F.concat("module", F.lit("::"), "short").alias("key"), F.concat(F.lit("Curated note on "), "short").alias("text")).distinct()
    m = n.filter("module LIKE '%5'").select(F.lit("module").alias("scope"), F.col("module").alias("key"), F.concat(F.lit("Curated text of "), "module").alias("text")).distinct()
    return f.unionByName(m)


def graph(spark: SparkSession, sf_dir: str, q: int = 40, until: str | None = None) -> Graph:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir, q, until)
    adrs = spark.createDataFrame(ADRS, "id string, title string")
    return Graph(with_degrees(n, e), e, CONFIG, descriptions=descriptions(n), adrs=adrs)
