"""Stored graphs: JSON documents in, ordinal tables; snapshots, registry and reports out."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator, Mapping
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..graph import EDGES, NODES, Graph
from ..shared import new_path, reach_workers

_NODE = (
    "id string, name string, short string, file string, module string, group string, line long, endLine long, kind string, className string, exported boolean, signature string, "
    "doc string, humanized string, desc string, loc long, chars long, numeric long, tested boolean, testDepth long, inDegree long, outDegree long, legacyReactive long, "
    "moduleUsed boolean, nested boolean, parent string, lang string"
)
_EDGE = "`from` string, `to` string, count long"


def raw_schema():
    from pyspark.sql import types as T

    kinds = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "int": T.IntegerType()}
    fields = lambda ddl: T.StructType([T.StructField(n.strip("`"), kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])
    listed = lambda ddl: T.ArrayType(fields(ddl))
    texts = T.MapType(T.StringType(), T.StringType())
    rule = fields("adr string, type string, severity string, msg string, module string, callee string, checkable boolean")
    rule = rule.add("allowFrom", T.ArrayType(T.StringType())).add("callees", T.ArrayType(T.StringType()))
    config = T.StructType().add("layers", T.MapType(T.StringType(), T.IntegerType())).add("godFunctions", T.IntegerType()).add("namespacePrefix", T.StringType()).add("adrRules", T.ArrayType(rule))
    out = fields("generatedAt string, project string, root string, host string, commit string, dirty boolean")
    out = out.add("adrs", listed("id string, title string")).add("nodes", listed(_NODE)).add("edges", listed(_EDGE))
    out = out.add("moduleNodes", listed("module string, group string, file string, fns long")).add("moduleEdges", listed(_EDGE)).add("files", listed("file string, module string, group string, fns long, lang string"))
    return out.add("descriptions", T.StructType().add("groups", texts).add("modules", texts).add("functions", texts)).add("config", config)


def read(spark: SparkSession, path: str) -> Graph:
    """A stored graph document as tables; the order of its arrays becomes ``*_ord`` columns."""
    raw = spark.read.schema(raw_schema()).option("multiLine", True).json(path)
    at = lambda array, number, **names: raw.select(F.posexplode(array).alias("p", "x")).select(F.col("p").cast("long").alias(number), *[F.col(f"x.{v}").alias(k) for k, v in names.items()])
    nodes = at(
        "nodes", "node_ord", id="id", name="name", short="short", file="file", module="module", grp="group", line="line", end_line="endLine", kind="kind", class_name="className", exported="exported",
        signature="signature", doc="doc", humanized="humanized", descr="desc", loc="loc", chars="chars", numeric_ops="numeric", tested="tested", test_depth="testDepth", in_degree="inDegree",
        out_degree="outDegree", legacy_reactive="legacyReactive", module_used="moduleUsed", nested="nested", parent="parent", lang="lang",
    )
    ends = {"src": "from", "dst": "to", "cnt": "count"}
    texts = [raw.select(F.lit(scope).alias("scope"), F.explode(F.col(f"descriptions.{scope}s")).alias("key", "text")) for scope in ("group", "module", "function")]
    told = raw.select(F.to_json("config").alias("c"), "project").first()
    config = Config.parse(json.loads(told["c"] or "{}") | {"name": told["project"] or "project"})
    return Graph(
        nodes, at("edges", "edge_ord", **ends), config, descriptions=texts[0].unionByName(texts[1]).unionByName(texts[2]), adrs=raw.select(F.explode("adrs").alias("a")).select("a.id", "a.title"),
        given_module_nodes=at("moduleNodes", "mod_ord", module="module", grp="group", file="file", fns="fns"), given_module_edges=at("moduleEdges", "medge_ord", **ends),
        given_files=at("files", "file_ord", file="file", module="module", grp="group", fns="fns"),
    )


def list_graphs(folder: str) -> list[str]:
    """Names of the stored graphs of a folder, snapshots left out."""
    found = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    return [f.removesuffix(".json") for f in found if f.endswith(".json") and not f.endswith(".snapshot.json")]


#: Columns whose keys in a document differ from their names (fixed values of the format).
_KEYS = {
    "grp": "group", "end_line": "endLine", "class_name": "className", "descr": "desc", "numeric_ops": "numeric", "test_depth": "testDepth", "in_degree": "inDegree", "out_degree": "outDegree",
    "legacy_reactive": "legacyReactive", "module_used": "moduleUsed", "src": "from", "dst": "to", "cnt": "count",
}


def _arrays(g: Graph) -> dict[str, tuple[DataFrame, str]]:
    """The tables that are arrays of a document, in its order, and their columns of order."""
    return {
        "nodes": (g.nodes, "node_ord"), "edges": (g.edges.select("edge_ord", "src", "dst", "cnt"), "edge_ord"), "moduleNodes": (g.module_nodes, "mod_ord"),
        "moduleEdges": (g.module_edges.select("medge_ord", "src", "dst", "cnt"), "medge_ord"), "files": (g.files, "file_ord"),
    }


def _json_rows(df: DataFrame, order: str, drop_nulls: bool) -> DataFrame:
    """value: each row as JSON, in files whose names follow the order; tasks write them out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [{_KEYS.get(k, k): v for k, v in r.items() if k != order and (v is not None or not drop_nulls or k in ("class_name", "test_depth"))} for r in batch.to_pylist()]
            yield pa.record_batch([pa.array([json.dumps(r, ensure_ascii=False) for r in told], pa.string())], names=["value"])

    reach_workers(df.sparkSession)
    return df.orderBy(order).mapInArrow(rows, "value string")


def _about(g: Graph, meta: Mapping[str, Any]) -> dict:
    """What a document tells beside its tables."""
    c = g.config
    rule = lambda r: {"adr": r.adr, "type": r.type, "severity": r.severity, "msg": r.msg, "module": r.module, "allowFrom": list(r.allow_from), "callees": list(r.callees), "checkable": r.checkable}
    told = {"layers": dict(c.layers), "godFunctions": c.god_functions, "namespacePrefix": c.namespace_prefix, "adrRules": [rule(r) for r in c.rules]}
    counts = {k: _arrays(g)[a][0].count() for k, a in (("files", "files"), ("functions", "nodes"), ("edges", "edges"), ("modules", "moduleNodes"))}
    adrs = [r.asDict() for r in g.adrs.collect()] if g.adrs is not None else []  # headings of one text
    return dict(meta) | {"project": c.name, "config": told, "adrs": adrs, "stats": counts}


def write(g: Graph, path: str, **meta: Any) -> None:
    """Writes a graph document to a local path, whole or not at all: a temporary file takes the old one's place.

    Tasks write the rows of each array as JSON, in order, to files of the shared folder; these are copied one behind another
    into the document, a buffer at a time, so no rows are collected.
    """
    spark, own = g.nodes.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    folder = new_path(spark, "document")
    with open(own, "wb") as out:
        out.write(json.dumps(_about(g, meta), ensure_ascii=False).encode()[:-1])
        for name, (df, order) in _arrays(g).items():
            _json_rows(df, order, name == "nodes").write.text(f"{folder}/{name}")
            out.write(f', "{name}": ['.encode())
            _copy_lines(f"{folder}/{name}", out)
            out.write(b"]")
        out.write(b"}")
    os.replace(own, path)


def _copy_lines(folder: str, out: BinaryIO) -> None:
    """Copies the lines of a folder's files, in the order of their names, with commas between them."""
    store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("part-") and f.size)
    for i, name in enumerate(files):
        out.write(b", " if i else b"")
        held = b""  # a line's end is written when another line follows
        with store.open_input_stream(name) as f:
            while buffer := f.read(1 << 20):
                text = held + buffer
                held = b"\n" if text.endswith(b"\n") else b""
                out.write(text[: len(text) - len(held)].replace(b"\n", b", "))


def write_tables(g: Graph, folder: str, label: str) -> None:
    """Writes the tables of a graph as Parquet below ``folder/label`` (a snapshot, or the current state)."""
    for name, df in (("nodes", g.nodes), ("edges", g.edges), ("module_nodes", g.module_nodes), ("module_edges", g.module_edges), ("files", g.files)):
        df.write.mode("overwrite").parquet(f"{folder}/{label}/{name}")


def read_tables(spark: SparkSession, folder: str, label: str, config: Config) -> Graph:
    t = lambda name: spark.read.parquet(f"{folder}/{label}/{name}")
    return Graph(t("nodes"), t("edges"), config, given_module_nodes=t("module_nodes"), given_module_edges=t("module_edges"), given_files=t("files"))


REGISTRY = "name string, path string, kind string, machine string, ts_host string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registered projects of a JSON file ({"projects": [...]}); none where there is no file."""
    told = {}
    if os.path.exists(path):
        with open(path) as f:
            told = json.load(f)
    rows = [(p.get("name"), p.get("path"), p.get("kind"), p.get("machine"), p.get("tsHost")) for p in told.get("projects") or ()]
    return spark.createDataFrame(rows, REGISTRY)


def write_registry(registry: DataFrame, path: str) -> None:
    """Writes the registered projects, whole or not at all."""
    back = {"ts_host": "tsHost"}
    projects = [{back.get(k, k): v for k, v in r.asDict().items() if v is not None} for r in registry.orderBy("name").collect()]
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "w") as f:
        json.dump({"projects": projects}, f, indent=2, ensure_ascii=False)
    os.replace(own, path)


def snapshot(folder: str, name: str) -> str:
    """Copies the current graph of a project to its snapshot, whole or not at all."""
    target = f"{folder}/{name}.snapshot.json"
    own = f"{target}.{uuid.uuid4().hex}.tmp"
    shutil.copyfile(f"{folder}/{name}.json", own)
    os.replace(own, target)
    return target


def register(registry: DataFrame, entry: Mapping[str, Any]) -> DataFrame:
    """The registry (name, path, kind, machine, ts_host) with an entry added or, by its name, changed; what it leaves out stays."""
    columns = ("name", "path", "kind", "machine", "ts_host")
    new = registry.sparkSession.createDataFrame([tuple(entry.get(c) for c in columns)], ", ".join(f"{c} string" for c in columns))
    joined = registry.alias("o").join(new.alias("n"), "name", "full_outer")
    return joined.select("name", *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"), F.lit("code") if c == "kind" else F.lit(None)).alias(c) for c in columns[1:]])


def empty(spark: SparkSession, config: Config) -> Graph:
    return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), config)
