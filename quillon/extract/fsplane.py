"""A folder tree as a graph: files are nodes, links between notes and dependencies between units are edges."""

from __future__ import annotations

import contextlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import names
from ..graph import Graph, with_degrees
from ..operators import rollups
from ..shared import global_index, local_part, reach_workers, save


@dataclass(frozen=True)
class FsConfig:
    name: str = "files"
    host: str = "local"
    ignore: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    name_globs: tuple[str, ...] = ()
    most_bytes: int = 1 << 20
    stale_days: int = 90


#: Layers of the kinds of files.
LAYERS = {"config": 0, "data": 0, "scripts": 1, "systemd": 2, "docs": 3, "notes": 4, "other": 0}


def kept(files: DataFrame, config: FsConfig) -> DataFrame:
    """The files (path) that no ignore glob matches, neither by themselves nor by a folder above them, and that a filter keeps."""
    path = F.col("path")
    return files.filter(~names.ignored(path, list(config.ignore)) & names.keep_file(path, list(config.extensions), list(config.name_globs)))


def _children(uri: str, folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """(name, whether a folder, size, seconds of the last change) of what a folder holds, links left out."""
    if uri.startswith("file:"):
        with os.scandir(os.path.join(local_part(uri), folder)) as entries:
            for e in entries:
                if not e.is_symlink():
                    stat = e.stat()
                    yield e.name, e.is_dir(), stat.st_size, stat.st_mtime
        return
    store, base = fs.FileSystem.from_uri(uri)
    for info in store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/"))):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, info.mtime.timestamp() if info.mtime else 0.0


def _uri(spark: SparkSession, root: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()


def listing(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), label: str = "level") -> DataFrame:
    """path, size, mtime of all files below a root. Links are left out, as is what can't be read.

    The tree is listed level by level: tasks list the folders of a level, drop what an ignore glob matches before they go
    down, and hand on files and folders as a table; the driver learns whether there is a further level, and no names. The
    root has to be a folder that the executors see.
    """
    uri, skip = _uri(spark, root), "|".join(map(names.glob_pattern, ignore))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ignored = re.compile(skip) if skip else None
        for batch in batches:
            found = []
            for folder in batch.column(0).to_pylist():
                with contextlib.suppress(OSError):
                    for name, is_folder, size, mtime in _children(uri, folder):
                        path = f"{folder}/{name}" if folder else name
                        if not (ignored and ignored.search(path)):
                            found.append((path, is_folder, size, int(mtime * 1_000_000)))
            yield pa.record_batch([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["path", "is_folder", "size", "micros"])

    reach_workers(spark)
    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = save(level.mapInArrow(rows, "path string, is_folder boolean, size long, micros long"), label)
        levels.append(found.filter("NOT is_folder").select("path", "size", F.timestamp_micros("micros").alias("mtime")))
        folders = found.filter("is_folder").select("path")
        if folders.isEmpty():
            break
        level = folders.repartition("path")  # what a folder holds may be uneven, so its folders are dealt anew
    out = levels[0]
    for further in levels[1:]:
        out = out.unionByName(further)
    return out


def walk(spark: SparkSession, root: str, config: FsConfig, content: bool = True) -> DataFrame:
    """path, size, mtime (and text of files that aren't too large) of the kept files of a folder tree; links are not followed.

    Tasks list the folders and read the texts. The guard on the size stands before the reading, so large files aren't read.
    """
    listed = kept(listing(spark, root, config.ignore), config)
    if not content:
        return listed
    uri, most = _uri(spark, root), config.most_bytes

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = None if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
        for batch in batches:
            for i, (path, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = None
                if size <= most:
                    with contextlib.suppress(OSError):
                        if store:
                            with store[0].open_input_file(f"{store[1].rstrip('/')}/{path}") as f:
                                text = f.read()
                        else:
                            with open(os.path.join(local_part(uri), path), "rb") as f:
                                text = f.read()
                row = batch.slice(i, 1)
                yield pa.record_batch([*row.columns, pa.array([text.decode("utf-8", "replace") if text is not None else None], pa.string())], names=["path", "size", "mtime", "text"])

    reach_workers(spark)
    # the files of a listing are few bytes each: deal them out, so that their texts are read by many tasks
    return save(listed.select("path", "size", "mtime").repartition("path"), "files").mapInArrow(texts, "path string, size long, mtime timestamp, text string")


def _targets(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("dst"), names.base_name(F.col("path")).alias("base"))


def _notes(files: DataFrame) -> DataFrame:
    return files.filter(names.categorize(F.col("path")).isin("docs", "notes"))


def wiki_edges(files: DataFrame) -> DataFrame:
    """path, dst: a row for each link by name and each file of that name, else of the name with .md, else with .mdx."""
    wiki = _notes(files).select("path", F.posexplode(names.wiki_links(F.col("text"))).alias("at", "name")).withColumn("name", F.trim("name"))
    spelled = F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), F.concat("name", F.lit(s)).alias("base")) for i, s in enumerate(("", ".md", ".mdx"))]))
    tried = wiki.withColumn("t", spelled).select("path", "at", "t.tier", "t.base").join(_targets(files), "base")
    best = tried.groupBy("path", "at").agg(F.min("tier").alias("tier"))
    return tried.join(best, ["path", "at", "tier"], "left_semi").select("path", "dst")


def path_edges(files: DataFrame) -> DataFrame:
    """path, dst: a row for each Markdown link whose path, from the folder of the note, is a file."""
    href = _notes(files).select("path", F.explode(names.md_links(F.col("text"))).alias("href"))
    where = names.normal_path(F.concat(names.dir_name(F.col("path")), F.lit("/"), "href"))
    return href.withColumn("dst", where).join(_targets(files).select("dst"), "dst", "left_semi").select("path", "dst")


def unit_edges(files: DataFrame) -> DataFrame:
    """path, dst: a row for each dependency of a unit and each file of its name."""
    units = files.filter(names.categorize(F.col("path")) == "systemd")
    return units.select("path", F.explode(names.unit_links(F.col("text"))).alias("base")).join(_targets(files), "base").select("path", "dst")


def links(files: DataFrame) -> DataFrame:
    """src, dst, cnt: wiki links, Markdown links, dependencies of units."""
    found = wiki_edges(files).unionByName(path_edges(files)).unionByName(unit_edges(files))
    return rollups.edge_counts(found.withColumnRenamed("path", "src"))


def graph(files: DataFrame, config: FsConfig, now: Column) -> Graph:
    """The graph of a folder tree (path, size, mtime, text) at a moment; degrees are sums of link counts.

    Nodes are numbered by path, folder by folder, and edges by both ends.
    """
    days = names.stale_days(F.col("mtime"), now)
    base = names.base_name(F.col("path"))
    nodes = files.select(
        F.col("path").alias("id"), base.alias("name"), base.alias("short"), F.col("path").alias("file"), names.dir_name(F.col("path")).alias("module"),
        names.categorize(F.col("path")).alias("grp"), F.lit(0).cast("long").alias("line"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("class_name"), F.lit(False).alias("exported"),
        F.lit("").alias("signature"), F.lit("").alias("doc"), base.alias("humanized"), F.concat(names.fmt_size(F.col("size")), F.lit(" · "), days.cast("string"), F.lit("d since edit")).alias("descr"),
        F.col("size").alias("loc"), F.col("size").alias("chars"), days.alias("numeric_ops"), F.lit(False).alias("tested"), F.lit(config.host).alias("host"), F.col("size").alias("size_bytes"), "mtime",
        days.alias("stale_days"), (days >= config.stale_days).alias("stale"),
    )
    nodes = global_index(nodes, [F.split("id", "/")], "fs-nodes", "node_ord")
    at = nodes.select("id", "node_ord")
    edges = links(files).join(at.select(F.col("id").alias("src"), F.col("node_ord").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("node_ord").alias("b")), "dst")
    edges = global_index(edges, ["a", "b"], "fs-edges", "edge_ord").select("edge_ord", "src", "dst", "cnt")
    settings = Config(name=config.name, layers=LAYERS, god_functions=0)
    return Graph(with_degrees(nodes, edges, weighted=True), edges, settings)
