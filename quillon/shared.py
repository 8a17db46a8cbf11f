"""Tables in the folder that the driver and all executors share, and numbers that follow an order."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (a cluster gets it with --py-files as well)."""
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), here]))


def local_part(path: str) -> str:
    """A path without scheme and authority, as it stands in the paths that a scan returns, with a slash behind it."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/") + "/"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary one; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str, path: str | None = None, **options: object) -> DataFrame:
    """Writes ``df`` (``options``: the writer's) to the shared folder and reads it back: cuts lineage, survives lost executors, and its size is known to the planner."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["saved_at"] = path
    return out


def save_measured(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``save``, and aggregates of the rows that are taken while they are written, which spares a job that would read them again."""
    seen = Observation()
    out = save(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), label)
    return out, seen.get


def drop_saved(*tables: DataFrame) -> None:
    """Deletes tables of ``save`` that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.get("saved_at"):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):  # the folder is scratch: what stays there is not an error
                where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def global_index(df: DataFrame, keys: Sequence[Column | str], label: str, name: str = "idx") -> DataFrame:
    """``df`` with ``name``, the row's number from 0 in the order of ``keys``, as a saved table.

    A range exchange sorts the rows; each partition's rows are counted, and only those counts (one a partition) meet
    and are broadcast. Rows with equal keys are cut between partitions by a number that each has from where it was read.
    """
    keys = [*keys, "__nth"]
    placed = (
        df.withColumn("__nth", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("__nth")
        .withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    )
    table = save(placed, label)
    sizes = table.groupBy("__pid").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__pid", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    out = table.join(F.broadcast(starts), "__pid").withColumn(name, F.col("__before") + F.col("__at"))
    out = out.drop("__pid", "__at", "__before")
    out.__dict__["saved_at"] = table.__dict__["saved_at"]
    return out
