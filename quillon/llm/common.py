"""Helpers shared by the training-data operators: column picking, tables in the shared folder, global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_saved, global_index, new_path, reach_workers, save, shared_dir

__all__ = ["drop_saved", "global_index", "new_path", "pick", "packed_row", "reach_workers", "read_table", "save", "shared_dir", "unpacked"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling, whatever else ``df`` has (names that differ only in case included)."""
    reach_workers(df.sparkSession)
    columns = df.columns
    numbered = df.toDF(*[f"__c{i}" for i in range(len(columns))])
    return numbered.select(*[F.col(f"__c{columns.index(n)}").alias(n) for n in names])


def packed_row(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` as one struct column ``__row`` beside copies of the named columns; ``unpacked`` gives the columns back."""
    reach_workers(df.sparkSession)
    columns = df.columns
    numbered = df.toDF(*[f"__c{i}" for i in range(len(columns))])
    keys = [F.col(f"__c{columns.index(n)}").alias(f"__k_{n}") for n in names]
    return numbered.select(F.struct(*numbered.columns).alias("__row"), *keys), columns


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"__row.__c{i}").alias(f"__c{i}") for i in range(len(columns))]).toDF(*columns)
