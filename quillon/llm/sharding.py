"""Proportional stratified interleaving of documents into shards (operator 9). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, global_index, pick


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Puts every document into one of ``shards`` shards so that each matches the mixture of sources.

    Rows are ranked within their source in the order of a seeded hash; sorting all rows by their rank as a fraction of
    the source's rows interleaves the sources in proportion, and equal cuts of that order are the shards. The law is
    ``rows``: counts of two shards differ by one at most. Both orders come from range exchanges of the few columns
    needed, so a source with a third of all rows is cut between partitions like any other rows.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot, grown_shard (null: not this law's).
    Defined results: null texts have size 1 and the crc of no bytes; null sources are a source; null doc_ids and
    repeated rows are rows like others; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "source", "text").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull()).alias("shuffled"),
    )
    last = [F.asc_nulls_last("doc_id"), "size", "text_crc32"]
    ranked = global_index(rows, [F.asc_nulls_last("source"), "shuffled", *last], "strata")
    sources = ranked.groupBy("source").agg(F.min("idx").alias("first"), F.count("*").alias("n")).withColumnRenamed("source", "of")
    ranked = ranked.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("fraction", (F.col("idx") - F.col("first") + 0.5) / F.col("n"))
    keys = ["fraction", F.asc_nulls_last("source"), "shuffled", *last]
    dealt = global_index(ranked.select("doc_id", "source", "size", "text_crc32", "shuffled", "fraction"), keys, "shards")
    drop_saved(ranked)
    n = max(1, dealt.count())
    shard = F.expr(f"(idx * {shards}) div {n}")
    return dealt.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("idx") - F.expr(f"(cast(shard as long) * {n} + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
