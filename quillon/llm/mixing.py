"""Mixing sources to target weights by systematic sampling (operator 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_index, packed_row, pick, save, unpacked

#: No source is taken more often than this.
MOST = 3


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target from a row per source (source, source_size).

    Weights repeat over the sources by code point, null last, and share all sizes; no target exceeds ``most`` times its
    source. What is cut off is shared by weight until none is above, which is a common level per weight: sources are
    sorted by the level at which they are full, and the level of the others follows from running sums.
    """
    named = Window.orderBy(F.asc_nulls_last("source"))
    full = Window.orderBy("level", F.asc_nulls_last("source"))
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("level", (most * F.col("source_size") / F.col("weight")).cast("double"))
    s = s.withColumns({
        "all_size": F.sum("source_size").over(everything),
        "size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # with all earlier sources full, the rest would rise to this level
    s = s.withColumn("rise", (F.col("all_size") - most * F.col("size_before")) / F.col("weight_left"))
    # the first source not full at that level tells it; each later row takes more sources for full and is lower
    level = F.max(F.when(F.col("rise") <= F.col("level"), F.col("rise"))).over(everything)
    target = F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _offset(seed: int, source: Column) -> Column:
    """A number from 0 to 1 that the seed and the source decide."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0001null"))).cast("binary"))
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _copies(rows: DataFrame, weights: Sequence[int], most: int, seed: int, label: str) -> DataFrame:
    """``rows`` (doc_id, source, size, told and whatever else they carry) with source_size, target and copies."""
    ranked = global_index(rows, [F.asc_nulls_last("source"), "size", F.asc_nulls_last("doc_id"), "told"], label)
    sources = ranked.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("idx").alias("first"))
    aims = targets(sources.select("source", "source_size"), weights, most).withColumnRenamed("source", "aim_of")
    aims = save(aims.join(sources.select(F.col("source").alias("of"), "first"), F.col("aim_of").eqNullSafe(F.col("of"))).drop("of"), "aims")
    out = ranked.join(aims, F.col("source").eqNullSafe(F.col("aim_of")))
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rank, start = F.col("idx") - F.col("first"), _offset(seed, F.col("source"))
    copies = (F.floor(start + (rank + 1) * expected) - F.floor(start + rank * expected)).cast("int")
    return out.withColumn("copies", F.least(copies, F.lit(most)))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST, seed: int = 42) -> DataFrame:
    """How often the mix takes every document.

    Within its source a document is expected ``target / source_size`` times; with the running sum of these, shifted by
    one random offset a source, it is taken once for every whole number crossed. The running order goes by size, so
    that what is taken of each size, and hence of words, comes near the target. The order comes from one range exchange
    over (source, size, doc_id), which cuts a hot source between partitions; all else are sums a source.

    Returns doc_id, source, size (words), source_size, target, copies, taken (copies * size). Reruns agree.
    Defined results: null texts have size 0; null sources are one source, the last by code point; a source of no words has
    target 0 and is taken no times; null doc_ids and repeated rows are rows like others; an empty table gives no rows;
    other columns are ignored.
    """
    rows = pick(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("told"))
    out = _copies(rows, weights, most, seed, "mix")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST, seed: int = 42) -> DataFrame:
    """The documents themselves, each as often as ``mix`` takes it, with the columns of ``docs``.

    Rows take part in the range exchange whole and so carry their own copies: nothing is joined by doc_id. Defined
    results: those of ``mix``; rows that repeat a doc_id or have none are taken as often as each of them is.
    """
    rows, columns = packed_row(docs, "doc_id", "source", "text")
    text = F.col("__k_text")
    rows = rows.select("__row", F.col("__k_doc_id").alias("doc_id"), F.col("__k_source").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("told"))
    taken = _copies(rows, weights, most, seed, "mixed").filter("copies > 0")
    return unpacked(taken.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("copies")))), columns)
