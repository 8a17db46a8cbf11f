"""The registered queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprint, licenses, line_dedup, mixing, neardup, packing, painting, pii, sharding, token_file, topk, toxicity
from .common import pick, read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    labels = pick(read_table(spark, sf_dir, "labels"), "doc_id", "toxic").filter(~held_out)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50, asked against all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return topk.search(docs, pick(docs, "doc_id", "text").filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))


def op5_topk_search_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of ``benchmark``, asked against all documents."""
    asked = pick(read_table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    return topk.search(read_table(spark, sf_dir, "documents"), asked)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(read_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(read_table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op12_interval_painting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return painting.aggregate_changes(painting.presence(read_table(spark, sf_dir, "documents")), ["source", "lang"], 50)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii, op2_license_scan, op3_best_fit_packing, op4_toxicity, op5_topk_search, op5_topk_search_benchmark, op6_mixing, op7_fingerprints, op8_token_file, op9_sharding, op10_near_duplicates, op11_line_dedup, op12_interval_painting, op13_token_alignment)
    return {f.__name__: f for f in own}
