"""Documents as token ids in a compressed binary file set, and back (operator 8)."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from .common import drop_saved, new_path, pick, save
from .tokens import default_tokenizer, encoder

#: Ids a block holds before the next one begins; a longer document is a block of its own.
BLOCK_IDS = 1 << 18


def _cell(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int | None, cell: str) -> DataFrame:
    """doc_id, told (a hash of the text), nth (a number that no other row has), ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth = encoder(tokenizer), TaskContext.get().partitionId() << 33
        end = np.array([] if end_id is None else [end_id], dtype=cell).tobytes()
        for batch in batches:
            ids = [np.frombuffer(encode(t), "<u4").astype(cell).tobytes() + end for t in batch.column(2).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "told": batch.column(1), "nth": pa.array(np.arange(nth, nth + len(ids))), "ids": pa.array(ids, pa.binary())})
            nth += len(ids)

    hashed = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("told"), "text")
    return hashed.mapInArrow(rows, "doc_id long, told long, nth long, ids binary")


def _counts(table: DataFrame, cell: str) -> dict[int, int]:
    """Occurrences of every id over all documents; at most one row per vocabulary entry reaches the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), cell), minlength=len(total))
            found[: len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used), "n": pa.array(total[used])})

    tallied = table.select("ids").mapInArrow(tally, "id long, n long")
    return {r["id"]: r["n"] for r in tallied.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_token_file(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2, limit: int = huffman.LIMIT) -> None:
    """Encodes every whole text, appends ``end_id`` (None: nothing) and writes the ids in ascending doc_id order.

    ``path`` gets three Parquet tables: ``blocks`` (part, before: ids of the part before the block, n_ids, block: the binary
    layout of ``huffman``), ``codebook`` (the code lengths of all ids, from counts over the whole input) and ``parts``
    (part, start: ids of all earlier parts). Texts are encoded where they are read; their ids, far smaller, are saved,
    counted, and dealt out and sorted once by ranges of (doc_id, a hash of the text, a number of the row), so that neither
    texts nor ids are among the keys that a range exchange samples to the driver.

    Defined results: a null text is an empty one; null doc_ids come last; rows with the same doc_id follow each other by
    a hash of their text; an empty table gives empty blocks; other columns are ignored.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    cell = _cell(encoder(tokenizer).vocabulary)
    table = save(_tokenized(docs, tokenizer, end_id, cell), "ids")
    counts = _counts(table, cell)
    dense = np.zeros(max(counts, default=-1) + 1, dtype=np.int64)
    for i, n in counts.items():
        dense[i] = n
    lengths = huffman.code_lengths(dense, limit).tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, before = _code(lengths), TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def closed():
            return pa.record_batch({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([held], pa.int64()), "block": pa.array([huffman.encode_block(code, ids, texts)], pa.binary())})

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(np.frombuffer(raw, cell))
                held += len(texts[-1])
                if held >= BLOCK_IDS:
                    yield closed()
                    ids, texts, before, held = [], [], before + held, 0
        if ids:
            yield closed()

    keys = [F.asc_nulls_last("doc_id"), "told", "nth"]
    ordered = table.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    ordered.mapInArrow(blocks, "part int, before long, n_ids long, block binary").write.parquet(f"{path}/blocks")
    start, parts = 0, []
    for r in sorted(spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        parts.append((r["part"], start))
        start += r["n"]
    spark.createDataFrame(parts, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")
    about = json.dumps({"format": "canonical Huffman blocks", "limit": limit, "end_id": end_id, "ids": start})
    spark.createDataFrame([(about, bytearray(lengths))], "about string, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    drop_saved(table)


@lru_cache(maxsize=2)
def _code(lengths: bytes) -> huffman.Code:
    return huffman.Code(np.frombuffer(lengths, np.uint8))


def _read(spark: SparkSession, path: str, schema: str, made) -> DataFrame:
    lengths = bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"])  # one byte per vocabulary entry
    starts = {r["part"]: r["start"] for r in spark.read.parquet(f"{path}/parts").collect()}  # one row per written part

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(lengths)
        for batch in batches:
            for part, before, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, sizes, tokens = huffman.decode_block(code, block)
                ends = np.cumsum(sizes)
                yield made(docs, starts[part] + before + ends - sizes, sizes, [tokens[e - s : e] for s, e in zip(sizes, ends, strict=True)])

    # a block is up to a few MB: few of them travel in a batch
    return spark.read.parquet(f"{path}/blocks").select("part", "before", "block").mapInArrow(rows, schema)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and its ids, decoded block by block."""

    def made(docs, starts, sizes, ids):
        return pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts), "ids": pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))})

    return _read(spark, path, "doc_id long, start long, ids array<long>", made)


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """What a file set holds: doc_id, start, n_tokens and the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def made(docs, starts, sizes, ids):
        return pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(sizes), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())})

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", made)


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Writes the documents to a new file set in the shared folder and returns its digests as read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_file(docs, path, tokenizer, end_id)
    return token_file_digests(docs.sparkSession, path)
