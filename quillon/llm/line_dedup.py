"""Reversible line dedup over growing and shrinking corpora (operator 11).

An index holds exact reference counts of lines and, per shard of keys, a cuckoo filter of the lines it knows. A batch of
documents asks the filters first: keys that a filter doesn't know are new and are written without a look at earlier
counts; the rest are looked up in them. Deleting documents takes counts down again, and filters forget what nobody holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pick, save
from .cuckoo import CuckooFilter

#: White space that a line's key is stripped of (fixed value).
WHITE = b" \t\n\x0b\x0c\r"
#: Keys with at least one in so many references are joined by a broadcast; there are at most so many of them.
HEAVY = 10_000

_POSTING = "doc_id long, k1 long, k2 long"
_FILTER = "shard int, buckets long, tables binary"


def line_key(line: bytes) -> bytes:
    """UTF-8 of a line without white space at its ends, A-Z in lower case."""
    return line.strip(WHITE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _digests(text: str, least: int) -> list[bytes | None]:
    """The 128-bit digest of each line's key; None for keys that are too short to count."""
    known: dict[bytes, bytes | None] = {}
    out = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line_key(line)
        if key not in known:
            known[key] = blake2b(key, digest_size=16).digest() if _long_enough(key, least) else None
        out.append(known[key])
    return out


def postings(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """doc_id, k1, k2: one row for each row of ``docs`` and each distinct key of at least ``least_chars`` code points in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set(_digests(t, least_chars)) - {None} if t else () for t in batch.column(1).to_pylist()]
            keys = np.frombuffer(b"".join(k for f in found for k in f), "<i8").reshape(-1, 2)
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()).take(pa.array(of, pa.int64())), "k1": pa.array(np.ascontiguousarray(keys[:, 0])), "k2": pa.array(np.ascontiguousarray(keys[:, 1]))})

    return pick(docs, "doc_id", "text").mapInArrow(rows, _POSTING)


def _by_shard(filters: DataFrame | None, keys: DataFrame, made, schema: str) -> DataFrame:
    """``made(filter or None, shard, keys)`` for every shard, which holds its own keys and its own filter only."""
    if filters is None:
        filters = keys.sparkSession.createDataFrame([], _FILTER)

    def both(held: pa.Table, asked: pa.Table) -> pa.Table:
        known = CuckooFilter.load(held["tables"][0].as_py(), held["buckets"][0].as_py()) if held.num_rows else None
        return made(known, (held if held.num_rows else asked)["shard"][0].as_py(), asked)

    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(both, schema)


def _halves(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k1", "k2"))


def _filter_row(known: CuckooFilter, shard: int) -> pa.Table:
    raw, buckets = known.dump()
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([buckets], pa.int64()), "tables": pa.array([raw], pa.binary())})


def _filled(known: CuckooFilter | None, shard: int, keys: pa.Table) -> pa.Table:
    known = known or CuckooFilter(keys.num_rows)
    known.add(*_halves(keys))
    return _filter_row(known, shard)


def _emptied(known: CuckooFilter | None, shard: int, keys: pa.Table) -> pa.Table:
    known = known or CuckooFilter(0)
    known.remove(*_halves(keys))
    return _filter_row(known, shard)


def _asked(known: CuckooFilter | None, shard: int, keys: pa.Table) -> pa.Table:
    seen = known.has(*_halves(keys)) if known and keys.num_rows else np.zeros(keys.num_rows, bool)
    return keys.append_column("seen", pa.array(seen))


class LineIndex:
    """Lines of a corpus with their exact reference counts, kept in a folder that driver and executors share.

    Each ``insert`` or ``delete`` writes a batch of its own, of the keys that it touches only, and a row of ``log`` last: a
    batch without that row never happened, so an operation that fails can be run again. ``postings`` has which document holds
    which key, ``refs`` the counts of the batch's keys after it (n_docs, and keeper: the largest doc_id), ``filters`` one
    cuckoo filter a shard. ``shards`` is a power of two, at most 2^20; None takes one for a million keys of the first batch,
    64 at least. One shard's new keys and filter are held by one task.

    Keys are told apart by 128-bit digests; two keys of one digest, which 10^12 keys have with a chance below 10^-14,
    would count as one. Each row counts as a document of its own; of rows that share the largest doc_id none loses lines. Null
    doc_ids are smaller than all others; null and empty texts have one empty line.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None, least_chars: int = 20, least_docs: int = 3):
        self.spark, self.path, self.shards, self.least_chars, self.least_docs = spark, path or new_path(spark, "lines"), shards, least_chars, least_docs
        self.batches: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The index as its last finished batch left it."""
        log = spark.read.parquet(f"{path}/log").orderBy("batch").collect()  # one row a batch
        out = cls(spark, path, log[-1]["shards"], log[-1]["least_chars"], log[-1]["least_docs"])
        out.batches = [r["kind"] for r in log]
        return out

    def _write(self, df: DataFrame, what: str, batch: int) -> DataFrame:
        path = f"{self.path}/{what}/{batch}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, what: str, schema: str, kinds: tuple[str, ...] = ("insert", "delete")) -> DataFrame:
        """The finished batches of a table, with their number."""
        out = self.spark.createDataFrame([], f"{schema}, batch int")
        for i, kind in enumerate(self.batches):
            if kind in kinds:
                out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{what}/{i}").withColumn("batch", F.lit(i)))
        return out

    def _finish(self, kind: str) -> None:
        row = [(len(self.batches), kind, self.shards, self.least_chars, self.least_docs)]
        self.spark.createDataFrame(row, "batch int, kind string, shards int, least_chars int, least_docs int").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.batches.append(kind)

    def _filters(self) -> DataFrame | None:
        return self.spark.read.schema(_FILTER).parquet(f"{self.path}/filters/{len(self.batches) - 1}") if self.batches else None

    def references(self) -> DataFrame:
        """k1, k2, n_docs, keeper of every key that a document holds."""
        last = self._read("refs", "k1 long, k2 long, n_docs long, keeper long").groupBy("k1", "k2").agg(F.max_by(F.struct("n_docs", "keeper"), "batch").alias("r"))
        return last.select("k1", "k2", "r.*").filter("n_docs > 0")

    def held(self) -> DataFrame:
        """doc_id, k1, k2 of the documents that are in the index."""
        all_ = self._read("postings", _POSTING, ("insert",))
        if "delete" not in self.batches:
            return all_.drop("batch")
        gone = self._read("gone", "doc_id long", ("delete",)).groupBy("doc_id").agg(F.max("batch").alias("left")).withColumnRenamed("doc_id", "of")
        return all_.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("left") > F.col("batch")), "left_anti").drop("batch")

    def insert(self, docs: DataFrame) -> None:
        """Adds documents. An empty table adds nothing; a doc_id that is there already counts once more."""
        n = len(self.batches)
        new = self._write(postings(docs, self.least_chars), "postings", n)
        counted = save(new.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")), "line-counts")
        if self.shards is None:
            self.shards = max(64, 1 << (counted.count() >> 20).bit_length())
        shard = F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard")
        counted = counted.select(shard, "*")
        if n:
            asked = save(_by_shard(self._filters(), counted, _asked, "shard int, k1 long, k2 long, n long, top long, seen boolean"), "line-asked")
            maybe, sure = asked.filter("seen"), asked.filter("NOT seen")
            known = self.references().join(maybe.select("k1", "k2"), ["k1", "k2"], "left_semi")
            met = maybe.join(known, ["k1", "k2"], "left").select("shard", "k1", "k2", (F.col("n") + F.coalesce("n_docs", F.lit(0))).alias("n_docs"), F.greatest("top", "keeper").alias("keeper"), F.col("n_docs").isNull().alias("fresh"))
            refs = met.unionByName(sure.select("shard", "k1", "k2", F.col("n").alias("n_docs"), F.col("top").alias("keeper"), F.lit(True).alias("fresh")))
        else:
            refs = counted.select("shard", "k1", "k2", F.col("n").alias("n_docs"), F.col("top").alias("keeper"), F.lit(True).alias("fresh"))
        refs = self._write(refs, "refs", n)
        self._write(_by_shard(self._filters(), refs.filter("fresh").select("shard", "k1", "k2"), _filled, _FILTER), "filters", n)
        self._finish("insert")

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes documents (doc_id) out again: counts fall, and a key whose keeper goes gets the largest doc_id that is left. Ids that aren't there change nothing."""
        n = len(self.batches)
        gone = self._write(pick(doc_ids, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "gone", n)
        named = gone.withColumnRenamed("doc_id", "of")
        same = F.col("doc_id").eqNullSafe(F.col("of"))
        lost = save(self.held().join(named, same, "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("lost")), "line-lost")
        before = save(self.references().join(lost, ["k1", "k2"]), "line-before")
        left = _join_by_key(self.held().join(named, same, "left_anti"), before.select("k1", "k2", "n_docs")).groupBy("k1", "k2").agg(F.max("doc_id").alias("keeper"))
        refs = before.drop("keeper").join(left, ["k1", "k2"], "left").select(F.pmod("k1", F.lit(self.shards or 64)).cast("int").alias("shard"), "k1", "k2", (F.col("n_docs") - F.col("lost")).alias("n_docs"), "keeper", F.lit(False).alias("fresh"))
        refs = self._write(refs, "refs", n)
        self._write(_by_shard(self._filters(), refs.filter("n_docs = 0").select("shard", "k1", "k2"), _emptied, _FILTER), "filters", n)
        self._finish("delete")

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept: the texts of documents that are in the index without their repeated lines.

        A key in ``least_docs`` documents or more stays in those of its largest doc_id only, there with all its lines; the
        other lines stay, joined by \\n. An empty table gives no rows; other columns are ignored.
        """
        repeated = self.references().filter(F.col("n_docs") >= self.least_docs)
        doomed = _join_by_key(self.held(), repeated).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        doomed = doomed.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("k1", "k2")).alias("keys")).select("of", F.col("keys.k1").alias("k1"), F.col("keys.k2").alias("k2"))
        rows = pick(docs, "doc_id", "text").join(doomed, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "k1", "k2")
        least = self.least_chars

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines, dropped, texts = [], [], []
                for text, k1, k2 in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    text = text or ""
                    lines.append(text.count("\n") + 1)
                    if k1:
                        raw = np.array([k1, k2], "<i8").T.tobytes()
                        out = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                        stay = [line for line, d in zip(text.split("\n"), _digests(text, least), strict=True) if d not in out]
                        dropped.append(lines[-1] - len(stay))
                        text = "\n".join(stay)
                    else:
                        dropped.append(0)
                    texts.append(text)
                yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(texts, pa.string())})

        return rows.mapInArrow(kept, "doc_id long, n_lines long, n_dropped long, kept string")


def _join_by_key(held: DataFrame, keys: DataFrame) -> DataFrame:
    """``held`` joined to ``keys`` (with n_docs). Keys that many hold, at most ``HEAVY`` of them, come by a broadcast, the others by their key."""
    keys = save(keys, "line-keys")
    total = keys.agg(F.sum("n_docs")).first()[0] or 0
    heavy = F.col("n_docs") >= max(2, -(-total // HEAVY))
    many = held.join(F.broadcast(keys.filter(heavy)), ["k1", "k2"])
    return many.unionByName(held.join(keys.filter(~heavy), ["k1", "k2"]))


def line_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Indexes ``docs`` in ``batches`` parts, as a growing corpus comes in, and returns ``deduplicate`` of all of them."""
    index = LineIndex(docs.sparkSession)
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(batches))
    rows = pick(docs, "doc_id", "text")
    for i in range(batches):
        index.insert(rows.filter(part == i))
    return index.deduplicate(rows)
