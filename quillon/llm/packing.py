"""Best-fit packing of documents into sequences by large-item matching (operator 3)."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, global_index, pick, save
from .tokens import default_tokenizer, encoder

CAPACITY = 2048


@dataclass(frozen=True)
class Run:
    """Pieces ``first`` .. ``first + n - 1`` of one size go, ``each`` to a sequence, to sequences from ``bin`` on, at ``offset``."""

    size: int
    first: int
    n: int
    bin: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Places ``counts[size]`` pieces of every size; returns the runs and the number of sequences.

    Sizes above a third of the capacity are matched first: the largest left over takes the largest partner that still
    fits, so at most two of them share a sequence. Smaller sizes, largest first, then go to the tightest gap that holds
    them. Sequences alike are handled together, so the work follows the number of sizes, not of pieces.
    """
    runs: list[Run] = []
    placed = dict.fromkeys(counts, 0)
    left = {s: n for s, n in counts.items() if n}
    bins = 0
    gaps: list[int] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)

    def put(size: int, n: int, first_bin: int, each: int, offset: int) -> None:
        runs.append(Run(size, placed[size], n, first_bin, each, offset))
        placed[size] += n

    def leave(gap: int, first_bin: int, n: int) -> None:
        if n and gap:
            if gap not in open_at:
                open_at[gap] = []
                insort(gaps, gap)
            open_at[gap].append((first_bin, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect_right(large, capacity - a) - 1
        b = large[i] if i >= 0 else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        if b == a and not n:  # a single one is left: the next smaller may join it
            b = large[i - 1] if i else None
            n = 1
        put(a, n, bins, 1, 0)
        if b is not None:
            put(b, n, bins, 1, a)
        leave(capacity - a - (b or 0), bins, n)
        bins += n
        for s in (a, b):
            if s is not None:
                left[s] -= n
        for s in {a, b} - {None}:
            if not left[s]:
                large.remove(s)
                del left[s]

    def fill(size: int, n: int, gap: int, first_bin: int, many: int) -> int:
        """Up to ``n`` pieces into sequences that all have this gap, one sequence after another; returns how many went."""
        each = gap // size
        full = min(many, n // each)
        if full:
            put(size, full * each, first_bin, each, capacity - gap)
            leave(gap - each * size, first_bin, full)
        rest = min(n - full * each, each) if full < many else 0
        if rest:
            put(size, rest, first_bin + full, rest, capacity - gap)
            leave(gap - rest * size, first_bin + full, 1)
        leave(gap, first_bin + full + bool(rest), many - full - bool(rest))
        return full * each + rest

    for size in sorted(left, reverse=True):
        n = left[size]
        while n and (i := bisect_left(gaps, size)) < len(gaps):
            gap = gaps[i]
            first_bin, many = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[i]
            n -= fill(size, n, gap, first_bin, many)
        if n:
            many = -(-n // (capacity // size))
            fill(size, n, capacity, bins, many)
            bins += many
    return runs, bins


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """One row a piece: the whole document, or, of a longer one, a shorter first piece and then full ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text) + end
                n = len(raw) // 4
                at = [0, *range(n % capacity or capacity, n, capacity), n]
                out += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
            doc, k, start, length, crc = zip(*out, strict=True) if out else [()] * 5
            yield pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return pick(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Packs the token ids of all documents, each followed by ``end_id``, into sequences of at most ``capacity`` ids.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only how many pieces there are
    of each length reaches the driver (``capacity`` numbers at most); the plan made from that holds a few runs a length,
    and each piece finds its place by its number in the order (length, doc_id, piece, crc).

    Defined results: null and empty texts are a single end id; null doc_ids and repeated rows are pieces like others
    (equal ones get different places); an empty table gives no rows; other columns are ignored.
    """
    table = save(pieces(docs, capacity, tokenizer or default_tokenizer(), end_id), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    before, base = 0, {}
    for size in sorted(counts):
        base[size] = before
        before += counts[size]
    runs.sort(key=lambda r: base[r.size] + r.first)
    starts, bin_, each, offset, size = (
        np.array(x, dtype=np.int64) for x in ([base[r.size] + r.first for r in runs], [r.bin for r in runs], [r.each for r in runs], [r.offset for r in runs], [r.size for r in runs])
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = batch.column(batch.schema.get_field_index("idx")).to_numpy(zero_copy_only=False)
            run = np.searchsorted(starts, idx, side="right") - 1
            nth = idx - starts[run]
            columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(columns | {"sequence_id": pa.array(bin_[run] + nth // each[run]), "offset": pa.array(offset[run] + nth % each[run] * size[run])})

    numbered = global_index(table, ["length", F.asc_nulls_last("doc_id"), "piece", "ids_crc32"], "places")
    drop_saved(table)
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
