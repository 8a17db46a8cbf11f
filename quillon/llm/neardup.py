"""Near-duplicate groups by HyperMinHash: compressed registers, bands, corrected estimates, then whole sets (operator 10)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, packed_row, pick, save, unpacked

WORDS = 5
#: Registers; bits of a register's mantissa; registers of a band.
REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
EMPTY = 0xFFFF
#: Ids of candidates up to which their semi-join broadcasts them (8 bytes each); beyond, it shuffles.
BROADCAST_IDS = 1_000_000
#: Rows and shingles that a block of a bucket holds, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1_024, 2_000_000
#: Standard deviations by which an estimate may fall short of the threshold before a pair is let go.
SIGMAS = 6.0

_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        value = xxhash.xxh3_64_digest(word)
        self[word] = value
        return value


_HASHES = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer (public constants)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z is lower-cased, words end at ASCII white space."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=_U)
    w = np.frombuffer(b"".join(map(_HASHES.__getitem__, found)), "<u8")
    n, h = max(1, len(w) - words + 1), np.zeros(max(1, len(w) - words + 1), dtype=_U)
    for i in range(min(words, len(w))):
        h = mix(h + w[i : i + n] + _U(i + 1))
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers of a sorted set: the least value that falls to each, as leading zeros and ten bits behind its first one."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    bucket = (hashes >> _U(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    value = hashes[first] & _U((1 << 57) - 1)
    exact = value.astype(np.float64)
    size = np.where(value == 0, 0, np.frexp(np.maximum(exact, 1))[1])
    size = np.where((value > 0) & (size > 0) & ((value >> np.maximum(size - 1, 0).astype(_U)) == 0), size - 1, size)  # rounded up
    zeros = np.minimum(57 - size, 62)
    behind = np.where(size > MANTISSA, value >> np.maximum(size - 1 - MANTISSA, 0).astype(_U), value << np.maximum(MANTISSA + 1 - size, 0).astype(_U))
    out[bucket[first]] = (zeros.astype(np.uint16) << MANTISSA) | (behind & _U((1 << MANTISSA) - 1)).astype(np.uint16)
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two unrelated sets that agree by chance (the published approximation for HyperMinHash sketches)."""
    large, small = np.maximum(n, m).astype(float), np.maximum(np.minimum(n, m), 1).astype(float)
    ratio = large / small
    return 0.169919487159739093975315012348 * REGISTERS / 2.0**MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of rows of registers, and how many registers each rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    total = np.maximum(used.sum(axis=1), 1)
    same = ((a == b) & used).sum(axis=1)
    return np.clip(same - expected_collisions(n, m), 0, None) / total, total


def _margin(similarity: float, n: float | np.ndarray) -> float | np.ndarray:
    return SIGMAS * np.sqrt(similarity * (1 - similarity) / n)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, nth: a number that no other row has, as a saved table; links, classes and groups go by it."""
    return save(pick(docs, "doc_id", "text").withColumn("nth", F.monotonically_increasing_id()), "numbered")


def sketches(rows_of: DataFrame, words: int = WORDS) -> DataFrame:
    """nth, doc_id, n_shingles, a 128-bit digest of the whole shingle set (k1, k2) and its registers, of numbered rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, regs = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                k1.append(int(key[0]))
                k2.append(int(key[1]))
                regs.append(registers(s).tobytes())
            yield pa.record_batch({"nth": batch.column(0), "doc_id": batch.column(1).cast(pa.int64()), "n_shingles": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "regs": pa.array(regs, pa.binary())})

    return rows_of.select("nth", "doc_id", "text").mapInArrow(rows, "nth long, doc_id long, n_shingles long, k1 long, k2 long, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    """key, band, id, n, s1, s2: a row for each band that isn't empty; s1 and s2 hold one bit of every register."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
            raw = np.ascontiguousarray(regs).view("<u8").reshape(-1, BANDS)
            keys = mix(raw + mix(np.arange(1, BANDS + 1, dtype=_U)))
            bits = np.packbits((mix(regs.astype(_U)) & _U(1)).astype(np.uint8), axis=1).view("<i8")
            row, band = np.nonzero(raw != _U(0xFFFFFFFFFFFFFFFF))
            take = pa.array(row)
            yield pa.record_batch({"key": pa.array(keys[row, band].view(np.int64)), "band": pa.array(band.astype(np.int32)), "id": batch.column("id").take(take), "n": batch.column("n").take(take), "s1": pa.array(bits[row, 0]), "s2": pa.array(bits[row, 1])})

    return classes.mapInArrow(rows, "key long, band int, id long, n long, s1 long, s2 long")


def _alike(a: str, b: str, percent: int):
    """Sizes and one-bit registers of two rows allow the similarity."""
    j = percent / 100
    most = math.ceil(REGISTERS * ((1 - j) / 2 + SIGMAS * math.sqrt((1 - (1 - j) / 2) * (1 - j) / 2 / REGISTERS)))
    differ = F.bit_count(F.col(f"{a}s1").bitwiseXOR(F.col(f"{b}s1"))) + F.bit_count(F.col(f"{a}s2").bitwiseXOR(F.col(f"{b}s2")))
    return (100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")) & (differ <= most)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, set (sorted hashes) of the numbered rows with one of the ids; the ids are broadcast only up to a checked number."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch({"id": batch.column(0).cast(pa.int64()), "set": pa.array(found, pa.binary())})

    return docs.select(F.col("nth").alias("id"), "text").join(ids, "id", "left_semi").mapInArrow(sets, "id long, set binary")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity, on integers."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity, as a saved table.

    Corrected estimates go first; ``percent`` is checked on the integers of whole sets.
    """
    similarity = percent / 100

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            guess, on = estimate(x, y, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            ok = pa.array(guess >= similarity - _margin(similarity, on) - 1.0 / on)
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(ok)

    of = lambda x: classes.select(F.col("id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    likely = save(pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(near, "a long, b long"), "likely")
    whole = _sets(docs, likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [reaches(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    side = lambda x: whole.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
    # b first: each set moves once, and only the last join meets the centres of stars, whose pairs skew handling deals out
    return save(likely.join(side("b"), "b").join(side("a"), "a").mapInArrow(confirmed, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """id, comp: the least id reachable over ``links`` (a, b), for the ids that have links, by alternating stars.

    Each round hangs an id's larger neighbours, then its smaller ones, on the least of them; a round ends as a saved
    table, and only a count and a checksum reach the driver. The rounds stop when a round changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, seen = save(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
            )
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = save(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        drop_saved(edges)
        edges = following


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key of a partition that is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(columns[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _plausible(regs: np.ndarray, n: np.ndarray, comp: np.ndarray, block: np.ndarray, guest: np.ndarray, band: int, across: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a bucket those after it that it may be linked with and that no earlier band holds with it.

    Rows of one component are left out, as are pairs of guests and pairs of one block where two blocks meet (``across``).
    """
    j = percent / 100
    for i in range(len(regs) - 1):
        alike = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :]))
        rest = np.flatnonzero(alike & ((block[i + 1 :] != block[i]) | (not across)) & ~(guest[i + 1 :] & guest[i])) + i + 1
        if not len(rest):
            continue
        guess, on = estimate(regs[i][None, :], regs[rest], n[i], n[rest])
        rest = rest[guess >= j - _margin(j, on) - 1.0 / on]
        if len(rest):
            same = (regs[rest] == regs[i]).reshape(-1, BANDS, ROWS).all(axis=2) & (regs[i].reshape(BANDS, ROWS) != EMPTY).any(axis=1)
            rest = rest[same.argmax(axis=1) == band]
        if len(rest):
            yield i, rest


def _dealt(crowd: DataFrame, percent: int) -> DataFrame:
    """key, part, lo, hi, band, block, guest, id, comp, n: the rows of ``crowd`` as they meet, each group of bounded weight.

    A small bucket is one group. In a larger one only rows of like sizes can be linked, so its rows meet by size class: a
    class as wide as the similarity allows has its own rows and, as guests, those of the class below. What is still too
    large is cut into blocks by a hash, of which each two meet.
    """
    width = math.log(100 / percent) * 1.000001
    size_class = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    own, other = F.struct(size_class.alias("part"), F.lit(False).alias("guest")), F.struct((size_class + 1).alias("part"), F.lit(True).alias("guest"))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(False).alias("guest")))
    large = (F.col("rows") > BLOCK_ROWS) | (F.col("weight") > BLOCK_SHINGLES)
    rows = crowd.select("key", "band", "id", "comp", "n", F.explode(F.when(large, F.array(own, other)).otherwise(whole)).alias("p")).select("key", "p.*", "band", "id", "comp", "n")
    sizes = rows.groupBy("key", "part").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.bool_and("guest").alias("idle"))
    rows = rows.join(sizes.filter("NOT idle").drop("idle"), ["key", "part"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", "part", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "band", "block", "guest", "id", "comp", "n")


def _within(crowd: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) between unlike components of the buckets in ``crowd``; enough of them to join what belongs together.

    Rows meet in groups of bounded weight; pairs stay inside a task. A first pass with registers alone tells which rows
    have a plausible partner at all, a second one has their whole sets.
    """
    keys = ("key", "part", "lo", "hi")
    rows = _dealt(crowd, percent)
    dealt = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)

    def inputs(group: pa.Table, regs: np.ndarray, n: np.ndarray):
        column = lambda c: group.column(c).to_numpy()
        across = group.column("lo")[0] != group.column("hi")[0]
        guest = group.column("guest").to_numpy(zero_copy_only=False)
        return _plausible(regs, n, column("comp"), column("block"), guest, group.column("band")[0].as_py(), across, percent)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
            keep = np.zeros(len(regs), dtype=bool)
            for i, rest in inputs(group, regs, group.column("n").to_numpy()):
                keep[i] = keep[rest] = True
            if keep.any():
                yield from group.drop_columns(["regs", "n"]).filter(pa.array(keep)).combine_chunks().to_batches()

    schema = "key long, part int, lo int, hi int, band int, block int, guest boolean, id long, comp long"
    kept = save(dealt(rows.join(classes.select("id", "regs"), "id").select(*keys, "band", "block", "guest", "id", "comp", "n", "regs")).mapInArrow(survivors, schema), "survivors")
    whole = _sets(docs, kept.select("id").distinct(), words)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            sets = [np.frombuffer(x, _U) for x in group.column("set").to_pylist()]
            root = {c: c for c in group.column("comp").to_pylist()}

            def find(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            ids, comp, out = group.column("id").to_pylist(), group.column("comp").to_pylist(), []
            for i, rest in inputs(group, np.stack([registers(x) for x in sets]), np.array([len(x) for x in sets])):
                for k in rest.tolist():
                    a, b = find(comp[i]), find(comp[k])
                    if a != b and reaches(sets[i], sets[k], percent):
                        root[max(a, b)] = min(a, b)
                        out.append((ids[i], ids[k]))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return save(dealt(kept.join(whole, "id").select(*keys, "band", "block", "guest", "id", "comp", "set")).mapInArrow(linked, "a long, b long").distinct(), "within")


def grouped(rows: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """nth, doc_id, n_shingles, component_id, stays (of one row a group) for the rows of ``numbered``.

    Rows of equal sets form a class, which goes on as its least number. Classes that share a band of registers are
    candidates: first each with the least class of the band's bucket, then, within buckets whose classes are still in
    different groups, those of unlike groups and like sizes with each other, in blocks inside a task. Sizes, one bit a
    register, and the corrected estimate discard what is at least six standard deviations off; whole sets decide. 32 bands
    of 4 registers miss a link at a similarity of 0.85 with a probability below 1e-10 (0.8: 5e-8).
    """
    docs = rows
    table = save(sketches(rows, words), "sketches")
    named = table.filter("n_shingles > 0")
    same_set = named.groupBy("k1", "k2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("nth").alias("nth")))
    classes = save(same_set.agg(F.min("nth").alias("id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), first.alias("head")), "classes")
    # what a bucket is, is summed up before it is exchanged, and joined back to its rows: no task gets a bucket whole
    bands = save(_bands(classes.select("id", "n", "regs")), "bands")
    summary = bands.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"), F.min(F.struct("id", "n", "s1", "s2")).alias("c")).filter("rows > 1")
    buckets = save(bands.join(summary, "key"), "buckets")
    drop_saved(bands)
    star = buckets.select("id", "n", "s1", "s2", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("id", "n", "s1", "s2")])
    star = star.filter((F.col("id") != F.col("c_id")) & _alike("", "c_", percent)).select(F.col("c_id").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(star, classes, docs, percent, words)
    groups = components(links)

    # The rest: classes of one bucket that are in different groups by now.
    crowd = buckets.filter("rows > 2").select("key", "band", "id", "n", "rows", "weight").join(groups, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    crowd = save(crowd, "grouped")
    split = crowd.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key")
    more = _within(crowd.join(split, "key", "left_semi"), classes, docs, percent, words)
    groups = components(links.unionByName(more)) if more.take(1) else groups

    member = classes.select("k1", "k2", "head", "id").join(groups, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    heads = member.groupBy("comp").agg(F.min("head").alias("least"))
    member = member.join(heads, "comp").select("k1", "k2", "least")
    out = named.select("nth", "doc_id", "n_shingles", "k1", "k2").join(member, ["k1", "k2"])
    out = out.select("nth", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("nth") == F.col("least.nth")).alias("stays"))
    alone = table.filter("n_shingles = 0").select("nth", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by 100 * common >= percent * union of shingles.

    Defined results: null, empty and blank texts have empty sets, which are linked with nothing; texts of fewer words are
    one shingle; each row counts by itself, so rows that repeat a doc_id are in one group only if their texts are; a group
    is named by its least doc_id, and by null if none of its rows has one; kept are the rows of that doc_id, and of a group
    without one a single row; an empty table gives no rows; other columns are ignored.
    """
    found = grouped(numbered(docs), percent, words)
    kept = F.when(F.col("component_id").isNull(), F.col("stays")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def distinct_documents(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group: the one of least doc_id (of none: any one); all columns stay.

    Defined results: as those of ``near_duplicates``, except that of rows that repeat the least doc_id one stays; rows of
    null, empty and blank texts all stay.
    """
    rows, columns = packed_row(docs, "doc_id", "text")
    rows = save(rows.withColumn("nth", F.monotonically_increasing_id()), "rows")
    slim = rows.select(F.col("__k_doc_id").cast("long").alias("doc_id"), F.col("__k_text").alias("text"), "nth")
    gone = grouped(slim, percent, words).filter("NOT stays").select("nth")
    return unpacked(rows.join(gone, "nth", "left_anti"), columns)
