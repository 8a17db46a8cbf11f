"""Aggregates of groups maintained over batches of rows that come and go (operator 12).

A row is present from one batch to another. Extrema: values in ascending (descending) order paint the batches of their
interval that no earlier value has painted, the next unpainted batch found by union-find. Totals: difference arrays. Distinct
items: the intervals of an item are merged before they count. Medians: a Fenwick tree over ranked values, moved along the
batches. Each part runs in tasks that hold a bounded share of a group's rows and hand on one row a group and batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, reach_workers, save

#: Batches that one word of an item's merged intervals covers.
WORD = 62
#: Groups that a task holds before it hands them on.
HELD = 4096
NAMES = ("n_rows", "n_distinct", "total", "least", "greatest", "median")


def paint(values: np.ndarray, begins: np.ndarray, stops: np.ndarray, batches: int, down: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least (``down``: greatest) value of each batch, and which batches have one."""
    out, painted = np.zeros(batches, np.int64), np.zeros(batches, bool)
    following, left = list(range(batches + 1)), batches  # following[t]: where to look for the next unpainted batch
    order = np.argsort(-values if down else values, kind="stable")
    for v, a, b in zip(values[order].tolist(), begins[order].tolist(), stops[order].tolist(), strict=True):
        t = a
        while following[t] != t:
            following[t] = following[following[t]]
            t = following[t]
        while t < b:
            out[t], painted[t] = v, True
            left -= 1
            following[t] = t + 1
            t += 1
            while following[t] != t:
                following[t] = following[following[t]]
                t = following[t]
        if not left:
            break
    return out, painted


def fenwick_select(values: np.ndarray, batch: np.ndarray, change: np.ndarray, asked: list[tuple[int, int]]) -> list[int]:
    """For each (batch, rank), in ascending batches: the value at that rank, from 1, among those present after the batch."""
    ranked, at = np.unique(values, return_inverse=True)
    tree, top = [0] * (len(ranked) + 1), 1 << (len(ranked).bit_length() - 1)
    order = np.argsort(batch, kind="stable")
    moves, i, out = list(zip(batch[order].tolist(), (at[order] + 1).tolist(), change[order].tolist(), strict=True)), 0, []
    for t, rank in asked:
        while i < len(moves) and moves[i][0] <= t:
            _, k, d = moves[i]
            while k < len(tree):
                tree[k] += d
                k += k & -k
            i += 1
        k, step = 0, top
        while step:
            if k + step < len(tree) and tree[k + step] < rank:
                k += step
                rank -= tree[k]
            step >>= 1
        out.append(int(ranked[k]))
    return out


def _groups(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, list[tuple]]:
    """A code per row for its first ``n`` columns, and the columns' values of each code."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns[:n]:
        d = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    return code, list(zip(*(c.take(pa.array(first)).to_pylist() for c in batch.columns[:n]), strict=True))


class _Held:
    """What a task knows of one group: difference arrays, distinct counts, and the extrema painted so far."""

    def __init__(self, batches: int):
        self.moved = np.zeros((4, batches + 1), np.int64)  # rows, values, total, and how many intervals begin or end
        self.items = np.zeros(batches, np.int64)
        self.low, self.high, self.painted = np.zeros(batches, np.int64), np.zeros(batches, np.int64), np.zeros(batches, bool)

    def extrema(self, low: np.ndarray, high: np.ndarray, painted: np.ndarray) -> None:
        both = self.painted & painted
        self.low = np.where(both, np.minimum(self.low, low), np.where(painted, low, self.low))
        self.high = np.where(both, np.maximum(self.high, high), np.where(painted, high, self.high))
        self.painted |= painted


def _handed_on(held: dict[tuple, _Held], schema: pa.Schema, batches: int) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in schema]
    for key, g in held.items():
        moved = g.moved[:, :batches]
        for t in np.flatnonzero(g.painted | moved.any(0) | (g.items != 0)).tolist():
            row = [*key, t, *moved[:, t].tolist(), int(g.items[t]), int(g.low[t]) if g.painted[t] else None, int(g.high[t]) if g.painted[t] else None]
            for c, v in zip(columns, row, strict=True):
                c.append(v)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _per_task(df: DataFrame, keys: Sequence[str], batches: int, taken) -> DataFrame:
    """``taken`` adds each Arrow batch to a task's groups; one row a group and batch leaves the task (more if it has very many groups)."""
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    ddl = f"{key_ddl}, batch int, d_rows long, d_values long, d_total long, events long, items long, low long, high long"
    n = len(keys)

    def rows(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Held] = {}
        schema = None
        for batch in arrow:
            schema = schema or pa.schema([*list(batch.schema)[:n], pa.field("batch", pa.int32()), *(pa.field(c, pa.int64()) for c in ("d_rows", "d_values", "d_total", "events", "items", "low", "high"))])
            if not batch.num_rows:
                continue
            code, names = _groups(batch, n)
            for key in names:
                if key not in held:
                    held[key] = _Held(batches)
            taken([held[k] for k in names], code, batch)
            if len(held) > HELD:
                yield _handed_on(held, schema, batches)
                held = {}
        if held:
            yield _handed_on(held, schema, batches)

    return df.mapInArrow(rows, ddl)


def _painted(rows: DataFrame, keys: Sequence[str], batches: int) -> DataFrame:
    n = len(keys)

    def taken(groups: list[_Held], code: np.ndarray, batch: pa.RecordBatch) -> None:
        begin, stop = (batch.column(n + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        there = ~np.asarray(batch.column(n).is_null())
        value = batch.column(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        moved = np.zeros((4, len(groups), batches + 1), np.int64)
        for i, what in enumerate((np.ones_like(value), there.astype(np.int64), value)):
            np.add.at(moved[i], (code, begin), what)
            np.add.at(moved[i], (code, stop), -what)
        np.add.at(moved[3], (code, begin), 1)
        np.add.at(moved[3], (code, stop), 1)
        order = np.argsort(code[there], kind="stable")
        ordered, starts = code[there][order], None
        starts = np.searchsorted(ordered, np.arange(len(groups) + 1))
        v, a, b = value[there][order], begin[there][order], stop[there][order]
        for i, g in enumerate(groups):
            g.moved += moved[:, i]
            part = slice(starts[i], starts[i + 1])
            if starts[i] < starts[i + 1]:
                low, painted = paint(v[part], a[part], b[part], batches)
                g.extrema(low, paint(v[part], a[part], b[part], batches, down=True)[0], painted)

    return _per_task(rows.select(*keys, "value", "begin", "stop"), keys, batches, taken)


def _distinct(rows: DataFrame, keys: Sequence[str], batches: int) -> DataFrame:
    """Distinct items of each batch: an item's intervals are merged as runs of bits, word by word, before they count."""
    n = len(keys)
    word = F.explode(F.sequence(F.expr(f"begin div {WORD}"), F.expr(f"(stop - 1) div {WORD}"))).alias("word")
    bits = rows.filter(F.col("item").isNotNull()).select(*keys, "item", "begin", "stop", word)
    upper, lower = F.least(F.col("stop") - WORD * F.col("word"), F.lit(WORD)), F.greatest(F.col("begin") - WORD * F.col("word"), F.lit(0))
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, upper.cast("int")) - F.call_function("shiftleft", one, lower.cast("int"))
    merged = bits.select(*keys, "item", "word", mask.alias("mask")).groupBy(*keys, "item", "word").agg(F.bit_or("mask").alias("mask")).select(*keys, "word", "mask")

    def taken(groups: list[_Held], code: np.ndarray, batch: pa.RecordBatch) -> None:
        words, masks = (batch.column(n + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        for w in np.unique(words).tolist():
            of = words == w
            for t in range(w * WORD, min((w + 1) * WORD, batches)):
                counts = np.bincount(code[of], (masks[of] >> (t - w * WORD)) & 1, len(groups)).astype(np.int64)
                for i in np.flatnonzero(counts).tolist():
                    groups[i].items[t] += counts[i]

    return _per_task(merged, keys, batches, taken)


def _medians(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, batch, median where there are values.

    Changes of a value's count are dealt to blocks of a group's value range. Running counts a block and batch tell which
    block holds the middle value, and a Fenwick tree over the block's own values finds it.
    """
    spark = rows.sparkSession
    both = F.explode(F.array(F.struct(F.col("begin").alias("batch"), F.lit(1).cast("long").alias("d")), F.struct(F.col("stop").alias("batch"), F.lit(-1).cast("long").alias("d")))).alias("e")
    changes = rows.filter(F.col("value").isNotNull()).select(*keys, "value", both).select(*keys, "value", "e.*").groupBy(*keys, "value", "batch").agg(F.sum("d").alias("d")).filter("d <> 0")
    changes = save(changes.repartitionByRange(*keys, "value").withColumn("block", F.spark_partition_id()), "blocks")
    sums = save(changes.groupBy(*keys, "block", "batch").agg(F.sum("d").alias("d")), "block-sums")
    asked = stats.filter("n_values > 0").select(*keys, "batch", F.expr("n_values div 2 + 1").alias("rank"))
    moments = stats.select(*keys, "batch")
    grid = moments.join(sums.select(*keys, "block").distinct(), list(keys)).join(sums, [*keys, "block", "batch"], "left")
    counts = grid.withColumn("n", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(*keys, "block").orderBy("batch"))).drop("d")
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "batch").orderBy("block")))
    found = counts.join(asked, [*keys, "batch"]).filter("rank <= upto AND rank > upto - n").select(*keys, "block", "batch", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def middle(held: pa.Table, questions: pa.Table) -> pa.Table:
        if not held.num_rows or not questions.num_rows:
            questions = questions.slice(0, 0)
        questions = questions.sort_by("batch")
        own = [questions.column(i) for i in range(n)]
        asked = list(zip(questions["batch"].to_pylist(), questions["rank"].to_pylist(), strict=True))
        found = fenwick_select(*(held[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("value", "batch", "d")), asked) if asked else []
        return pa.table([*own, questions["batch"], pa.array(found, pa.int64())], names=[*questions.column_names[:n], "batch", "median"])

    reach_workers(spark)
    by = [*keys, "block"]
    return changes.select(*keys, "block", "value", "batch", "d").groupBy(*by).cogroup(found.groupBy(*by)).applyInArrow(middle, f"{ddl}, batch int, median long")


def aggregate_changes(rows: DataFrame, keys: Sequence[str], batches: int) -> DataFrame:
    """Each batch and group in which a maintained aggregate changes, with its values before and after the batch.

    ``rows``: the key columns (not null), ``item`` (any type that can be grouped; null: not counted), ``value`` (long, or
    null), and ``begin`` and ``stop``: the row is there after the batches from begin up to, not with, stop. What lies
    outside 0 to ``batches`` never happens. Result: batch, the keys, and old_ and new_ of n_rows, n_distinct and
    total (0 without rows), least, greatest and median (null without values; position floor(n / 2) + 1 of n).

    Repeated rows count each; rows with a null begin or stop, and empty intervals, never enter; an empty table gives no
    rows; other columns are ignored. No task holds a group: intervals are painted and summed up where rows are read, and a
    group's values are dealt to as many blocks as there are partitions for them.
    """
    keys = list(keys)
    rows = pick(rows, *keys, "item", "value", "begin", "stop")
    rows = rows.filter("begin IS NOT NULL AND stop IS NOT NULL")
    rows = rows.withColumns({"begin": F.greatest(F.col("begin").cast("int"), F.lit(0)), "stop": F.least(F.col("stop").cast("int"), F.lit(batches)), "value": F.col("value").cast("long")}).filter("begin < stop")
    parts = _painted(rows, keys, batches).unionByName(_distinct(rows, keys, batches))
    sums = {c: F.sum(c).alias(c) for c in ("d_rows", "d_values", "d_total", "events", "items")}
    stats = parts.groupBy(*keys, "batch").agg(*sums.values(), F.min("low").alias("low"), F.max("high").alias("high")).filter("events > 0")
    running = Window.partitionBy(*keys).orderBy("batch")
    stats = save(stats.select(*keys, "batch", F.sum("d_rows").over(running).alias("n_rows"), F.sum("d_values").over(running).alias("n_values"), F.sum("d_total").over(running).alias("total"), F.col("items").alias("n_distinct"), F.col("low").alias("least"), F.col("high").alias("greatest")), "group-stats")
    # events are begins and ends of rows: where there is none, nothing changes
    known = stats.join(_medians(rows, stats, keys), [*keys, "batch"], "left")

    def before(c: str) -> Column:
        return F.lag(c).over(running) if c in ("least", "greatest", "median") else F.coalesce(F.lag(c).over(running), F.lit(0))

    told = known.select("batch", *keys, *(x for c in NAMES for x in (before(c).cast("long").alias(f"old_{c}"), F.col(c).cast("long").alias(f"new_{c}"))))
    changed = [~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in NAMES]
    return told.filter(changed[0] | changed[1] | changed[2] | changed[3] | changed[4] | changed[5])


def presence(docs: DataFrame, batches: int = 50, most: int = 7) -> DataFrame:
    """Documents as rows that come and go, for ``aggregate_changes`` by source and lang.

    With h the crc32 of the decimal doc_id, a document enters in batch h mod ``batches`` and leaves q = floor(h / batches)
    mod ``most`` batches later; if 3 divides q it enters again in that batch for good, its n_chars raised by q. A null
    doc_id has no batch and never enters. Items are texts by a 128-bit hash: two texts of one hash would count once.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("item"), "text").alias("b")))
    rows = pick(docs, "doc_id", "source", "lang", "n_chars", "text").select(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), text.alias("item"),
        F.pmod(h, F.lit(batches)).alias("b"), F.expr(f"(crc32(cast(cast(doc_id as string) as binary)) div {batches}) % {most}").alias("q"),
    )
    stay = F.struct(F.col("b").alias("begin"), (F.col("b") + F.col("q")).alias("stop"), F.lit(0).cast("long").alias("more"))
    back = F.when(F.col("q") % 3 == 0, F.struct((F.col("b") + F.col("q")).alias("begin"), F.lit(batches).cast("long").alias("stop"), F.col("q").alias("more")))
    rows = rows.select("source", "lang", "item", "n_chars", F.explode(F.array(stay, back)).alias("p")).filter("p IS NOT NULL")
    return rows.select("source", "lang", "item", (F.col("n_chars") + F.col("p.more")).alias("value"), "p.begin", "p.stop")
