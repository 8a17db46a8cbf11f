"""Rebuilds after bursts of changes: sessions of events, in batch and as a stream."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import drop_saved, save


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """key, started, ended, n of the bursts of each key: a new one begins after more than the gap."""
    by = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(by)) > int(gap_seconds * 1_000_000), F.lit(True)).cast("long")
    numbered = events.select(key, ts, new.alias("new")).withColumn("burst", F.sum("new").over(by))
    return numbered.groupBy(key, "burst").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("burst")


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the source files of a folder (tests left out) as they come, each path once: path, modificationTime. ``Watcher`` sees edits and deletions too."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "modificationTime").filter(F.col("path").rlike(r"\.(ts|svelte)$") & ~F.col("path").endswith(".test.ts"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime (microseconds), length of the source files of a folder as they are now, tests left out; nothing is read of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select("path", F.unix_micros("modificationTime").alias("mtime"), "length")
    return files.filter(F.col("path").rlike(r"\.(ts|svelte)$") & ~F.col("path").endswith(".test.ts"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, kind (``new``, ``edited``, ``gone``) of what differs between two listings; a renamed file is gone and new."""
    old = before.select("path", F.struct("mtime", "length").alias("old"))
    both = old.join(now.select("path", F.struct("mtime", "length").alias("now")), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("old") != F.col("now"), "edited")
    return both.select("path", kind.alias("kind")).filter("kind IS NOT NULL")


class Watcher:
    """Calls ``rebuild(changes)`` once after each burst of edits, new files and deletions below a folder.

    Two listings are kept: of the last look, and of the last rebuild, the latter as a table under ``state``, so that a
    watcher that is started again rebuilds what changed meanwhile. A look that differs from the last one goes on with the
    burst; when looks have been alike for ``gap`` seconds and differ from the last rebuild, that is the burst's end.
    """

    def __init__(self, spark: SparkSession, folder: str, rebuild: Callable[[DataFrame], None], state: str, gap: float = 0.4, clock: Callable[[], float] = time.monotonic):
        self.spark, self.folder, self.rebuild, self.state, self.gap, self.clock = spark, folder, rebuild, state.rstrip("/"), gap, clock
        self.built, self.seen, self.quiet_since = None, None, clock()

    def _last_built(self) -> DataFrame | None:
        with contextlib.suppress(Exception):  # no state yet
            turn = self.spark.read.parquet(f"{self.state}/turns").agg(F.max("turn")).first()[0]
            return self.spark.read.parquet(f"{self.state}/built-{turn}")
        return None

    def _keep(self, now: DataFrame) -> None:
        turn = time.time_ns()
        now.coalesce(1).write.parquet(f"{self.state}/built-{turn}")
        self.spark.createDataFrame([(turn,)], "turn long").coalesce(1).write.mode("append").parquet(f"{self.state}/turns")
        if self.built is not None and self.built is not now:
            drop_saved(self.built)
        self.built = now

    def look(self) -> bool:
        """One look at the folder; whether it led to a rebuild."""
        now = save(listing(self.spark, self.folder), "listing")
        if self.built is None:
            self.built = self._last_built()
            if self.built is None:
                self._keep(now)
        if self.seen is None or not changes(self.seen, now).isEmpty():
            last, self.seen, self.quiet_since = self.seen, now, self.clock()
            if last is not None and last is not self.built:
                drop_saved(last)
        elif now is not self.built:
            drop_saved(now)
        if self.clock() - self.quiet_since < self.gap:
            return False
        found = save(changes(self.built, self.seen), "changes")
        changed = not found.isEmpty()
        if changed:
            self.rebuild(found)
            self._keep(self.seen)
        drop_saved(found)
        return changed

    def start(self, checkpoint: str, every: str = "200 milliseconds"):
        """A streaming query whose batches are looks, one each ``every``, until it is stopped."""
        ticks = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda batch, batch_id: self.look() and None).start()


def debounced(changes: DataFrame, gap: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst of a change stream (path, modificationTime): the session that ends with a quiet gap."""
    return changes.withWatermark("modificationTime", late).groupBy(F.session_window("modificationTime", gap)).agg(F.count("*").alias("n"))


def rebuild_on_change(bursts: DataFrame, rebuild: Callable[[int], None], checkpoint: str, every: str | None = None):
    """Starts a query that calls ``rebuild`` once for each batch of closed bursts.

    With ``every`` (as ``1 second``) it goes on until it is stopped; without, it ends with what is there.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            rebuild(batch_id)

    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
