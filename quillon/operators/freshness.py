"""Whether a stored graph still describes its checkout, and rebuilding it: one run at a time for each project."""

from __future__ import annotations

import subprocess
import threading
import time
from collections.abc import Callable, Mapping
from concurrent.futures import Future
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import diff

GIT_SECONDS = 4.0
META = "kind string, has_git boolean, has_graph boolean, graph_commit string, head_commit string, built_dirty boolean, dirty_now boolean, built timestamp"


def _git(folder: str, *arguments: str) -> str | None:
    try:
        done = subprocess.run(["git", *arguments], cwd=folder, capture_output=True, text=True, timeout=GIT_SECONDS, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout


def head(folder: str) -> str | None:
    """The commit a checkout is on; None where there is no folder, no git or no answer in time."""
    told = _git(folder, "rev-parse", "HEAD") if Path(folder).is_dir() else None
    return told.strip() if told else None


def porcelain_paths(status: DataFrame) -> DataFrame:
    """path of every line (column ``line``) of a short status: behind the two marks, of a rename the new one, without quotes."""
    path = F.trim(F.substring("line", 4, 1 << 20))
    path = F.when(F.instr(path, " -> ") > 0, F.expr("substring(trim(substring(line, 4)), instr(trim(substring(line, 4)), ' -> ') + 4)")).otherwise(path)
    return status.filter("line <> ''").select(F.regexp_replace(path, '^"|"$', "").alias("path"))


def changed_paths(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime (null: gone) of what git reports as changed in a checkout."""
    lines = (_git(folder, "status", "--porcelain") or "").split("\n")
    names = [r["path"] for r in porcelain_paths(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    found = []
    for name in names:
        place = Path(folder, name)
        found.append((name, datetime.fromtimestamp(place.stat().st_mtime) if place.exists() else None))
    return spark.createDataFrame(found, "path string, mtime timestamp")


def check(spark: SparkSession, folder: str | None, document: Mapping[str, Any] | None, kind: str = "code") -> tuple[bool, str]:
    """Whether the graph document is behind the checkout, and why; what can't be known counts as fresh."""
    now = head(folder) if folder and kind != "filesystem" else None
    document = document or {}
    has_graph = bool(document)
    none = spark.createDataFrame([], "path string, mtime timestamp")
    changed = changed_paths(spark, folder) if now and document.get("commit") == now else none
    dirty = bool(changed.take(1))
    stamp = document.get("generatedAt")
    built = None
    if stamp:
        try:
            built = datetime.fromisoformat(str(stamp).replace("Z", "+00:00"))
        except ValueError:
            built = None
    files = [f["file"] for f in document.get("files") or ()]
    known = spark.createDataFrame([(f,) for f in files], "file string")
    suffixes = sorted({f[f.rfind(".") :] for f in files if "." in f})
    meta = spark.createDataFrame([(kind, now is not None, has_graph, document.get("commit"), now, bool(document.get("dirty")), dirty, built)], META)
    late = diff.changed_files_stale(changed, known, suffixes, F.lit(built).cast("timestamp")) if built else none
    told = diff.is_stale(meta, late).first()
    return told["stale"], told["reason"]


class Rebuilds:
    """Runs ``extract(project)`` once for all who ask at a time; different projects run side by side.

    ``jobs`` tells of each project how its last run stands, as long as the service lives: ``running``, ``idle`` or ``failed``.
    """

    def __init__(self, extract: Callable[[str], Any]):
        self.extract, self.lock = extract, threading.Lock()
        self.running: dict[str, Future] = {}
        self.jobs: dict[str, dict[str, Any]] = {}

    def state(self, project: str) -> dict[str, Any]:
        """state, and when the last run began and ended (seconds; null where there was none)."""
        with self.lock:
            return {"state": "idle", "began": None, "ended": None} | self.jobs.get(project, {})

    def busy(self, project: str | None = None) -> bool:
        with self.lock:
            return project in self.running if project else bool(self.running)

    def run(self, project: str) -> bool:
        """Whether the run, an own one or the one under way, went well."""
        with self.lock:
            mine = project not in self.running
            future = self.running.setdefault(project, Future())
            if mine:
                self.jobs[project] = {"state": "running", "began": time.time()}
        if mine:
            try:
                done = self.extract(project) is not False
            except Exception:  # noqa: BLE001 - a failed run is told as such
                done = False
            with self.lock:
                del self.running[project]
                self.jobs[project] |= {"state": "idle" if done else "failed", "ended": time.time()}
            future.set_result(done)
        return future.result()

    def ensure_fresh(self, project: str | None, stale: Callable[[str], bool]) -> dict[str, bool]:
        """Rebuilds a stale project and looks again: a run that went well may have built another revision."""
        if not project or not stale(project):
            return {"rebuilt": False, "stale": False}
        done = self.run(project)
        return {"rebuilt": done, "stale": not done or stale(project)}

    def refresh(self, project: str | None, projects: list[str]) -> tuple[int, dict]:
        """A rebuild by hand: 400 for an unknown project, 429 while one is running, 500 where it fails."""
        project = project if project is not None else (projects[0] if projects else None)
        if not project or project not in projects:
            return 400, {"error": "unknown project"}
        if self.busy(project):
            return 429, {"error": "already rebuilding"}
        return (200, {"ok": True}) if self.run(project) else (500, {"error": "extract failed"})


class Held:
    """A stored graph that is read again when its file has changed."""

    def __init__(self, load: Callable[[], Any], path: str):
        self.load, self.path, self.seen, self.value = load, path, None, None

    def get(self) -> Any:
        try:
            stat = Path(self.path).stat()
        except OSError:
            return self.value
        now = (stat.st_mtime_ns, stat.st_size)
        if now != self.seen:
            self.value, self.seen = self.load(), now
        return self.value
