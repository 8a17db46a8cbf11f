"""Commands: onboard <folder>, list, extract [name], check [name] [--strict], diff [name], snapshot [name], watch [name].

Graphs and the registry of projects are in the folder of ``--data`` (``data`` by default).
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import load_project
from .extract import build, fsplane
from .graph import Graph
from .operators import freshness
from .plans import reports
from .sources import graph_json
from .streaming import watch

SETTINGS = "project.json"


class Commands:
    def __init__(self, spark: SparkSession, data: str, say=print):
        self.spark, self.data, self.say = spark, data, say
        os.makedirs(data, exist_ok=True)
        self.registry_path = os.path.join(data, "projects.registry")

    def registered(self, name: str | None):
        rows = graph_json.read_registry(self.spark, self.registry_path).orderBy("name").collect()
        found = [r for r in rows if r["name"] == name] if name else rows[:1]
        if not found:
            raise SystemExit(f"unknown project: {name}" if name else "no projects onboarded")
        return found[0]

    def onboard(self, folder: str) -> int:
        """Registers a folder with project settings: machine by the settings, else as registered, else (files) the host."""
        place = os.path.abspath(folder)
        project = load_project(os.path.join(place, SETTINGS))
        old = graph_json.read_registry(self.spark, self.registry_path)
        known = {r["name"]: r for r in old.collect()}
        name = project.config.name
        machine = project.machine or (known[name]["machine"] if name in known else None)
        if not machine and project.kind == "filesystem":
            machine = project.told.get("host") or name
        graph_json.write_registry(graph_json.register(old, {"name": name, "path": place, "kind": project.kind, "machine": machine}), self.registry_path)
        self.say(f"Onboarded {name} [{project.kind}{' @ ' + machine if machine else ''}] -> {place}")
        return 0

    def list(self) -> int:
        rows = graph_json.read_registry(self.spark, self.registry_path).orderBy("name").collect()
        for r in rows:
            self.say(f"{r['name']}\t{r['path']}")
        if not rows:
            self.say("(no projects onboarded)")
        return 0

    def build(self, name: str | None) -> Graph:
        r = self.registered(name)
        project = load_project(os.path.join(r["path"], SETTINGS))
        now = datetime.now(timezone.utc)
        if project.kind == "filesystem":
            t = project.told
            c = fsplane.FsConfig(project.config.name, t.get("host") or "local", tuple(t.get("ignore") or ()), tuple(t.get("extensions") or ()), tuple(t.get("nameGlobs") or ()), int(t.get("maxFileSize") or 1 << 20), int(t.get("staleDays") or 90))
            g = fsplane.graph(fsplane.walk(self.spark, t.get("root") or r["path"], c), c, F.lit(now).cast("timestamp"))
        else:
            g, warnings = build.extract_project(self.spark, r["path"], project)
            for w in warnings.collect():
                self.say(f"WARNING: {w['what']}: {w['subject']}")
        dirty = bool(freshness.changed_paths(self.spark, r["path"]).take(1)) if freshness.head(r["path"]) else False
        graph_json.write(g, f"{self.data}/{project.config.name}.json", generatedAt=now.isoformat(), root=r["path"], commit=freshness.head(r["path"]), dirty=dirty)
        return g

    def extract(self, name: str | None) -> int:
        names = [name] if name else [r["name"] for r in graph_json.read_registry(self.spark, self.registry_path).orderBy("name").collect()]
        if not names:
            raise SystemExit("no projects onboarded")
        for n in names:
            self.build(n)
        return 0

    def check(self, name: str | None, strict: bool = False) -> int:
        text, status = reports.check_report(self.build(name), strict, None)
        self.say(text)
        return status

    def snapshot(self, name: str | None) -> int:
        g = self.build(name)
        self.say(f"saved {graph_json.snapshot(self.data, g.config.name)}")
        return 0

    def diff(self, name: str | None) -> int:
        g = self.build(name)
        old = f"{self.data}/{g.config.name}.snapshot.json"
        if not os.path.exists(old):
            self.say(f"No snapshot for {g.config.name}. Create one first: snapshot {g.config.name}")
            return 2
        self.say(reports.diff_report(graph_json.read(self.spark, old), g)[0])
        return 0

    def watch(self, name: str | None, every: str | None = "200 milliseconds") -> int:
        """Builds again after each burst of changed, new or deleted sources, until it is stopped (``every`` unset: one look)."""
        r = self.registered(name)
        project = load_project(os.path.join(r["path"], SETTINGS))
        self.build(r["name"])
        state = os.path.join(self.data, f".watch-{r['name']}-{os.getpid()}")
        watcher = watch.Watcher(self.spark, os.path.join(r["path"], project.component_root), lambda changed: self.build(r["name"]), f"{state}/state")
        if every:
            watcher.start(f"{state}/ticks", every).awaitTermination()
        else:
            watcher.look()
        return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    parser.add_argument("--data", default="data")
    parser.add_argument("verb", choices=["onboard", "list", "extract", "check", "diff", "snapshot", "watch"])
    parser.add_argument("name", nargs="?")
    parser.add_argument("--strict", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    commands = Commands(spark, given.data)
    if given.verb == "list":
        return commands.list()
    if given.verb == "onboard" and not given.name:
        raise SystemExit("usage: onboard <folder>")
    if given.verb == "check":
        return commands.check(given.name, given.strict)
    return getattr(commands, given.verb)(given.name)


if __name__ == "__main__":
    sys.exit(main())
