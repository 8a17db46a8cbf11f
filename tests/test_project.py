"""Freshness of stored graphs, rebuilding, the file plane, commands and reports."""

import json
import os
import subprocess
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillon.cli import Commands
from quillon.extract import fsplane
from quillon.operators import endpoints, freshness, layout
from quillon.plans.dispatch import dispatch, respond
from quillon.sources import graph_json
from quillon.streaming import watch


def git(folder, *arguments):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *arguments], cwd=folder, check=True, capture_output=True)


@pytest.fixture
def checkout(tmp_path):
    folder = tmp_path / "work"
    folder.mkdir()
    git(folder, "init", "-q")
    (folder / "a.ts").write_text("export const a = 1;\n")
    (folder / "notes.md").write_text("n\n")
    git(folder, "add", ".")
    git(folder, "commit", "-qm", "one")
    return folder


def stamp(folder, ago=0.0, dirty=False, **more):
    built = datetime.now(timezone.utc) - timedelta(seconds=ago)
    return {"commit": freshness.head(str(folder)), "dirty": dirty, "generatedAt": built.isoformat(), "files": [{"file": "a.ts"}]} | more


def test_a_graph_of_the_commit_is_fresh(spark, checkout):
    assert freshness.check(spark, str(checkout), stamp(checkout)) == (False, "fresh")


def test_another_commit_is_stale(spark, checkout):
    old = stamp(checkout)
    (checkout / "a.ts").write_text("export const a = 2;\n")
    git(checkout, "commit", "-qam", "two")
    assert freshness.check(spark, str(checkout), old) == (True, "commit")


def test_edits_count_if_the_graph_covers_them_and_is_older(spark, checkout):
    (checkout / "notes.md").write_text("more\n")
    assert freshness.check(spark, str(checkout), stamp(checkout, ago=60)) == (False, "fresh")
    (checkout / "b.ts").write_text("export const b = 1;\n")
    assert freshness.check(spark, str(checkout), stamp(checkout, ago=60)) == (True, "files")
    assert freshness.check(spark, str(checkout), stamp(checkout, ago=-60)) == (False, "fresh")


def test_a_deleted_file_and_reverted_edits_are_stale(spark, checkout):
    assert freshness.check(spark, str(checkout), stamp(checkout, dirty=True)) == (True, "cleaned")
    os.remove(checkout / "a.ts")
    assert freshness.check(spark, str(checkout), stamp(checkout, ago=-60)) == (True, "files")


def test_what_is_not_known_is_fresh(spark, checkout, tmp_path):
    told = stamp(checkout)
    for folder, document, kind, reason in (
        (str(checkout), told, "filesystem", "filesystem"), (str(tmp_path / "none"), told, "code", "no git"), (None, told, "code", "no git"), (str(checkout), None, "code", "no graph"),
        (str(checkout), told | {"commit": None}, "code", "no stamp"),
    ):
        assert freshness.check(spark, folder, document, kind) == (False, reason)
    (checkout / "a.ts").write_text("changed\n")
    assert freshness.check(spark, str(checkout), told | {"generatedAt": "some day"})[0] is False


def test_names_of_changed_files(spark):
    lines = [" M a.ts", "R  old name.ts -> new.ts", '?? "with blank.ts"', "", "D  gone.ts"]
    got = [r["path"] for r in freshness.porcelain_paths(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == ["a.ts", "new.ts", "with blank.ts", "gone.ts"]


def test_one_run_at_a_time_for_each_project():
    seen, both, release = [], threading.Event(), threading.Event()

    def extract(name):
        seen.append(name)
        if len(seen) == 2:
            both.set()
        release.wait(10)
        return name != "bad"

    runs, results = freshness.Rebuilds(extract), {}
    threads = [threading.Thread(target=lambda i=i, n=n: results.__setitem__(i, runs.run(n))) for i, n in enumerate(["a", "a", "bad"])]
    for t in threads:
        t.start()
    assert both.wait(10) and runs.busy("a") and runs.busy() and runs.refresh("a", ["a", "bad"]) == (429, {"error": "already rebuilding"})
    time.sleep(0.2)
    release.set()
    for t in threads:
        t.join(10)
    assert sorted(seen) == ["a", "bad"] and results == {0: True, 1: True, 2: False} and not runs.busy()
    assert runs.refresh("x", ["a"]) == (400, {"error": "unknown project"}) and runs.refresh(None, []) == (400, {"error": "unknown project"})
    assert runs.refresh(None, ["a"]) == (200, {"ok": True}) and runs.refresh("bad", ["bad"]) == (500, {"error": "extract failed"})


def test_fresh_after_a_rebuild_only_if_a_second_look_says_so():
    answers = iter([True, False, True, True, True])
    runs = freshness.Rebuilds(lambda name: name != "bad")
    stale = lambda name: next(answers)
    assert runs.ensure_fresh("a", stale) == {"rebuilt": True, "stale": False}
    assert runs.ensure_fresh("a", stale) == {"rebuilt": True, "stale": True}
    assert runs.ensure_fresh("bad", stale) == {"rebuilt": False, "stale": True} and runs.ensure_fresh(None, stale) == {"rebuilt": False, "stale": False}


def test_a_stored_graph_is_read_again_when_it_changed(tmp_path):
    path, loads = tmp_path / "g.json", []
    path.write_text("1")
    held = freshness.Held(lambda: loads.append(1) or len(loads), str(path))
    assert held.get() == held.get() == 1
    path.write_text("22")
    assert held.get() == 2
    path.unlink()
    assert held.get() == 2


def test_a_folder_tree(spark, tmp_path):
    files = {
        "notes/a.md": "see [[b]] and [[c|sea]] and [[nothing]] [d](../.docs/d.md#top) [e](gone.md)", "notes/b.md": "[[a]]", "deep/c.mdx": "", ".docs/d.md": "[[a.md]]",
        "units/web.service": "[Unit]\nAfter=net.target, db.service\nWants=db.service  log.socket\nDescription=a.md\n", "units/db.service": "", "units/net.target": "", "units/log.socket": "",
        "big.md": "[[b]]" + "x" * 3000, "skip/node_modules/x.md": "[[b]]", "run.sh": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "notes", tmp_path / "again")
    config = fsplane.FsConfig(ignore=("node_modules",), extensions=("md", "mdx"), most_bytes=2000, stale_days=0)
    g = fsplane.graph(fsplane.walk(spark, f"file://{tmp_path}", config), config, F.current_timestamp())
    got = {r["id"]: r for r in g.nodes.collect()}
    assert set(got) == set(files) - {"skip/node_modules/x.md", "run.sh"} and {r["grp"] for r in got.values()} == {"notes", "docs", "systemd"}
    edges = {(r["src"], r["dst"]): r["cnt"] for r in g.edges.collect()}
    assert edges == {
        ("notes/a.md", "notes/b.md"): 1, ("notes/a.md", "deep/c.mdx"): 1, ("notes/a.md", ".docs/d.md"): 1, ("notes/b.md", "notes/a.md"): 1, (".docs/d.md", "notes/a.md"): 1,
        ("units/web.service", "units/net.target"): 1, ("units/web.service", "units/db.service"): 2, ("units/web.service", "units/log.socket"): 1,
    }
    assert got["units/db.service"]["in_degree"] == 2 and all(r["stale"] for r in got.values())
    order = [r["id"] for r in g.nodes.orderBy("node_ord").collect()]
    assert order == sorted(order, key=lambda p: p.split("/")) and sorted(r["edge_ord"] for r in g.edges.collect()) == list(range(8))


def test_commands(spark, tmp_path):
    root, said = tmp_path / "p", []
    (root / "src/lib/core").mkdir(parents=True)
    (root / "src/lib/core/one.ts").write_text("export function one() {\n  return two();\n}\nfunction two() {\n  return 2;\n}\n")
    (root / "project.json").write_text(json.dumps({"name": "p", "layers": {"core": 0}}))
    c = Commands(spark, str(tmp_path / "data"), said.append)
    with pytest.raises(SystemExit):
        c.extract(None)
    assert c.onboard(str(root)) == 0 and c.list() == 0 and said[-1].startswith("p\t")
    assert c.extract("p") == 0 and graph_json.list_graphs(str(tmp_path / "data")) == ["p"]
    assert c.check("p") == 0 and "✓ cycle" in said[-1] and c.diff("p") == 2
    assert c.snapshot("p") == 0 and c.diff("p") == 0 and "No structural changes." in said[-1]
    (root / "src/lib/core/one.ts").write_text("export function one() {\n  return 1;\n}\nfunction two() {\n  return 2;\n}\nfunction three() {}\n")
    assert c.diff("p") == 0 and "▲ core/one 2 → 3 fns" in said[-1]
    assert c.check("p") == 0 and c.check("p", strict=True) == 1 and "core/one::two is never called" in said[-1]
    with pytest.raises(SystemExit):
        c.check("none")
    assert c.watch("p", every=None) == 0


def test_service_answers(spark, tmp_path):
    n = [(i, f"m::{x}@{i}#0", x, x, "src/m.ts", "m", "core", i, "function", True, "", "", x, "", 1, 1, 0, False, 0, 0) for i, x in enumerate("ab")]
    nodes = spark.createDataFrame(n, "node_ord long, id string, name string, short string, file string, module string, grp string, line long, kind string, exported boolean, signature string, doc string, humanized string, descr string, loc long, chars long, numeric_ops long, tested boolean, in_degree long, out_degree long")
    edges = spark.createDataFrame([(0, n[0][1], n[1][1], 2)], "edge_ord long, src string, dst string, cnt long")
    g = graph_json.empty(spark, __import__("quillon.config", fromlist=["Config"]).Config(name="two")).having(nodes=nodes, edges=edges)
    graphs = {"two": lambda: g, "lost": lambda: None}
    assert respond(graphs, "/stats")[0] == 200 and respond(graphs, "/stats", {"project": "lost"})[:2] == (503, {"error": "graph not built yet", "projects": ["two", "lost"]})
    assert respond(graphs, "/stats", method="POST")[0] == 405 and respond(graphs, "/stats", method="OPTIONS")[0] == 204
    status, text, headers = respond(graphs, "/function", {"name": "a", "format": "md"})
    assert status == 200 and "## Calls (1)\n- b (m)" in text and headers["Content-Type"].startswith("text/markdown")
    assert "## Functions\n- " in respond(graphs, "/module", {"name": "m", "format": "md"})[1] and "1. a (m)" in respond(graphs, "/path", {"from": "a", "to": "b", "format": "md"})[1]
    assert respond(graphs, "/search", {"q": "a", "format": "md"})[1].startswith("# Search: a") and respond(graphs, "/function", {"name": "z", "format": "md"})[0] == 404
    placed = {r["id"]: (r["x"], r["y"]) for r in layout.force_layout(g, rounds=4).collect()}
    start = {r["id"]: (r["x"], r["y"]) for r in endpoints.layout_seed(g).collect()}
    apart = lambda p: sum((a - b) ** 2 for a, b in zip(*p.values(), strict=True)) ** 0.5
    assert apart(placed) < apart(start)


def test_changes_of_a_folder_are_seen(spark, tmp_path):
    folder, now, built = tmp_path / "src", [0.0], []
    (folder / "deep").mkdir(parents=True)
    for name in ("a.ts", "b.ts", "deep/c.svelte", "a.test.ts", "note.md"):
        (folder / name).write_text("one")
    make = lambda: watch.Watcher(spark, str(folder), lambda found: built.append({(r["path"].rsplit("/", 1)[-1], r["kind"]) for r in found.collect()}), str(tmp_path / "state"), clock=lambda: now[0])
    w = make()

    def look(after: float) -> bool:
        now[0] += after
        return w.look()

    assert not look(0) and not look(1) and built == []
    (folder / "a.ts").write_text("edited")
    assert not look(0.1) and not look(0.3) and look(0.2) and not look(5)
    (folder / "b.ts").unlink()
    (folder / "a.test.ts").write_text("no source")
    assert not look(0.1) and look(0.5) and not look(5)
    for i in range(3):  # a burst: one rebuild after its end
        (folder / f"n{i}.ts").write_text("new")
        assert not look(0.3)
    (folder / "deep/c.svelte").rename(folder / "deep/d.svelte")
    assert not look(0.3) and not look(0.3) and look(0.2)
    assert built == [{("a.ts", "edited")}, {("b.ts", "gone")}, {("n0.ts", "new"), ("n1.ts", "new"), ("n2.ts", "new"), ("c.svelte", "gone"), ("d.svelte", "new")}]
    (folder / "n0.ts").write_text("while nobody watched")
    w = make()  # started again: what changed meanwhile is built
    assert not look(0) and look(1) and built[-1] == {("n0.ts", "edited")}


def test_a_watching_query_rebuilds_once_for_an_edit(spark, tmp_path):
    folder, built = tmp_path / "src", []
    folder.mkdir()
    (folder / "a.ts").write_text("one")
    w = watch.Watcher(spark, str(folder), lambda found: built.append({(r["path"].rsplit("/", 1)[-1], r["kind"]) for r in found.collect()}), str(tmp_path / "state"))
    query = w.start(str(tmp_path / "ticks"))

    def until(n: int) -> None:
        for _ in range(300):
            if len(built) >= n and w.clock() - w.quiet_since > 1:
                break
            time.sleep(0.1)

    try:
        for _ in range(300):
            if w.built is not None:
                break
            time.sleep(0.1)
        (folder / "a.ts").write_text("edited")
        until(1)
        (folder / "a.ts").unlink()
        until(2)
    finally:
        query.stop()
    assert built == [{("a.ts", "edited")}, {("a.ts", "gone")}]


def test_refresh_through_the_service(spark):
    g, began, go = graph_json.empty(spark, config_of("one")), threading.Event(), threading.Event()

    def extract(project):
        began.set()
        go.wait(20)
        return project != "bad"

    rebuilds = freshness.Rebuilds(extract)
    graphs = {"one": lambda: g, "bad": lambda: None}
    ask = lambda path, method="GET", **p: respond(graphs, path, p, method, rebuilds)[:2]
    assert ask("/refresh", "POST", project="none") == (400, {"error": "unknown project"}) and ask("/stats", "POST")[0] == 405
    assert ask("/stats")[1]["rebuild"] == {"state": "idle", "began": None, "ended": None}
    answers = []
    worker = threading.Thread(target=lambda: answers.append(ask("/refresh", "POST")))
    worker.start()
    assert began.wait(20) and ask("/refresh", "POST") == (429, {"error": "already rebuilding"})
    status, body = ask("/stats")
    assert status == 200 and body["rebuild"]["state"] == "running" and body["functions"] == 0
    go.set()
    worker.join()
    assert answers == [(200, {"ok": True})]
    assert ask("/refresh", "POST", project="bad") == (500, {"error": "extract failed"})
    assert ask("/stats", project="bad")[0] == 503 and ask("/stats", project="bad")[1]["rebuild"]["state"] == "failed" and ask("/stats")[1]["rebuild"]["state"] == "idle"
    assert "POST" in respond(graphs, "/stats", method="OPTIONS", rebuilds=rebuilds)[2]["Access-Control-Allow-Methods"]


def config_of(name):
    from quillon.config import Config

    return Config(name=name)


def test_listing_goes_down_level_by_level(spark, tmp_path):
    for name in ("a/b/c/d/e.md", "a/b/x.md", ".hid/_den/y.md", "skip/z.md", "a/skip/w.md", "top.md", "empty.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name if name != "empty.md" else "")
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "top.md", tmp_path / "other.md")
    os.utime(tmp_path / "top.md", (1_700_000_000, 1_700_000_000.5))
    got = {r["path"]: (r["size"], r["mtime"]) for r in fsplane.listing(spark, str(tmp_path), ("skip",)).collect()}
    assert set(got) == {"a/b/c/d/e.md", "a/b/x.md", ".hid/_den/y.md", "top.md", "empty.md"}
    assert got["top.md"] == (6, datetime.fromtimestamp(1_700_000_000.5)) and got["empty.md"][0] == 0
    walked = {r["path"]: r["text"] for r in fsplane.walk(spark, f"file://{tmp_path}", fsplane.FsConfig(ignore=("skip",), most_bytes=10)).collect()}
    assert walked == {"a/b/c/d/e.md": None, "a/b/x.md": "a/b/x.md", ".hid/_den/y.md": None, "top.md": "top.md", "empty.md": ""}
    assert fsplane.listing(spark, str(tmp_path / "nowhere")).collect() == []


def test_documents_are_written_by_tasks(spark, tmp_path):
    n = [(i, f"id{i}", f"né\n\"{i}", f"s{i}", "f", "m", "g", i, "function", None if i % 2 else "C", True) for i in range(300)]
    nodes = spark.createDataFrame(n, "node_ord long, id string, name string, short string, file string, module string, grp string, line long, kind string, class_name string, exported boolean").repartition(7)
    edges = spark.createDataFrame([(i, f"id{i}", f"id{i + 1}", i) for i in range(299)], "edge_ord long, src string, dst string, cnt long").repartition(5)
    none = spark.createDataFrame([], "mod_ord long, module string, grp string, file string, fns long")
    g = graph_json.empty(spark, config_of("doc")).having(nodes=nodes, edges=edges, given_module_nodes=none, given_module_edges=edges.limit(0).withColumnRenamed("edge_ord", "medge_ord"), given_files=none.limit(0).withColumnRenamed("mod_ord", "file_ord"))
    graph_json.write(g, str(tmp_path / "doc.json"), root="/r")
    raw = (tmp_path / "doc.json").read_text()
    told = json.loads(raw)
    assert raw == json.dumps(told, ensure_ascii=False) and told["root"] == "/r" and told["stats"] == {"files": 0, "functions": 300, "edges": 299, "modules": 0}
    assert [x["id"] for x in told["nodes"]] == [f"id{i}" for i in range(300)] and told["nodes"][1] == {"id": "id1", "name": 'né\n"1', "short": "s1", "file": "f", "module": "m", "group": "g", "line": 1, "kind": "function", "className": None, "exported": True}
    assert told["edges"][7] == {"from": "id7", "to": "id8", "count": 7} and told["moduleNodes"] == [] and list(told)[-5:] == ["nodes", "edges", "moduleNodes", "moduleEdges", "files"]
    assert os.listdir(tmp_path) == ["doc.json"]


def test_answers_have_the_keys_that_clients_know(spark):
    n = [(i, f"{m}::{x}@{i}#0", x, x, f"src/{m}.ts", m, "core", i, i + 1, "function", None, True, "f()", "", x, x, 2, 9, 3, i == 0, i, 0, 1) for i, (x, m) in enumerate([("ab", "core/m"), ("ac", "core/m"), ("b", "core/n")])]
    nodes = spark.createDataFrame(n, "node_ord long, id string, name string, short string, file string, module string, grp string, line long, end_line long, kind string, class_name string, exported boolean, signature string, doc string, humanized string, descr string, loc long, chars long, numeric_ops long, tested boolean, test_depth long, in_degree long, out_degree long")
    edges = spark.createDataFrame([(0, n[0][1], n[2][1], 2)], "edge_ord long, src string, dst string, cnt long")
    g = graph_json.empty(spark, config_of("keys")).having(nodes=nodes, edges=edges)
    ask = lambda path, **p: dispatch(g, path, p)[1]
    row = {"id", "name", "module", "group", "kind", "exported", "tested", "testDepth", "file", "line", "loc", "chars", "numeric", "description", "descriptionSource", "inDegree", "outDegree"}
    ref, module = {"name", "module", "file", "line", "description"}, {"module", "fullModule", "group", "file", "functionCount", "description", "loc", "chars", "dependsOnCount", "usedByCount"}
    assert set(ask("/functions")["functions"][0]) == row and set(ask("/functions")) == {"count", "sort", "functions"}
    one = ask("/function", name="ab")
    assert set(one) == row | {"signature", "calls", "calledBy"} and set(one["calls"][0]) == ref and one["numeric"] == 3
    assert set(ask("/function", name="a")) == {"ambiguous", "query", "matches"} and set(ask("/callers", name="a")) == {"ambiguous", "matches"} and set(ask("/path", **{"from": "a", "to": "b"})["matches"][0]) == row
    assert set(ask("/callees", name="ab")) == {"function", "module", "callees"} and set(ask("/callees", name="ab")["callees"][0]) == ref
    assert all(set(m) == module for m in ask("/modules")["modules"])
    own = ask("/module", name="m")
    assert set(own) == module | {"dependsOn", "usedBy", "functions"} and own["dependsOn"] == [{"module": "core/n", "callSites": 2}] and set(own["functions"][0]) == {"name", "line", "inDegree", "description"}
    assert set(ask("/search", q="a")["functions"][0]) == row and set(ask("/search", q="core")["modules"][0]) == module
    hubs = ask("/hubs")
    assert set(hubs["mostCalledFunctions"][0]) == row and set(hubs["mostDependedOnModules"][0]) == module | {"incomingCallSites"}
    assert set(ask("/calls")["calls"][0]) == {"caller", "callee", "fromModule", "toModule", "count", "crossModule", "callerId", "calleeId"}
    assert set(ask("/files")["files"][0]) >= {"file", "module", "group", "functions", "loc", "chars"} and set(ask("/path", **{"from": "ab", "to": "b"})["path"][0]) == ref
    assert set(ask("/port-candidates")["candidates"][0]) == {"module", "fullModule", "group", "functions", "loc", "numericOps", "couplingToHigherLayers", "hottestFunction", "score"}
    dump = ask("/graph")
    assert set(dump["nodes"][0]) == row and dump["edges"] == [{"from": n[0][1], "to": n[2][1], "count": 2}] and dump["moduleEdges"] == [{"from": "core/m", "to": "core/n", "count": 2}]
