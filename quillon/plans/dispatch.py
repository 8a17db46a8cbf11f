"""Queries by path and parameters, as a service would offer them. Bodies are plain Python values."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import num
from ..graph import Graph
from ..operators import endpoints, paths, rollups, rules, view
from ..operators.freshness import Rebuilds

ENDPOINTS = (
    "/stats /graph /modules /module /functions /function /callers /callees /search /path /hubs /check /recommendations /port-candidates /orphans /duplicates /files /calls".split()
)


def _rows(df: DataFrame, order: str = "rank", drop: tuple[str, ...] = ("rank", "node_ord")) -> list[dict[str, Any]]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if k not in drop} for r in (df.orderBy(order) if order in df.columns else df).collect()]


def _error(status: int, message: str, **more: Any) -> tuple[int, dict]:
    return status, {"error": message, **more}


HEADERS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, OPTIONS", "Cache-Control": "no-store"}


def respond(
    graphs: Mapping[str, Callable[[], Graph | None]], path: str, params: Mapping[str, str] | None = None, method: str = "GET", rebuilds: Rebuilds | None = None
) -> tuple[int, dict | str, dict[str, str]]:
    """(status, body, headers) for a service with several graphs: ``project`` picks one, the first by default.

    204 for OPTIONS, 405 for other methods than GET, 503 and the known projects where there is no such graph. With
    ``rebuilds``, which outlives requests, POST /refresh builds a project's graph again (400 for an unknown project, 429 while
    it is being built, 500 where that fails), and /stats and answers of 503 tell how that stands.
    """
    kind = {"Content-Type": "application/json; charset=utf-8"} | HEADERS
    if rebuilds:
        kind |= {"Access-Control-Allow-Methods": "GET, POST, OPTIONS"}
    if method == "OPTIONS":
        return 204, "", kind
    params = dict(params or {})
    if method == "POST" and rebuilds and path.rstrip("/") == "/refresh":
        return *rebuilds.refresh(params.get("project"), list(graphs)), kind
    if method != "GET":
        return 405, {"error": "GET only"}, kind
    name = params.pop("project", None) or next(iter(graphs), None)
    job = {"rebuild": rebuilds.state(name)} if rebuilds and name in graphs else {}
    g = graphs[name]() if name in graphs else None
    if g is None:
        return 503, {"error": "graph not built yet", "projects": list(graphs)} | job, kind
    if params.pop("format", None) == "md" and (text := markdown(g, path, params)) is not None:
        return 200, text, kind | {"Content-Type": "text/markdown; charset=utf-8"}
    status, body = dispatch(g, path, params)
    return status, body | job if path.rstrip("/") == "/stats" else body, kind


def markdown(g: Graph, path: str, params: Mapping[str, str]) -> str | None:
    """The answer of /function, /module, /search and /path as Markdown; None where there is none in that form."""
    p = path.rstrip("/")
    status, body = dispatch(g, path, params)
    if status != 200 or body.get("ambiguous"):
        return None
    if p == "/function":
        return view.function_markdown(g, g.nodes.filter(F.col("id") == body["id"]).select("id")).first()["markdown"]
    if p == "/module":
        return view.module_markdown(g).filter(F.col("module") == body["fullModule"]).first()["markdown"]
    if p == "/search":
        listed = [(title, body[key]) for title, key in (("Functions", "functions"), ("Modules", "modules"))]
        parts = [f"# Search: {body['query']}"]
        for title, rows in listed:
            parts += ["", f"## {title} ({len(rows)})", *(f"- {r.get('name') or r.get('fullModule')} — {r['description']}" for r in rows)]
        return "\n".join(parts)
    if p == "/path":
        steps = [f"{i}. {s['name']} ({s['module']})" for i, s in enumerate(body.get("path") or [], 1)]
        return "\n".join([f"# {body['from']} → {body['to']}", "", *(steps or ["not reachable"])])
    return None


#: Columns whose keys in an answer aren't their names in camel case (fixed values of the format).
_KEYS = {"grp": "group", "numeric_ops": "numeric", "cnt": "count", "src": "from", "dst": "to", "coupling": "couplingToHigherLayers"}


def _keyed(value: Any, special: Mapping[str, str]) -> Any:
    """An answer with the keys that clients know."""
    if isinstance(value, list):
        return [_keyed(x, special) for x in value]
    if not isinstance(value, dict):
        return value
    camel = lambda k: re.sub(r"_([a-z])", lambda m: m[1].upper(), k)
    return {special.get(k) or camel(k): _keyed(v, special) for k, v in value.items()}


def dispatch(g: Graph, path: str, params: Mapping[str, str] | None = None) -> tuple[int, dict]:
    """(status, body) of one query. Lists are cut before they come to the driver; ``count`` is from before the cut."""
    status, body = _answer(g, path, params)
    return status, _keyed(body, _KEYS | ({"numeric_ops": "numericOps"} if path.rstrip("/") == "/port-candidates" else {}))


def _answer(g: Graph, path: str, params: Mapping[str, str] | None = None) -> tuple[int, dict]:
    p, q = path.rstrip("/"), params or {}
    limit = lambda d: int(num(q.get("limit"), d))
    if p == "":
        return 200, {"project": g.config.name, "endpoints": list(ENDPOINTS)}
    if p == "/stats":
        return 200, rollups.stats(g).first().asDict()
    if p == "/graph":
        edges = _rows(g.edges, "edge_ord", ("edge_ord",))
        return 200, {"nodes": _rows(endpoints.fn_rows(g), "node_ord"), "edges": edges, "modules": _rows(endpoints.module_summaries(g), "mod_ord", ("mod_ord",)), "moduleEdges": _rows(g.module_edges, "medge_ord", ("medge_ord",)), "files": _rows(g.files, "file_ord", ("file_ord",))}
    if p == "/modules":
        return 200, {"modules": _rows(endpoints.module_summaries(g), "mod_ord", ("mod_ord",))}
    if p == "/module":
        m = endpoints.resolve_module(g, q.get("name")).first()
        if not m:
            return _error(404, "module not found", hint="try /modules")
        body = _rows(endpoints.module_summaries(g).filter(F.col("full_module") == m["module"]), drop=("mod_ord",))[0]
        near = _rows(endpoints.module_neighbours(g).filter(F.col("module") == m["module"]), drop=("module", "rank"))
        sides = {side: [{"module": r["other"], "callSites": r["call_sites"]} for r in near if r["direction"] == side] for side in ("depends_on", "used_by")}
        own = endpoints.fn_rows(g).filter(F.col("module") == body["module"]).orderBy(F.desc("in_degree"), "node_ord").select("name", "line", "in_degree", "description")
        return 200, body | sides | {"functions": [r.asDict() for r in own.collect()]}
    if p == "/functions":
        kw = {"module": q.get("module"), "q": q.get("q"), "kind": q.get("kind"), "group": q.get("group"), "exported": q.get("exported"), "tested": q.get("tested"), "test_reachable": q.get("testReachable")}
        kw["max_test_depth"] = num(q["maxTestDepth"], 0) if "maxTestDepth" in q else None
        sort = q.get("sort", "indegree")
        everything = endpoints.functions(g, sort=sort, limit=None, **kw)
        return 200, {"count": everything.count(), "sort": sort, "functions": _rows(endpoints.functions(g, sort=sort, limit=limit(100), **kw))}
    if p in ("/function", "/callers", "/callees"):
        name = (q.get("id") or q.get("name")) if p == "/function" else (q.get("name") or q.get("id"))
        if not name and p == "/function":
            return _error(400, "provide name or id")
        hits = endpoints.resolve_functions(g, name).orderBy("node_ord").select("id", "short", g.short_module().alias("module")).collect()
        if not hits:
            return _error(404, f'no function matches "{name}"')
        if len(hits) > 1:
            matches = endpoints.fn_rows(g).filter(F.col("id").isin([h["id"] for h in hits]))
            return 200, {"ambiguous": True} | ({"query": name} if p == "/function" else {}) | {"matches": _rows(matches, "node_ord")}
        if p == "/function":
            one = g.nodes.filter(F.col("id") == hits[0]["id"]).select("id")
            body = _rows(endpoints.fn_details(g, one), "node_ord")[0]
            refs = lambda callers: _rows(endpoints.neighbours(g, hits[0]["id"], callers), "edge_ord", ("edge_ord",))
            signature = g.nodes.filter(F.col("id") == hits[0]["id"]).first()["signature"]
            return 200, body | {"signature": signature, "calls": refs(False), "calledBy": refs(True)}
        refs = _rows(endpoints.neighbours(g, hits[0]["id"], p == "/callers"), "edge_ord", ("edge_ord",))
        return 200, {"function": hits[0]["short"], "module": hits[0]["module"], p[1:]: refs}
    if p == "/search":
        if not q.get("q"):
            return _error(400, "provide q")
        return 200, {"query": q["q"], "functions": _rows(endpoints.search_functions(g, q["q"], limit(20)), drop=("rank", "score", "node_ord")), "modules": _rows(endpoints.search_modules(g, q["q"], limit(20)), drop=("rank", "score", "mod_ord"))}
    if p == "/path":
        ends = {}
        for side in ("from", "to"):
            hits = endpoints.resolve_functions(g, q.get(side)).orderBy("node_ord").select("id", "short").collect()
            if not hits:
                return _error(404, f'{side}: no match for "{q.get(side)}"')
            ends[side] = hits
        for side, hits in ends.items():
            if len(hits) > 1:
                matches = endpoints.fn_rows(g).filter(F.col("id").isin([h["id"] for h in hits]))
                return 200, {"ambiguous": side, "matches": _rows(matches, "node_ord")}
        a, b = ends["from"][0], ends["to"][0]
        steps = paths.shortest_path(g, a["id"], b["id"], int(num(q.get("max"), 12))).orderBy("hop").collect()
        base = {"from": a["short"], "to": b["short"]}
        if not steps:
            return 200, base | {"reachable": False}
        refs = {r["id"]: r.asDict() for r in endpoints.fn_refs(g).filter(F.col("id").isin([s["id"] for s in steps])).collect()}
        return 200, base | {"hops": len(steps) - 1, "path": [{k: v for k, v in refs[s["id"]].items() if k != "id"} for s in steps]}
    if p == "/hubs":
        return 200, {"mostCalledFunctions": _rows(endpoints.hub_functions(g, limit(15))), "mostDependedOnModules": _rows(endpoints.hub_modules(g, limit(15)), drop=("rank", "mod_ord"))}
    if p == "/check":
        found = rules.run_checks(g).persist()
        totals = rules.finding_totals(found).first().asDict()
        rows = _rows(found, "rule_ord", ("rule_ord",))
        found.unpersist()
        return 200, totals | {"rules": rules.rule_list(g), "findings": rows}
    if p == "/recommendations":
        rows = rules.recommendations(g)
        order = rules.recommendation_order(rows).orderBy("rank").collect()
        found = _rows(rows)
        return 200, {"recommendations": [{"id": r["rec_id"], "severity": r["severity"], "findings": [{k: f[k] for k in ("id", "label", "sub")} for f in found if f["rec_id"] == r["rec_id"]]} for r in order]}
    if p == "/port-candidates":
        return 200, {"candidates": _rows(rules.port_candidates(g, limit(15)), drop=("rank", "mod_ord"))}
    if p == "/orphans":
        lone = _rows(endpoints.fn_rows(g).join(rules.orphans(g).select("id"), "id", "left_semi"), "node_ord")
        return 200, {"count": len(lone), "orphans": lone}
    if p == "/duplicates":
        found = _rows(rules.duplicates(g).orderBy(F.desc("n_modules"), F.collate("name", "UNICODE")))
        return 200, {"count": len(found), "duplicates": found}
    if p == "/files":
        kw = {"group": q.get("group"), "q": q.get("q"), "sort": q.get("sort", "functions")}
        return 200, {"count": endpoints.files(g, limit=None, **kw).count(), "sort": kw["sort"], "files": _rows(endpoints.files(g, limit=limit(200), **kw), drop=("rank", "file_ord"))}
    if p == "/calls":
        kw = {"module": q.get("module"), "q": q.get("q"), "cross": q.get("cross") == "true", "sort": q.get("sort", "weight")}
        return 200, {"count": endpoints.calls(g, limit=None, **kw).count(), "sort": kw["sort"], "calls": _rows(endpoints.calls(g, limit=limit(200), **kw), drop=("rank", "edge_ord"))}
    return _error(404, f"unknown endpoint {p}")
