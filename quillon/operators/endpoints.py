"""List, lookup and search queries over a graph. Each returns a DataFrame whose ``rank`` column carries the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import slice_end
from ..functions import names
from ..graph import Graph
from ..shared import global_index


def _ranked(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows in an order, with their rank from 1; without a limit all rows, in no order and without a rank.

    The cut comes first, as a top-k that Spark takes per partition; ranks are then given to those rows only.
    """
    if limit is None:
        return df
    df = df.orderBy(*order).limit(slice_end(limit, df.count()) if limit < 0 else int(limit))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def fn_rows(g: Graph, described: DataFrame | None = None) -> DataFrame:
    """Full function rows."""
    d = g.described if described is None else described
    return d.select(
        "node_ord", "id", F.col("short").alias("name"), g.short_module().alias("module"), "grp", "kind", "exported", F.coalesce("tested", F.lit(False)).alias("tested"),
        *(["test_depth"] if "test_depth" in d.columns else []), "file", "line", "loc", "chars", "numeric_ops", "description", "description_source", "in_degree", "out_degree",
    )


def fn_refs(g: Graph) -> DataFrame:
    return g.described.select("id", F.col("short").alias("name"), g.short_module().alias("module"), "file", "line", "description")


def module_sizes(g: Graph) -> DataFrame:
    """loc, chars and numbers of dependencies of every module."""
    sizes = g.nodes.groupBy("module").agg(F.sum(F.coalesce("loc", F.lit(0))).alias("loc"), F.sum(F.coalesce("chars", F.lit(0))).alias("chars"))
    outs = g.module_edges.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("dep_out"))
    ins = g.module_edges.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("dep_in"))
    joined = g.module_nodes.select("module").join(sizes, "module", "left").join(outs, "module", "left").join(ins, "module", "left")
    return joined.fillna(0, ["loc", "chars", "dep_out", "dep_in"])


def module_descriptions(g: Graph) -> DataFrame:
    text = F.concat(F.col("fns").cast("string"), F.lit(" functions. No curated description yet."))
    if g.descriptions is None:
        return g.module_nodes.withColumn("description", text)
    curated = g.descriptions.filter("scope = 'module'").select(F.col("key").alias("module"), F.col("text").alias("curated"))
    return g.module_nodes.join(curated, "module", "left").withColumn("description", F.coalesce(F.nullif(F.col("curated"), F.lit("")), text)).drop("curated")


def module_summaries(g: Graph) -> DataFrame:
    return module_descriptions(g).join(module_sizes(g), "module").select(
        "mod_ord", g.short_module().alias("module"), F.col("module").alias("full_module"), "grp", "file", F.col("fns").alias("function_count"), "description", "loc", "chars",
        F.col("dep_out").alias("depends_on_count"), F.col("dep_in").alias("used_by_count"),
    )


def resolve_functions(g: Graph, query: str | None) -> DataFrame:
    """Nodes that a name means: of the exact id, else of the name, else of its last segment, else those that hold it."""
    if not query:
        return g.nodes.limit(0)
    q, short = query.lower(), F.lower("short")
    tier = F.when(F.col("id") == query, 1).when(short == q, 2).when(F.regexp_extract(short, r"([^.]*)$", 1) == q, 3).when(short.contains(q), 4)
    hits = g.nodes.withColumn("tier", tier).filter("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best")


def resolve_module(g: Graph, query: str | None) -> DataFrame:
    """The one module a name means: the first that has it as full name, short name or last segment, else that holds it."""
    if not query:
        return g.module_nodes.limit(0)
    q, full = query.lower(), F.lower("module")
    keyed = (full == q) | (F.lower(g.short_module()) == q) | (names.base_name(full) == q)
    tier = F.when(keyed, 1).when(full.contains(q), 2)
    return g.module_nodes.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", "mod_ord").limit(1).drop("tier")


SORTS = {
    "indegree": lambda: F.desc("in_degree"), "outdegree": lambda: F.desc("out_degree"), "connected": lambda: (F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))).desc(),
    "loc": lambda: F.desc(F.coalesce("loc", F.lit(0))), "chars": lambda: F.desc(F.coalesce("chars", F.lit(0))), "name": lambda: F.collate("name", "UNICODE").asc(),
}


def functions(g: Graph, *, module=None, q=None, kind=None, group=None, exported=None, tested=None, max_test_depth=None, test_reachable=None, sort="indegree", limit=100) -> DataFrame:
    """Filtered, sorted and cut function rows; ``total`` is how many there are before the cut."""
    from . import paths

    if max_test_depth is not None or test_reachable is not None:
        g = g.having(nodes=paths.with_test_depth(g)) if "test_depth" not in g.nodes.columns else g
    rows = fn_rows(g)
    if module:
        rows = rows.join(F.broadcast(resolve_module(g, module).select(g.short_module().alias("module"))), "module", "left_semi")
    if q:
        rows = rows.filter(F.lower("name").contains(q.lower()) | F.lower("description").contains(q.lower()))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if group:
        rows = rows.filter(F.col("grp") == group)
    if exported is not None:
        rows = rows.filter(F.col("exported").cast("string") == exported)
    if tested is not None:
        rows = rows.filter(F.col("tested").cast("string") == tested)
    if max_test_depth is not None:
        rows = rows.filter(F.col("test_depth") <= max_test_depth)
    if test_reachable is not None:
        rows = rows.filter(F.col("test_depth").isNotNull() == F.lit(test_reachable == "true"))
    order = [SORTS.get(sort, SORTS["indegree"])(), F.col("node_ord").asc()]
    return _ranked(rows, order, limit)


def neighbours(g: Graph, node_id: str, callers: bool) -> DataFrame:
    """The functions that call a node, or that it calls, in edge order."""
    near, far = ("dst", "src") if callers else ("src", "dst")
    hit = g.edges.filter(F.col(near) == node_id).select("edge_ord", F.col(far).alias("id"))
    return hit.join(fn_refs(g), "id").select("edge_ord", "name", "module", "file", "line", "description")


def fn_details(g: Graph, ids: DataFrame) -> DataFrame:
    """Function rows with signature and the names of callees and callers in edge order, for the given ids."""
    ref = lambda name: F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", "short"))), lambda x: x["short"]).alias(name)
    short = g.nodes.select("id", "short")
    calls = g.edges.join(ids, F.col("src") == ids["id"], "left_semi").join(short, F.col("dst") == F.col("id")).groupBy("src").agg(ref("calls"))
    called = g.edges.join(ids, F.col("dst") == ids["id"], "left_semi").join(short, F.col("src") == F.col("id")).groupBy("dst").agg(ref("called_by"))
    rows = fn_rows(g).join(ids, "id", "left_semi").join(calls, F.col("id") == F.col("src"), "left").join(called, F.col("id") == F.col("dst"), "left")
    empty = F.array().cast("array<string>")
    return rows.withColumns({"calls": F.coalesce("calls", empty), "called_by": F.coalesce("called_by", empty)}).drop("src", "dst")


def module_neighbours(g: Graph) -> DataFrame:
    """Both directions of module edges as rows: module, direction, other, call_sites, rank by call sites."""
    outs = g.module_edges.select(F.col("src").alias("module"), F.lit("depends_on").alias("direction"), F.col("dst").alias("other"), F.col("cnt").alias("call_sites"), "medge_ord")
    ins = g.module_edges.select(F.col("dst").alias("module"), F.lit("used_by").alias("direction"), F.col("src").alias("other"), F.col("cnt").alias("call_sites"), "medge_ord")
    by = Window.partitionBy("module", "direction").orderBy(F.desc("call_sites"), "medge_ord")
    both = outs.unionByName(ins).withColumn("rank", F.row_number().over(by).cast("long"))
    return both.select("module", "direction", g.short_module("other").alias("other"), "call_sites", "rank")


def top_functions(g: Graph, each: int = 12) -> DataFrame:
    """The most-called functions of every module."""
    by = Window.partitionBy("module").orderBy(F.desc("in_degree"), "node_ord")
    ranked = g.nodes.select("module", "id", "short", "line", "in_degree", F.row_number().over(by).cast("long").alias("rank"))
    return ranked.filter(F.col("rank") <= each)


def search_functions(g: Graph, query: str, limit: int = 20) -> DataFrame:
    score = F.greatest(names.search_score(F.col("name"), query, 100, 70, 45), names.search_score(F.col("description"), query, 60, 40, 25)).cast("long")
    hits = fn_rows(g).withColumn("score", score).filter("score > 0")
    return _ranked(hits, [F.desc("score"), F.desc("in_degree"), F.asc("node_ord")], limit)


def search_modules(g: Graph, query: str, limit: int = 20) -> DataFrame:
    score = F.greatest(names.search_score(F.col("module"), query, 100, 70, 45), names.search_score(F.col("description"), query, 60, 40, 25)).cast("long")
    hits = module_summaries(g).withColumn("score", score).filter("score > 0")
    return _ranked(hits, [F.desc("score"), F.desc("function_count"), F.asc("mod_ord")], limit)


def typeahead(g: Graph, text: str, modules: int = 4, fns: int = 10) -> DataFrame:
    """Up to four modules, then ten functions, by where the text stands in the name, then by importance."""
    q = text.strip().lower()
    if len(q) < 2:
        return g.nodes.select(F.lit("").alias("section"), "id", F.col("short").alias("label"), F.lit(0).cast("long").alias("rank")).limit(0)
    spot = lambda c: F.locate(q, F.lower(c))
    m = g.module_nodes.select(F.col("module").alias("id"), g.short_module().alias("label"), "fns", "mod_ord").filter(spot("label") > 0)
    m = _ranked(m, [spot("label").asc(), F.desc("fns"), F.asc("mod_ord")], modules).select(F.lit("modules").alias("section"), "id", "label", "rank")
    f = g.nodes.select("id", F.col("short").alias("label"), "in_degree", "node_ord").filter(spot("label") > 0)
    f = _ranked(f, [spot("label").asc(), F.desc("in_degree"), F.asc("node_ord")], fns).select(F.lit("functions").alias("section"), "id", "label", "rank")
    return m.unionByName(f)


def hub_functions(g: Graph, limit: int = 15) -> DataFrame:
    return _ranked(fn_rows(g), [F.desc("in_degree"), F.asc("node_ord")], limit)


def hub_modules(g: Graph, limit: int = 15) -> DataFrame:
    used = g.module_edges.groupBy(F.col("dst").alias("full_module")).agg(F.sum("cnt").alias("incoming_call_sites"))
    rows = module_summaries(g).join(used, "full_module", "left").fillna(0, ["incoming_call_sites"])
    return _ranked(rows, [F.desc("incoming_call_sites"), F.asc("mod_ord")], limit)


def files(g: Graph, *, group=None, q=None, sort="functions", limit=200) -> DataFrame:
    rows = g.files.join(module_sizes(g).select("module", "loc", "chars"), "module", "left").fillna(0, ["loc", "chars"])
    rows = rows.select("file_ord", "file", g.short_module().alias("module"), "grp", F.col("fns").alias("functions"), "loc", "chars")
    if group:
        rows = rows.filter(F.col("grp") == group)
    if q:
        rows = rows.filter(F.lower("file").contains(q.lower()))
    order = {"functions": F.desc("functions"), "loc": F.desc("loc"), "chars": F.desc("chars"), "name": F.collate("file", "UNICODE").asc()}
    return _ranked(rows, [order.get(sort, order["functions"]), F.asc("file_ord")], limit)


def calls(g: Graph, *, module=None, q=None, cross=False, sort="weight", limit=200) -> DataFrame:
    """Edges with both ends' names and modules."""
    e = g.edge_ends("short", "module")
    if module:
        m = F.broadcast(resolve_module(g, module).select(F.col("module").alias("wanted")))
        e = e.join(m, (F.col("a_module") == F.col("wanted")) | (F.col("b_module") == F.col("wanted")), "left_semi")
    rows = e.select(
        "edge_ord", F.col("a_short").alias("caller"), F.col("b_short").alias("callee"), g.short_module("a_module").alias("from_module"), g.short_module("b_module").alias("to_module"),
        F.when(F.col("cnt") == 0, 1).otherwise(F.coalesce("cnt", F.lit(1))).cast("long").alias("cnt"), (F.col("a_module") != F.col("b_module")).alias("cross_module"),
        F.col("src").alias("caller_id"), F.col("dst").alias("callee_id"),
    )
    if q:
        rows = rows.filter(F.lower(F.concat_ws(" ", "caller", "callee", "from_module", "to_module")).contains(q.lower()))
    if cross:
        rows = rows.filter("cross_module")
    order = F.collate("caller", "UNICODE").asc() if sort == "name" else F.desc("cnt")
    return _ranked(rows, [order, F.asc("edge_ord")], limit)


def hidden_groups(g: Graph, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes outside the hidden groups, and edges between such."""
    nodes = g.nodes.filter(~F.col("grp").isin(hidden))
    ids = nodes.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges


def module_focus(g: Graph, module: str) -> DataFrame:
    """A module's nodes and their neighbours; ``own`` tells them apart."""
    own = g.nodes.filter(F.col("module") == module).select("id")
    out = g.edges.join(own, F.col("src") == own["id"], "left_semi").select(F.col("dst").alias("id"))
    into = g.edges.join(own, F.col("dst") == own["id"], "left_semi").select(F.col("src").alias("id"))
    near = out.unionByName(into).distinct().join(own, "id", "left_anti")
    return own.withColumn("own", F.lit(True)).unionByName(near.withColumn("own", F.lit(False)))


def layout_seed(g: Graph) -> DataFrame:
    """Start positions on a circle, node sizes, colours and labels of the function view."""
    n = max(1, g.nodes.count())
    numbered = global_index(g.nodes.select("id", "short", "in_degree", "grp", "node_ord"), ["node_ord"], "layout", "at")
    radius, angle = max(40.0, 4.0 * n**0.5), F.col("at") / F.lit(float(n)) * (2 * F.pi())
    placed = numbered.withColumn("angle", angle)
    return placed.select("id", F.col("short").alias("label"), (radius * F.cos("angle")).alias("x"), (radius * F.sin("angle")).alias("y"), (2 + 1.4 * F.sqrt("in_degree")).alias("size"), names.group_color(F.col("grp")).alias("color"), "grp")


def layout_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.col("cnt").alias("weight"), F.least(1 + F.col("cnt") / 4, F.lit(6.0)).alias("size"))
