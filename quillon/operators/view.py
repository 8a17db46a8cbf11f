"""What a viewer shows of a graph: lists, panels, insights, documents, colours, machines. Tables, ready to be drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, sorted_side
from . import endpoints, paths, rules

#: Sort keys of the lists, the first one being the default; ``name`` is sorted as text, ascending, all others downwards.
LISTS = {
    "functions": ("indegree", "outdegree", "loc", "chars", "name"), "calls": ("weight", "name"),
    "files": ("functions", "loc", "chars", "name"), "modules": ("fns", "loc", "dep_out", "dep_in", "name"),
}
#: Rows that a list shows, and rows that a group of insights shows.
LIST_ROWS, GROUP_ROWS = 300, 40
# Colours of coverage.
COVERED, UNCOVERED, NOT_COUNTED = "#7ee787", "#ff6b6b", "#3a4453"


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def list_rows(g: Graph, kind: str = "functions") -> DataFrame:
    """ord, id, label, sub and the sort keys of one of the lists."""
    sm = g.short_module
    if kind == "functions":
        sub = _text(sm(), " · ", F.col("loc"), "ln · ", F.col("in_degree"), "←", F.col("out_degree"), "→")
        return g.nodes.select(
            F.col("node_ord").alias("ord"), "id", F.col("short").alias("label"), sub.alias("sub"), F.col("in_degree").alias("indegree"), F.col("out_degree").alias("outdegree"), "loc", "chars",
            F.col("short").alias("name"),
        )
    if kind == "calls":
        e = g.edge_ends("short", "module")
        sub = _text(sm("a_module"), " → ", sm("b_module"), " · ", F.col("cnt"), "×")
        return e.select(F.col("edge_ord").alias("ord"), F.col("src").alias("id"), _text(F.col("a_short"), " → ", F.col("b_short")).alias("label"), sub.alias("sub"), F.col("cnt").alias("weight"), F.col("a_short").alias("name"))
    sizes = endpoints.module_sizes(g)
    if kind == "files":
        f = g.files.join(sizes.select("module", "loc", "chars"), "module", "left").fillna(0, ["loc", "chars"])
        sub = _text(F.col("grp"), " · ", F.col("fns"), " fns · ", F.col("loc"), "ln")
        return f.select(F.col("file_ord").alias("ord"), F.col("file").alias("id"), F.regexp_replace("file", "^src/", "").alias("label"), sub.alias("sub"), F.col("fns").alias("functions"), "loc", "chars", F.col("file").alias("name"))
    m = g.module_nodes.join(sizes, "module")
    sub = _text(F.col("grp"), " · ", F.col("fns"), " fns · ", F.col("loc"), "ln · ", F.col("dep_out"), "→ ", F.col("dep_in"), "←")
    return m.select(F.col("mod_ord").alias("ord"), F.col("module").alias("id"), sm().alias("label"), sub.alias("sub"), "fns", "loc", "dep_out", "dep_in", F.col("module").alias("name"))


def list_shown(g: Graph, kind: str = "functions", sort: str | None = None, q: str = "", most: int = LIST_ROWS) -> DataFrame:
    """rank, id, label, sub of the first rows of a filtered and sorted list, and how many ``more`` there are."""
    rows = list_rows(g, kind)
    if q:
        rows = rows.filter(F.lower(F.concat_ws(" ", "label", "sub")).contains(q.lower()))
    key = sort or LISTS[kind][0]
    order = [F.collate("name", "UNICODE").asc() if key == "name" else F.desc(key), F.asc("ord")]
    total = rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    shown = rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return shown.join(F.broadcast(total)).select("rank", "id", "label", "sub", "more")


def describe_view(g: Graph) -> DataFrame:
    """id, description: curated text, else the description, the doc, the spelled-out name, the name."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    d = g.nodes
    if g.descriptions is None:
        d = d.withColumn("curated", F.lit(None).cast("string"))
    else:
        curated = g.descriptions.filter("scope = 'function'").select(F.col("key").alias("k"), F.col("text").alias("curated"))
        d = d.join(curated, F.concat("module", F.lit("::"), "short") == F.col("k"), "left")
    return d.select("id", F.coalesce(full("curated"), full("descr"), full("doc"), full("humanized"), F.col("short")).alias("description"))


def editor_link(root: str | None, file: Column, line: Column) -> Column:
    """A link that opens an editor at a place in a file."""
    return F.concat(F.lit(f"vscode://file/{root or ''}/"), file, F.lit(":"), line.cast("string"))


def coverage_color(kind: Column, tested: Column) -> Column:
    """The colour of a node by whether it is tested; only functions and methods count."""
    return F.when(~kind.isin("function", "method"), NOT_COUNTED).when(F.coalesce(tested, F.lit(False)), COVERED).otherwise(UNCOVERED)


def hover_split(g: Graph, node_id: str) -> DataFrame:
    """id, direction: what a node points at and what points at it; an id may be both."""
    outs = g.edges.filter(F.col("src") == node_id).select(F.col("dst").alias("id")).distinct().withColumn("direction", F.lit("out"))
    ins = g.edges.filter(F.col("dst") == node_id).select(F.col("src").alias("id")).distinct().withColumn("direction", F.lit("in"))
    return outs.unionByName(ins)


def insight_rows(g: Graph, component_lines: int = 200, function_lines: int = 80) -> DataFrame:
    """section, section_ord, group_ord, sev, title, why, label, sub, row_ord: all findings of the insights panel.

    A group without findings is a row with a null label. Checks are run once; the rows are a table that others read.
    Findings stay where they are: what is sent to all tasks is a row a rule, and groups without findings are added.
    """
    checks, found = paths.checkpointed(rules.run_checks(g)), rules.rule_list(g)
    rule = g.spark.createDataFrame([(r, i) for i, r in enumerate(dict.fromkeys(found))], "title string, group_ord long")
    places = g.nodes.select(F.col("id").alias("n_id"), "file", "line")
    where = F.coalesce(F.concat("file", F.lit(":"), F.col("line").cast("string")), F.lit(""))
    c = checks.join(sorted_side(places), F.col("id") == F.col("n_id"), "left").select(F.col("rule").alias("title"), "level", F.col("msg").alias("label"), where.alias("sub"), F.concat_ws(" ", F.lpad(F.col("rule_ord").cast("string"), 3, "0"), "module", "id", "msg").alias("row_ord"))
    worst = rules.findings_by_rule(g, checks).select(F.col("rule").alias("title"), F.when(F.col("has_error"), 2).when(F.col("hits") > 0, 1).otherwise(0).alias("worst"), "hits")
    told = rule.join(worst, "title")
    c = c.join(F.broadcast(told), "title").unionByName(told.filter("hits = 0"), allowMissingColumns=True)
    c = c.select(F.lit("check").alias("section"), F.lit(0).alias("section_ord"), "group_ord", F.when(F.col("worst") == 2, "error").when(F.col("worst") == 1, "warn").otherwise("info").alias("sev"), "title", F.lit(None).cast("string").alias("why"), "label", "sub", "row_ord")
    r = rules.recommendations(g, component_lines, function_lines).join(rules.recommendation_titles(g, component_lines, function_lines), "rec_id")
    number = F.lpad(F.col("rank").cast("string"), 12, "0")
    r = r.select(F.lit("rec").alias("section"), F.lit(1).alias("section_ord"), F.col("rec_rank").alias("group_ord"), F.col("severity").alias("sev"), "title", F.col("rationale").alias("why"), "label", "sub", number.alias("row_ord"))
    one = g.spark.range(1)
    p = rules.port_candidates(g, 15)
    sub = F.concat(F.lit("score "), F.format_string("%.1f", "score"), F.lit(" · "), F.col("numeric_ops").cast("string"), F.lit(" numeric · "), F.col("loc").cast("string"), F.lit(" loc · coupling "), F.col("coupling").cast("string"))
    p = one.select(F.lit("TS→Rust port candidates").alias("title")).join(p.select(F.col("module").alias("label"), sub.alias("sub"), number.alias("row_ord")), how="left")
    p = p.select(F.lit("ports").alias("section"), F.lit(2).alias("section_ord"), F.lit(0).cast("long").alias("group_ord"), F.lit("info").alias("sev"), "title", F.lit("score = compute ÷ coupling").alias("why"), "label", "sub", "row_ord")
    o = rules.orphans(g).join(sorted_side(g.nodes.select(F.col("id").alias("n_id"), F.col("file").alias("at"), F.col("line").alias("at_line"), F.col("node_ord").alias("at_ord"))), F.col("id") == F.col("n_id"))
    sub = F.concat(F.col("module"), F.lit(" · "), F.col("at"), F.lit(":"), F.col("at_line").cast("string"))
    o = o.select(F.col("short").alias("label"), sub.alias("sub"), F.lpad(F.col("at_ord").cast("string"), 20, "0").alias("row_ord"))
    nobody = o.agg(F.count("*").alias("n")).filter("n = 0").drop("n")
    o = o.unionByName(nobody, allowMissingColumns=True).withColumn("title", F.lit("Dead-code candidates"))
    o = o.select(F.lit("orphans").alias("section"), F.lit(3).alias("section_ord"), F.lit(0).cast("long").alias("group_ord"), F.lit("info").alias("sev"), "title", F.lit(None).cast("string").alias("why"), "label", "sub", "row_ord")
    return paths.checkpointed(c.unionByName(r).unionByName(p).unionByName(o))


_GROUP = ("section_ord", "section", "group_ord", "sev", "title", "why")


def insight_groups(rows: DataFrame) -> DataFrame:
    """Groups of ``insight_rows`` with their number of findings and the badge that shows it."""
    n = F.count("label")
    return rows.groupBy(*_GROUP).agg(n.alias("n"), F.when(F.first("section") == "check", F.when(n == 0, "✓").otherwise(n.cast("string"))).otherwise(n.cast("string")).alias("badge"))


def insight_filter(rows: DataFrame, q: str) -> DataFrame:
    """Rows of ``insight_rows`` that hold a text; a group whose title holds it stays without rows, others without any go."""
    if not q:
        return rows
    hit = F.lower(F.concat_ws(" ", "label", F.coalesce("sub", F.lit("")))).contains(q.lower())
    kept = rows.filter(F.col("label").isNotNull() & hit)
    titled = rows.filter(F.lower("title").contains(q.lower())).select(*_GROUP).distinct()
    empty = titled.join(kept.select("section", "group_ord").distinct(), ["section", "group_ord"], "left_anti")
    return kept.unionByName(empty.select(*_GROUP, *[F.lit(None).cast("string").alias(c) for c in ("label", "sub", "row_ord")]).select(*rows.columns))


def insight_shown(rows: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """The first rows of every group, and how many ``more`` it has."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy("row_ord")).cast("long"))
    sizes = rows.groupBy(*_GROUP).agg(F.greatest(F.count("label") - most, F.lit(0)).alias("more")).select("section", "group_ord", "title", "more")
    return ranked.filter(F.col("rank") <= most).join(sizes, ["section", "group_ord", "title"])


# Headings of the sections.
SECTIONS = {"check": "Architecture checks", "rec": "Recommendations", "ports": "Port candidates", "orphans": "Dead code"}


def insight_lines(rows: DataFrame) -> DataFrame:
    """line_ord (an array that sorts as the text goes) and line: the insights as plain text."""
    g = insight_groups(rows)
    key = lambda *parts: F.array(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    number = F.lpad(F.col("group_ord").cast("string"), 12, "0")
    label = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])[F.col("section")]
    heads = g.select("section_ord", "section").distinct().select(key(F.col("section_ord"), "").alias("line_ord"), F.concat(F.lit("\n== "), label, F.lit(" ==")).alias("line"))
    title = F.concat(F.lit("\n["), "badge", F.lit("] "), "title", F.coalesce(F.concat(F.lit("\n  ("), F.col("why"), F.lit(")")), F.lit("")))
    titles = g.select(key(F.col("section_ord"), number).alias("line_ord"), title.alias("line"))
    note = F.when(F.coalesce("sub", F.lit("")) != "", F.concat(F.lit("  ("), "sub", F.lit(")"))).otherwise("")
    each = rows.filter("label IS NOT NULL").select(key(F.col("section_ord"), number, F.col("row_ord")).alias("line_ord"), F.concat(F.lit("  - "), "label", note).alias("line"))
    return heads.unionByName(titles).unionByName(each)


def insights_text(rows: DataFrame, errors: int, warnings: int) -> str:
    """The whole text, for a reader: its lines come to the driver."""
    lines = [r["line"] for r in insight_lines(rows).orderBy("line_ord").collect()]
    return "\n".join([f"Architecture insights — {errors} error(s), {warnings} warning(s)", *lines])


def _bullets(title: str, items: Column, line) -> Column:
    listed = F.array_join(F.transform(items, line), "")
    return F.concat(F.lit(f"\n\n## {title} ("), F.size(items).cast("string"), F.lit(")"), listed)


def function_markdown(g: Graph, ids: DataFrame) -> DataFrame:
    """id, markdown of the functions with the given ids: description, place, signature, callees and callers in edge order."""
    refs = endpoints.fn_refs(g).select(F.col("id").alias("r_id"), F.struct("name", "module", "description").alias("ref"))
    picked = lambda name: F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", "ref"))), lambda x: x["ref"]).alias(name)
    chosen = ids.select("id").distinct()
    calls = g.edges.join(chosen, F.col("src") == F.col("id"), "left_semi").join(refs, F.col("dst") == F.col("r_id")).groupBy("src").agg(picked("calls"))
    called = g.edges.join(chosen, F.col("dst") == F.col("id"), "left_semi").join(refs, F.col("src") == F.col("r_id")).groupBy("dst").agg(picked("called_by"))
    rows = endpoints.fn_rows(g).join(chosen, "id", "left_semi").join(g.nodes.select("id", "signature"), "id")
    rows = rows.join(calls, F.col("id") == F.col("src"), "left").join(called, F.col("id") == F.col("dst"), "left")
    none = F.array().cast("array<struct<name:string,module:string,description:string>>")
    line = lambda x: F.concat(F.lit("\n- "), x["name"], F.lit(" ("), x["module"], F.lit(") — "), F.coalesce(x["description"], F.lit("")))
    text = F.concat(
        _text("# ", F.col("name"), "  (", F.col("module"), ")\n\n", F.col("description"), "\n\n- **kind**: ", F.col("kind")), F.when(F.col("exported"), " · exported").otherwise(""),
        _text("  ·  **source**: ", F.col("file"), ":", F.col("line"), "  ·  **desc from**: ", F.col("description_source"), "\n- **signature**: `", F.col("signature"), "`"),
        _bullets("Calls", F.coalesce("calls", none), line), _bullets("Called by", F.coalesce("called_by", none), line),
    )
    return rows.select("id", text.alias("markdown"))


def module_markdown(g: Graph) -> DataFrame:
    """module, markdown of all modules: description, dependencies by call sites, functions by callers."""
    sides = endpoints.module_neighbours(g).groupBy("module").pivot("direction", ["depends_on", "used_by"]).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "other", "call_sites"))), lambda x: F.struct(x["other"].alias("other"), x["call_sites"].alias("call_sites"))))
    d = g.described.groupBy("module").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("in_degree")).alias("o"), "node_ord", F.col("short").alias("name"), "description"))), lambda x: F.struct(x["name"].alias("name"), x["description"].alias("description"))).alias("fns"))
    m = endpoints.module_summaries(g).withColumnsRenamed({"module": "title", "full_module": "module"}).join(sides, "module", "left").join(d, "module", "left")
    none = F.array().cast("array<struct<other:string,call_sites:bigint>>")
    dep = lambda x: F.concat(F.lit("\n- "), x["other"], F.lit(" ("), x["call_sites"].cast("string"), F.lit(")"))
    fn = F.array_join(F.transform("fns", lambda x: F.concat(F.lit("\n- "), x["name"], F.lit(" — "), F.coalesce(x["description"], F.lit("")))), "")
    text = F.concat(
        _text("# ", F.col("title"), "  (", F.col("grp"), ")\n\n", F.col("description"), "\n\nSource: ", F.col("file"), " · ", F.col("function_count"), " functions"),
        _bullets("Depends on", F.coalesce("depends_on", none), dep), _bullets("Used by", F.coalesce("used_by", none), dep), F.lit("\n\n## Functions"), fn,
    )
    return m.select("module", text.alias("markdown"))


def machines(graphs: DataFrame, registry: DataFrame, online: DataFrame | None, here: str) -> DataFrame:
    """machine, all_graph, projects (sorted), ts_host, indexed_at, status of every machine that graphs belong to.

    ``graphs``: name, host, generated_at; ``registry``: name, kind, machine, ts_host; ``online``: host (None: not known).
    A filesystem graph belongs to the machine that the registry names, a code graph to the host that built it, under the
    name that the registry has for that host. This machine is online; others are if they are known to be, else cached
    where there is a filesystem graph or a host that could be asked, else offline.
    """
    label_of = registry.filter("machine IS NOT NULL").select(F.explode(F.array(F.struct(F.col("ts_host").alias("host"), "machine"), F.struct(F.col("machine").alias("host"), "machine"))).alias("l")).select("l.*")
    label_of = label_of.filter("host IS NOT NULL").groupBy("host").agg(F.min("machine").alias("label"))
    entry = registry.select("name", "kind", F.col("machine").alias("r_machine"), "ts_host")
    g = graphs.withColumn("host", F.coalesce("host", F.lit(here))).join(entry, "name", "left").join(label_of, "host", "left")
    is_fs = F.coalesce(F.col("kind") == "filesystem", F.lit(False))
    g = g.withColumn("fs", is_fs).withColumn("machine", F.when(is_fs, F.coalesce("r_machine", "name")).otherwise(F.coalesce("label", "host")))
    m = g.groupBy("machine").agg(
        F.max(F.when(F.col("fs"), F.col("name"))).alias("all_graph"), F.sort_array(F.collect_list(F.when(~F.col("fs"), F.col("name")))).alias("projects"),
        F.max("ts_host").alias("ts_host"), F.max(F.when(F.col("fs"), F.col("generated_at"))).alias("indexed_at"),
    )
    own = label_of.filter(F.col("host") == here).agg(F.coalesce(F.max("label"), F.lit(here)).alias("own"))
    m = m.join(F.broadcast(own))
    fallback = F.when(F.col("all_graph").isNotNull(), "cached").otherwise("offline")
    if online is None:
        status = fallback
    else:
        m = m.join(online.select(F.col("host").alias("ts_host")).distinct().withColumn("on", F.lit(True)), "ts_host", "left")
        status = F.when(F.col("ts_host").isNotNull(), F.when(F.col("on"), "online").otherwise("cached")).otherwise(fallback)
    return m.select("machine", "all_graph", "projects", "ts_host", "indexed_at", F.when(F.col("machine") == F.col("own"), "online").otherwise(status).alias("status"))


def machine_of(shown: DataFrame, project: str | None) -> DataFrame:
    """The machine that a project belongs to; of an unknown one the first machine."""
    mine = F.coalesce(F.col("all_graph") == project, F.lit(False)) | F.array_contains("projects", project) if project else F.lit(False)
    return shown.withColumn("tier", F.when(mine, 0).otherwise(1)).orderBy("tier", F.collate("machine", "UNICODE")).limit(1).select("machine")


def online_ratio(shown: DataFrame) -> DataFrame:
    """online, total."""
    return shown.agg(F.count_if(F.col("status") == "online").alias("online"), F.count("*").alias("total"))


def wrapped(text: Column, most: int) -> Column:
    """The lines of a text broken at blanks; a line has ``most`` characters at most unless one word is longer."""
    longer = lambda acc, w: F.length(acc["now"]) + 1 + F.length(w) > most
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))
    step = lambda acc, w: F.when((acc["now"] != "") & longer(acc, w), F.struct(F.concat(acc["lines"], F.array(acc["now"])).alias("lines"), w.alias("now"))).otherwise(
        F.struct(acc["lines"].alias("lines"), F.when(acc["now"] != "", F.concat(acc["now"], F.lit(" "), w)).otherwise(w).alias("now"))
    )
    done = F.aggregate(F.split(text, " ", -1), start, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["lines"], F.array(acc["now"]))).otherwise(acc["lines"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(done)

