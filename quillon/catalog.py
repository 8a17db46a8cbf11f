"""All registered queries of the graph engine, run on the graph lens, and the SQL they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .extract import build, fsplane
from .functions import names
from .graph import Graph
from .operators import diff, endpoints, freshness, layout, paths, rollups, rules, view
from .plans import oracle, reports
from .sources import lens
from .streaming import watch

#: Quantities from which order lines count: a connected graph, one with cycles of nodes, one with cycles of modules only.
DENSE, MIDDLE, SPARSE = 40, 44, 48
#: The older snapshot holds what was shipped before this day.
SNAPSHOT = "1998-01-01"
NOW = "2024-02-15 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _on_lens(name: str, make: Callable, q: int = DENSE) -> None:
    _QUERIES[name] = lambda spark, sf: make(lens.graph(spark, sf, q))


def _register() -> None:
    fn = lambda **kw: lambda g: endpoints.functions(g, **kw).drop("test_depth")
    _on_lens("calls", lambda g: endpoints.calls(g))
    _on_lens("calls_sort_name", lambda g: endpoints.calls(g, sort="name"))
    _on_lens("calls_cross", lambda g: endpoints.calls(g, cross=True, limit=100))
    _on_lens("calls_by_module", lambda g: endpoints.calls(g, module="Brand11", limit=150))
    _on_lens("calls_q", lambda g: endpoints.calls(g, q="Ring1", limit=100))
    _on_lens("fn_row", lambda g: endpoints.fn_rows(g))
    _on_lens("fn_ref", lambda g: endpoints.fn_refs(g))
    _on_lens("fn_detail", lambda g: endpoints.fn_details(g, g.nodes.select("id")).select("id", "name", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by")))
    _on_lens("module_summary", lambda g: endpoints.module_summaries(g))
    _on_lens("module_detail", lambda g: endpoints.module_neighbours(g).filter("module = 'lib/utils/Brand13'"))
    _on_lens("detail_panel", lambda g: endpoints.module_neighbours(g))
    _on_lens("describe_fn", lambda g: g.described.select("id", "description", "description_source"))
    _on_lens("describe_module", lambda g: endpoints.module_descriptions(g).select("module", "description"))
    _on_lens("describe_view", view.describe_view)
    _on_lens("graph_dump", lambda g: g.edges.select("src", "dst", "cnt"))
    _on_lens("graph_dump_modules", lambda g: g.module_edges.select(g.short_module("src").alias("src"), g.short_module("dst").alias("dst"), "cnt"))
    _on_lens("functions_by_module", fn(module="Brand7", limit=50))
    _on_lens("functions_q", fn(q="ring", limit=50))
    _on_lens("functions_by_kind", fn(kind="method", limit=40))
    _on_lens("functions_by_group", fn(group="services", limit=40))
    _on_lens("functions_exported", fn(exported="true", limit=60))
    _on_lens("functions_tested", fn(tested="true", limit=60))
    _on_lens("functions_max_test_depth", lambda g: endpoints.functions(g, max_test_depth=2, limit=100).select("id", "name", "test_depth", "rank"))
    _on_lens("functions_test_reachable", lambda g: endpoints.functions(g, test_reachable="false", limit=100).select("id", "name", "test_depth", "rank"))
    for sort in ("indegree", "outdegree", "connected", "loc", "chars", "name"):
        _on_lens(f"functions_sort_{sort}", fn(sort=sort, limit=100))
    _on_lens("files_filter", lambda g: endpoints.files(g, group="utils", q="brand1"))
    for sort in ("functions", "loc", "chars", "name"):
        _on_lens(f"files_sort_{sort}", lambda g, sort=sort: endpoints.files(g, sort=sort))
    _on_lens("file_sizes", lambda g: g.files.join(endpoints.module_sizes(g).select("module", "loc", "chars"), "module", "left").select("file", "loc", "chars"))
    _on_lens("callers", lambda g: endpoints.neighbours(g, "part/17", True))
    _on_lens("callees", lambda g: endpoints.neighbours(g, "part/17", False))
    _on_lens("client_index", lambda g: rollups.adjacency(g).select("id", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers")))
    _on_lens("client_index_modules", lambda g: rollups.module_adjacency(g).select("module", F.array_join("out", ",").alias("out"), F.array_join("into", ",").alias("into")))
    _on_lens("neighbour_focus", lambda g: endpoints.module_focus(g, "lib/core/Brand6"))
    _on_lens("hidden_groups", lambda g: endpoints.hidden_groups(g, ["dev", "stores"])[1].select("src", "dst", "cnt"))
    _on_lens("resolve_function", lambda g: endpoints.resolve_functions(g, "BOLT11").select("id", "short"))
    _on_lens("resolve_function_part", lambda g: endpoints.resolve_functions(g, "olt1").select("id", "short"))
    _on_lens("resolve_module", lambda g: endpoints.resolve_module(g, "brand2").select("module", "fns"))
    _on_lens("search_functions", lambda g: endpoints.search_functions(g, "ring1").select("id", "name", "score", "in_degree", "rank"))
    _on_lens("search_modules", lambda g: endpoints.search_modules(g, "utils").select("full_module", "score", "function_count", "rank"))
    _on_lens("typeahead", lambda g: endpoints.typeahead(g, " bolt1 "))
    _on_lens("typeahead_modules", lambda g: endpoints.typeahead(g, "nd1"))
    _on_lens("hubs_functions", lambda g: endpoints.hub_functions(g).select("id", "name", "in_degree", "rank"))
    _on_lens("hubs_modules", lambda g: endpoints.hub_modules(g).select("full_module", "incoming_call_sites", "function_count", "rank"))
    _on_lens("top_functions_of_module", lambda g: endpoints.top_functions(g))
    for kind in view.LISTS:
        _on_lens("list_rows" if kind == "functions" else f"list_rows_{kind}", lambda g, kind=kind: view.list_rows(g, kind).select("id", "label", "sub"))
    _on_lens("list_sort", lambda g: view.list_shown(g))
    _on_lens("list_sort_files", lambda g: view.list_shown(g, "files", "loc"))
    _on_lens("list_sort_modules", lambda g: view.list_shown(g, "modules", "name"))
    _on_lens("list_sort_calls", lambda g: view.list_shown(g, "calls"))
    _on_lens("list_filter", lambda g: view.list_shown(g, q="Rod1"))
    _on_lens("hover_split", lambda g: view.hover_split(g, "part/17"))
    _on_lens("node_marks", lambda g: g.nodes.select("id", view.editor_link("/w", F.col("file"), F.col("line")).alias("link"), view.coverage_color(F.col("kind"), F.col("tested")).alias("color")))
    _on_lens("word_wrap", lambda g: g.described.select("id", F.array_join(view.wrapped(F.col("description"), 18), "\n").alias("lines")))
    _QUERIES["edge_counts"] = lambda spark, sf: rollups.edge_counts(lens.call_sites(spark, sf, DENSE))
    _on_lens("module_edges", lambda g: g.module_edges.select("src", "dst", "cnt"))
    _on_lens("module_nodes", lambda g: g.module_nodes.select("module", "grp", "file", "fns"))
    _on_lens("degrees", lambda g: g.nodes.select("id", "in_degree", "out_degree"))
    _QUERIES["degrees_weighted"] = lambda spark, sf: lens.with_degrees(lens.nodes(spark, sf), lens.edges(spark, sf, DENSE), weighted=True).select("id", "in_degree", "out_degree")
    _on_lens("module_sizes", lambda g: endpoints.module_sizes(g))
    _on_lens("file_list", lambda g: g.files.select("file", "module", "grp", "fns"))
    _on_lens("stats", rollups.stats)
    _on_lens("module_coverage", rollups.module_coverage)
    _on_lens("group_census", rollups.group_census)
    _on_lens("port_candidates", lambda g: rules.port_candidates(g, 15))
    _on_lens("duplicates", lambda g: rules.duplicates(g).select("name", "n_modules", "n_nodes", F.array_join("modules", ",").alias("modules"), "first_id"))
    _on_lens("orphan_indegree", lambda g: g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers")))
    _on_lens("layer_violations", rules.layer_violations)
    _on_lens("layer_join", lambda g: rules.layer_violations(g).groupBy("src_group", "dst_group").agg(F.sum("cnt").alias("cnt")))
    _on_lens("scc_cycles", rules.cycles, SPARSE)
    _on_lens("scc_cycles_dense", rules.cycles)
    _on_lens("run_checks_dense", lambda g: rules.run_checks(g).select("level", "rule", "msg", "id"))
    _on_lens("scc_cycles_nodes", lambda g: paths.strong_components(g.edges), MIDDLE)
    _on_lens("god_modules", rules.god_modules)
    _on_lens("orphans_check", lambda g: rules.orphans(g, dotted=False).select("id", "short", "module"))
    _on_lens("orphans_list", lambda g: rules.orphans(g).select("id", "short", "module"))
    _on_lens("duplicate_findings", lambda g: rules.duplicate_findings(g).select("level", "rule", "msg", "module", "id"))
    _on_lens("adr_coverage", rules.adr_coverage)
    _on_lens("forbidden_module", lambda g: rules.forbidden_module(g, g.config.rules[0]))
    _on_lens("restricted_callee", lambda g: rules.restricted_callee(g, g.config.rules[1]))
    _on_lens("run_checks", lambda g: rules.run_checks(g).select("level", "rule", "msg", "id"), SPARSE)
    _on_lens("findings_by_rule", lambda g: rules.findings_by_rule(g, rules.run_checks(g)), SPARSE)
    _on_lens("finding_totals", lambda g: rules.finding_totals(rules.run_checks(g)), SPARSE)
    for rec in ("runes", "component_size", "function_size", "coverage"):
        key = {"runes": "rec_runes", "component_size": "rec_component_size", "function_size": "rec_function_size", "coverage": "rec_coverage"}[rec]
        _on_lens(key, lambda g, rec=rec: rules.recommendations(g, component_lines=120).filter(F.col("rec_id") == rec.replace("_", "-")).select("id", "label", "sub", "rank"))
    _on_lens("recommendation_order", lambda g: rules.recommendation_order(rules.recommendations(g, component_lines=120)))
    _on_lens("test_depth", lambda g: paths.with_test_depth(g).select("id", "test_depth"))
    _on_lens("test_reach_histogram", lambda g: rollups.depth_histogram(paths.with_test_depth(g)))
    _on_lens("shortest_path", lambda g: paths.shortest_path(g, "part/3", "part/150"))
    _on_lens("force_layout", lambda g: layout.drawn(g, 12))
    _on_lens("layout_seed", lambda g: _rounded(endpoints.layout_seed(g)))
    _on_lens("layout_edges", lambda g: endpoints.layout_edges(g.module_edges))
    rows = lambda g: view.insight_rows(g, component_lines=120)
    _on_lens("insight_groups", lambda g: view.insight_groups(rows(g)).select("section", "sev", "title", "n", "badge"), SPARSE)
    _on_lens("insight_filter", lambda g: view.insight_filter(rows(g), "Ring1").select("section", "title", "label", "sub"), SPARSE)
    _on_lens("insight_shown", lambda g: view.insight_shown(rows(g)).filter("section = 'rec'").select("title", "label", "rank", "more"), SPARSE)
    _on_lens("insight_lines", lambda g: view.insight_lines(rows(g)).select("line"), SPARSE)
    _on_lens("recommendation_titles", lambda g: rules.recommendation_titles(g, 120).select("rec_id", "title", "rec_rank"))
    _on_lens("check_lines", lambda g: reports.check_lines(g, rules.run_checks(g)), SPARSE)
    _on_lens("markdown_render", lambda g: view.function_markdown(g, g.nodes.select("id")))
    _on_lens("markdown_modules", view.module_markdown)
    _QUERIES["diff_lines"] = lambda spark, sf: reports.diff_lines(_snapshot(spark, sf), lens.graph(spark, sf, DENSE))
    for name, make in (("diff_modules", diff.modules), ("diff_sizes", diff.sizes), ("diff_deps", diff.dependencies), ("diff_totals", diff.totals)):
        _QUERIES[name] = lambda spark, sf, make=make: make(_snapshot(spark, sf), lens.graph(spark, sf, DENSE))
    _QUERIES["diff_order"] = lambda spark, sf: _diff_order(spark, sf)
    _QUERIES["changed_deps"] = lambda spark, sf: diff.dependencies(_snapshot(spark, sf), lens.graph(spark, sf, DENSE)).groupBy("change").agg(F.count("*").alias("n"))
    _QUERIES["union_edges"] = lambda spark, sf: rollups.merge_edges(lens.edges(spark, sf, DENSE), lens.edges(spark, sf, SPARSE))
    _QUERIES["union_nodes"] = lambda spark, sf: _union_nodes(spark, sf)
    _QUERIES["page_links"] = lambda spark, sf: _page_links(spark, sf)
    _QUERIES["wikilink_join"] = lambda spark, sf: fsplane.wiki_edges(_tree(spark, sf)).select("path", "dst")
    _QUERIES["mdlink_join"] = lambda spark, sf: fsplane.path_edges(_tree(spark, sf)).select("path", "dst")
    _QUERIES["unit_dep_join"] = lambda spark, sf: fsplane.unit_edges(_tree(spark, sf)).select("path", "dst")
    _QUERIES["extract_links"] = lambda spark, sf: _tree(spark, sf).select(
        "path", F.array_join(names.wiki_links(F.col("text")), "|").alias("wiki"), F.array_join(names.md_links(F.col("text")), "|").alias("md"), F.array_join(names.unit_links(F.col("text")), "|").alias("units")
    )
    _QUERIES["fs_edges"] = lambda spark, sf: fsplane.links(_tree(spark, sf)).select("src", "dst", "cnt")
    _QUERIES["fs_nodes"] = lambda spark, sf: fsplane.graph(_tree(spark, sf), fsplane.FsConfig(stale_days=40), F.lit(NOW).cast("timestamp")).nodes.select("id", "module", "grp", "descr", "loc", "stale_days", "stale", "in_degree", "out_degree", "node_ord")
    _QUERIES["fs_walk"] = lambda spark, sf: fsplane.kept(_tree(spark, sf), fsplane.FsConfig(ignore=("node_modules", "**/f1?.*"), extensions=("md", "json"), name_globs=("f2*",))).select("path")
    _QUERIES["adr_scan"] = lambda spark, sf: _tree(spark, sf).select("path", F.explode(names.declared_rules(F.col("text"))).alias("d")).select("path", "d.id", "d.title")
    _QUERIES["legacy_reactive"] = lambda spark, sf: _tree(spark, sf).select("path", names.legacy_reactive(F.col("text")).cast("long").alias("n"))
    _QUERIES["porcelain_paths"] = lambda spark, sf: freshness.porcelain_paths(_status_lines(spark, sf))
    _QUERIES["stale_decision"] = lambda spark, sf: _stale_decision(spark, sf)
    _QUERIES["names"] = lambda spark, sf: _names(spark, sf)
    _QUERIES["scan_svelte"] = lambda spark, sf: _scripts(spark, sf)
    _QUERIES["extract_declarations"] = lambda spark, sf: _extracted(spark, sf).nodes.select("name", "module", "grp", "kind", "class_name", "exported", "line", "loc", "numeric_ops", F.coalesce("module_used", F.lit(False)).alias("module_used"))
    _QUERIES["extract_edges"] = lambda spark, sf: _named_edges(_extracted(spark, sf))
    _QUERIES["page_files"] = lambda spark, sf: _page_files(spark, sf)
    _QUERIES["stale_days"] = lambda spark, sf: _stale(spark, sf)
    _QUERIES["stale_count"] = lambda spark, sf: _stale(spark, sf).agg(F.count_if("stale").alias("n_stale"), F.count("*").alias("n"))
    _QUERIES["is_stale"] = lambda spark, sf: _is_stale(spark, sf)
    _QUERIES["machines"] = lambda spark, sf: _machines(spark, sf).withColumn("projects", F.array_join("projects", ","))
    _QUERIES["machine_of"] = lambda spark, sf: view.machine_of(_machines(spark, sf), "g7")
    _QUERIES["machine_of_none"] = lambda spark, sf: view.machine_of(_machines(spark, sf), None)
    _QUERIES["online_ratio"] = lambda spark, sf: view.online_ratio(_machines(spark, sf))
    _QUERIES["debounce_sessions"] = lambda spark, sf: watch.sessions(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", 3600)


def _rounded(df):
    return df.select("id", "label", *[(F.round(F.col(c) * 1000).cast("long")).alias(c) for c in ("x", "y", "size")], "color", "grp")


def _snapshot(spark, sf):
    g = lens.graph(spark, sf, DENSE, SNAPSHOT)
    return g.having(nodes=g.nodes.filter("node_ord % 29 <> 7 AND module <> 'lib/utils/Brand19'"))


def _diff_order(spark, sf):
    d = diff.sizes(_snapshot(spark, sf), lens.graph(spark, sf, DENSE))
    return endpoints._ranked(d, [F.desc("delta"), F.asc("module")], 30).select("module", "delta", "rank")


def _union_nodes(spark, sf):
    n = lens.nodes(spark, sf).select("node_ord", "id", "short", "loc")
    later = n.filter("node_ord % 3 = 0").withColumns({"loc": F.col("loc") * 10, "short": F.concat("short", F.lit("_b"))})
    more = n.filter("node_ord % 7 = 0").withColumn("id", F.concat("id", F.lit("/rs")))
    return rollups.merge_nodes(n, later, more).select("id", "short", "loc", F.col("source").cast("long").alias("source"))


def _page_paths(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"), "html", "url")


def _page_links(spark, sf):
    """Links of pages joined to pages by the last segment: its name, else the name with .html."""
    p = _page_paths(spark, sf)
    files = p.select(names.base_name(F.col("path")).alias("base"), F.col("page_id").alias("target"))
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/?([^"]*)"'), F.lit(1))).alias("link"))
    sites = links.unionByName(p.select("page_id", F.regexp_extract("path", "([^/]*)$", 1).alias("link"))).filter("link <> ''")
    tiers = sites.select("page_id", "link", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("link").alias("base")), F.struct(F.lit(2).alias("tier"), F.concat("link", F.lit(".html")).alias("base")))).alias("t")).select("page_id", "link", "t.*")
    hits = tiers.join(files, "base").groupBy("page_id", "link", "target").agg(F.min("tier").alias("tier"), F.count("*").alias("n"))
    best = hits.groupBy("page_id", "link").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["page_id", "link", "tier"]).filter("page_id <> target").groupBy(F.col("page_id").alias("src"), F.col("target").alias("dst")).agg(F.sum("n").alias("cnt"))


def _names(spark, sf):
    n = lens.nodes(spark, sf)
    verb = F.element_at(F.array(*[F.lit(x) for x in ("get", "findAll", "isReady", "toJson", "onClick", "calcDist", "loadById", "Xyz", "setCfg", "fromSrc")]), (F.col("node_ord") % 10 + 1).cast("int"))
    camel = F.concat(verb, F.initcap(F.get(F.split("short", "[.]"), F.lit(0))), F.when(F.col("node_ord") % 10 == 6, "ById").otherwise(F.when(F.col("node_ord") % 4 == 0, "ServiceImpl").otherwise("")))
    src = F.concat(F.lit("function  "), camel, F.lit("(a,\n b) "), F.when(F.col("node_ord") % 2 == 0, "{ return 1 }").otherwise("=> a"))
    path = F.concat(F.lit("src/lib/"), "module", F.when(F.col("node_ord") % 3 == 0, ".svelte").otherwise(".ts"))
    return n.select(
        "id", camel.alias("camel"), names.humanize(camel).alias("humanized"), F.array_join(names.name_words(camel), " ").alias("words"), names.auto_describe(camel).alias("auto"), names.signature_of(src).alias("signature"),
        names.module_of(path).alias("module_of"), names.group_of(F.col("module"), "lib").alias("group_of"), names.short_module(F.col("module"), "lib").alias("short_module"), names.fmt_size(F.col("chars") * F.col("loc")).alias("size"),
        names.group_color(F.col("grp")).alias("color"), names.is_source_file(path, "src/lib/").alias("is_source"), names.make_id(F.col("module"), F.col("short"), F.col("line"), F.col("node_ord")).alias("made_id"),
    )


def _scripts(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", F.array_join(names.script_bodies(F.col("html")), "\n").alias("script"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Source texts made of suppliers and nations: a file each, and an index that exports all of the nations' again."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    s = s.join(s.select((F.col("k") - 1).alias("k"), F.col("k").alias("after")), "k", "left").withColumn("m", F.col("k") * 7 % 25)
    text = """import {{ hub{n} as hub }} from '../core/n{n}';
import * as all from '$lib/core';
{next}
export const twice{k} = (x: number) => hub(x) + 1;
export function own{k}(x: number): number {{
  return twice{k}(x) * all.hub{m}(x) - x / 2;
}}
export class Box{k} {{
  size: number[] = [1];
  get v() {{ return this.size[0]; }}
  set v(x) {{ own{k}(x); }}
  run = (x: number) => this.step(x);
  step(x: number) {{ for (const y of this.size) {{ x += y; }} return {called}(x); }}
}}
const table{k} = {{ a: twice{k}, b: (x: number) => own{k}(x) }};
export function pick{k}(key: 'a' | 'b', x: number) {{
  const first = table{k}[key];
  const second = first;
  return second(x);
}}
export const held{k} = writable<number>(-1);
export function bump{k}() {{ held{k}.update((x) => x + 1); }}
export default own{k};
own{k}(0);
"""
    parts = re.split(r"\{(k|n|m|next|called)\}", text.replace("{{", "\1").replace("}}", "\2"))
    known = {"k": "k", "n": "n", "m": "m", "next": F.concat(F.lit("import main from './s"), F.col("after").cast("string"), F.lit("';")), "called": F.when(F.col("after").isNotNull(), "main").otherwise("String")}
    pieces = [F.lit(p.replace("\1", "{").replace("\2", "}")) if i % 2 == 0 else F.coalesce(F.col(p).cast("string") if isinstance(known[p], str) else known[p], F.lit("")) for i, p in enumerate(parts)]
    own = s.select(F.concat(F.lit("src/lib/services/s"), F.col("k").cast("string"), F.lit(".ts")).alias("path"), F.concat(*pieces).alias("text"))
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("n"))
    hubs = nations.select(F.concat(F.lit("src/lib/core/n"), "n", F.lit(".ts")).alias("path"), F.concat(F.lit("export function hub"), "n", F.lit("(x: number) {\n  return x;\n}\n")).alias("text"))
    index = nations.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("export * from './n"), "n", F.lit("';")))), "\n").alias("text")).select(F.lit("src/lib/core/index.ts").alias("path"), "text")
    return own.unionByName(hubs).unionByName(index)


def _extracted(spark: SparkSession, sf: str) -> Graph:
    return build.extract(_sources(spark, sf), Config(name="sources"), {"$lib": "src/lib"})


def _named_edges(g: Graph) -> DataFrame:
    name = g.nodes.select("id", "name")
    return g.edges.join(name.toDF("src", "caller"), "src").join(name.toDF("dst", "callee"), "dst").select("caller", "callee", "cnt")


def _page_files(spark, sf):
    p = _page_paths(spark, sf)
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".service", ".json", ".sh", ".bin", ".mdx", "")]), (F.col("page_id") % 7 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in ("/.docs/", "/scripts/", "/node_modules/", "/x/")]), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.regexp_extract("path", "^([^/]*)", 1), folder, F.lit("f"), F.col("page_id").cast("string"), ext)
    return p.select(
        "page_id", path.alias("path"), names.categorize(path).alias("category"), names.ignored(path, ["node_modules", "**/f1?.*"]).alias("ignored"), names.keep_file(path, ["md", "json"], ["f2*"]).alias("kept"),
        names.dir_name(path).alias("dir"), names.base_name(path).alias("base"), names.fmt_size(F.octet_length("html").cast("long")).alias("size"),
    )


def _stale(spark, sf):
    last = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("mtime"))
    days = names.stale_days(F.col("mtime"), F.lit(NOW).cast("timestamp"))
    return last.select("user_id", days.alias("days"), (days >= 17).alias("stale"))


def _is_stale(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    changed = e.groupBy("user_id").agg(F.max("ts").alias("mtime")).select(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, ".ts").otherwise(".md")).alias("path"), F.when(F.col("user_id") % 5 != 0, F.col("mtime")).alias("mtime"))
    files = e.filter("user_id % 3 = 0").select(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".md")).alias("file"))  # known are these files, so only they and .ts files count
    return diff.changed_files_stale(changed, files, [".ts"], F.lit("2024-01-30 12:00:00").cast("timestamp"))


def _stale_decision(spark, sf):
    """Nations as projects of all states, each decided with and without stale files."""
    k = F.col("n_nationkey")
    n = spark.read.parquet(f"{sf}/nation.parquet").select(
        "n_name", F.when(k % 7 == 6, "filesystem").otherwise("code").alias("kind"), (k % 5 != 4).alias("has_git"), (k % 11 != 10).alias("has_graph"), F.when(k % 6 != 5, F.lit("c1")).alias("graph_commit"),
        F.when(k % 4 == 3, "c2").otherwise("c1").alias("head_commit"), (k % 2 == 0).alias("built_dirty"), (k % 3 != 0).alias("dirty_now"),
    )
    late = _is_stale(spark, sf)
    both = diff.is_stale(n, late).withColumn("files", F.lit(True)).unionByName(diff.is_stale(n, late.limit(0)).withColumn("files", F.lit(False)))
    return both.select("n_name", "files", "reason", "stale")


def _status_lines(spark, sf):
    u = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    name = F.concat(F.lit("src/u"), F.col("user_id").cast("string"))
    line = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit(" M "), name, F.lit(".ts"))).when(F.col("user_id") % 4 == 1, F.concat(F.lit("R  "), name, F.lit(".ts -> "), name, F.lit("b.ts")))
    return u.select(line.when(F.col("user_id") % 4 == 2, F.concat(F.lit('?? "'), name, F.lit(' x.md"'))).otherwise("").alias("line"))


def _tree(spark, sf):
    """Pages as files of a folder tree that link to each other: path, size, mtime, text."""
    p = _page_paths(spark, sf)
    k = F.col("page_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(x) for x in values]), (by + 1).cast("int"))
    to = lambda step: F.concat(F.lit("f"), (k + step).cast("string"))
    path = F.concat(F.lit("h"), (k % 3).cast("string"), pick(("/.docs/", "/scripts/", "/node_modules/", "/x/"), k % 4), to(0), pick((".md", ".service", ".json", ".sh", ".bin", ".mdx", ""), k % 7))
    note = F.concat(F.lit("## ADR-"), k.cast("string"), F.lit(" (kept): Keep "), to(0), F.lit("\n# ADR-9: no\nsee [["), to(7), F.lit("]] and [["), to(5), F.lit("|that one]] [["), to(1), F.lit(".service#a]] [x](../x/"), to(84), F.lit(".md#top) [y](./"), to(12), F.lit(".mdx)\n  $: a = 1;\n$: b\n"))
    unit = F.concat(F.lit("[Unit]\nAfter="), to(7), F.lit(".service  "), to(14), F.lit(".service,"), to(1), F.lit(".json\nwants = "), to(7), F.lit(".service\nDescription="), to(2), F.lit(".service\n"))
    text = F.when((k % 7).isin(0, 5), note).when(k % 7 == 1, unit).otherwise("")
    return p.select(path.alias("path"), F.octet_length("html").cast("long").alias("size"), F.timestamp_seconds(F.lit(1704067200) + (k % 60) * 86400 - 3600).alias("mtime"), text.alias("text"))


def _machines(spark, sf):
    """Customers as graphs, their nations as hosts; every fifteenth is a filesystem graph that names its machine."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("g"), k.cast("string")).alias("name"), F.concat(F.lit("host"), n.cast("string")).alias("host"), k, n)
    fs = k % 15 == 0
    registry = c.filter("c_custkey % 3 = 0").select("name", F.when(fs, "filesystem").otherwise("code").alias("kind"), F.when(fs, F.concat(F.lit("m"), n.cast("string"))).alias("machine"), F.when(fs & (n % 2 == 0), F.col("host")).alias("ts_host"))
    online = spark.read.parquet(f"{sf}/nation.parquet").filter("n_regionkey < 2").select(F.concat(F.lit("host"), F.col("n_nationkey").cast("string")).alias("host"))
    return view.machines(c.select("name", "host", F.concat(F.lit("day "), k.cast("string")).alias("generated_at")), registry, online, "host3")


_register()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql(DENSE, MIDDLE, SPARSE, SNAPSHOT, NOW)
