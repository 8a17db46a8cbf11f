"""Rule checks, rankings and recommendations over a graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Rule
from ..functions import names
from ..graph import Graph, sorted_side
from . import paths

FINDING = ("level", "rule", "msg", "module", "id")


def _finding(df: DataFrame, level: str, rule: str, msg, module=None, node=None) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), msg.alias("msg"), (null if module is None else module).alias("module"), (null if node is None else node).alias("id"))


def called_modules(g: Graph) -> DataFrame:
    """src, dst, cnt of calls between modules, from the node edges (a count of 0 is 1)."""
    ends = g.edge_ends("module").filter("a_module <> b_module")
    return ends.groupBy(F.col("a_module").alias("src"), F.col("b_module").alias("dst")).agg(F.sum(F.when(F.col("cnt") == 0, 1).otherwise(F.col("cnt"))).alias("cnt"))


def forbidden_module(g: Graph, rule: Rule) -> DataFrame:
    """Calls into a module from modules other than itself and those allowed (full names)."""
    e = g.edge_ends("module", "short").filter((F.col("b_module") == rule.module) & ~F.col("a_module").isin(rule.module, *rule.allow_from))
    msg = F.lit(rule.msg) if rule.msg else F.concat(g.short_module("a_module"), F.lit("::"), "a_short", F.lit(" calls "), g.short_module("b_module"), F.lit("::"), "b_short")
    return _finding(e, rule.severity, rule.adr, msg, F.col("a_module"), F.col("src"))


def restricted_callee(g: Graph, rule: Rule) -> DataFrame:
    """Calls of certain functions from others than those allowed, by name, short module and name, or module and name."""
    e = g.edge_ends("module", "short").filter(F.col("b_short").isin(*rule.callees))
    allowed = list(rule.allow_from)
    spelled = [F.col("a_short"), F.concat(g.short_module("a_module"), F.lit("::"), "a_short"), F.concat("a_module", F.lit("::"), "a_short")]
    e = e.filter(~reduce(lambda x, y: x | y, (s.isin(*allowed) for s in spelled))) if allowed else e
    msg = F.lit(rule.msg) if rule.msg else F.concat(g.short_module("a_module"), F.lit("::"), "a_short", F.lit(" calls "), "b_short")
    return _finding(e, rule.severity, rule.adr, msg, F.col("a_module"), F.col("src"))


#: Rule types of the configuration; more can be added from code.
RULE_TYPES: dict[str, Callable[[Graph, Rule], DataFrame]] = {"forbidden-callee-module": forbidden_module, "restricted-callee": restricted_callee}


def layers(g: Graph) -> DataFrame:
    return g.spark.createDataFrame(list(g.config.layers.items()), "grp string, layer int")


def layer_violations(g: Graph) -> DataFrame:
    """src, dst, src_group, dst_group, cnt: modules that depend on a higher layer; groups without a layer or below 0 are exempt."""
    ranked = g.module_nodes.join(F.broadcast(layers(g)), "grp").filter("layer >= 0")
    a = ranked.select(F.col("module").alias("src"), F.col("grp").alias("src_group"), F.col("layer").alias("src_layer"))
    b = ranked.select(F.col("module").alias("dst"), F.col("grp").alias("dst_group"), F.col("layer").alias("dst_layer"))
    return called_modules(g).join(a, "src").join(b, "dst").filter("src_layer < dst_layer").select("src", "dst", "src_group", "dst_group", "cnt")


def cycles(g: Graph) -> DataFrame:
    """module, component, size of modules that depend on each other in a circle."""
    return paths.strong_components(called_modules(g)).withColumnRenamed("id", "module")


def god_modules(g: Graph) -> DataFrame:
    return g.module_nodes.filter(F.col("fns") > g.config.god_functions).select("module", "fns")


def orphans(g: Graph, dotted: bool = True) -> DataFrame:
    """Private functions by themselves that nothing calls; ``dotted``: names with a dot count as well."""
    lone = F.coalesce("exported", F.lit(False)) | F.coalesce("tested", F.lit(False)) | F.coalesce("module_used", F.lit(False))
    n = g.nodes.filter((F.col("kind") == "function") & F.coalesce(F.col("class_name") == "", F.lit(True)) & ~lone & ~F.col("grp").isin(*g.config.exempt_groups))
    n = n if dotted else n.filter(~F.col("short").contains("."))
    return n.join(sorted_side(g.edges.select(F.col("dst").alias("id"))), "id", "left_anti").select("node_ord", "id", "short", "module", "file", "line")


CONTRACT_NAMES = ("set", "update", "subscribe")


def duplicates(g: Graph, most_modules: int = 4) -> DataFrame:
    """name, n_modules, n_nodes, modules (in order of first node), first: functions of one name in two to four modules."""
    n = g.nodes.filter((F.col("kind") == "function") & F.coalesce(F.col("class_name") == "", F.lit(True)) & ~F.col("short").contains(".") & ~F.coalesce("nested", F.lit(False)) & ~F.col("short").isin(*CONTRACT_NAMES))
    per_module = n.groupBy("short", "module").agg(F.min("node_ord").alias("first_ord"), F.min_by("id", "node_ord").alias("first_id"), F.count("*").alias("n"))
    # names of many modules are counted before any list of modules is made
    few = per_module.groupBy("short").agg(F.count("*").alias("n_modules")).filter((F.col("n_modules") > 1) & (F.col("n_modules") <= most_modules))
    parts = per_module.join(sorted_side(few.select("short")), "short", "left_semi")
    listed = F.sort_array(F.collect_list(F.struct("first_ord", "module")))
    return parts.groupBy(F.col("short").alias("name")).agg(
        F.count("*").alias("n_modules"), F.sum("n").alias("n_nodes"), F.transform(listed, lambda x: x["module"]).alias("modules"), F.min_by("first_id", "first_ord").alias("first_id")
    )


def adr_coverage(g: Graph) -> DataFrame:
    """Declared decisions that no rule is configured for."""
    if g.adrs is None:
        return g.spark.createDataFrame([], "id string, title string")
    known = g.spark.createDataFrame([(r.adr,) for r in g.config.rules], "id string")
    return g.adrs.join(known, "id", "left_anti").select("id", "title")


def duplicate_findings(g: Graph) -> DataFrame:
    """One finding for each name that several modules define, at its first node."""
    shorts = F.array_join(F.transform("modules", lambda m: names.short_module(m, g.config.namespace_prefix)), ", ")
    msg = F.concat("name", F.lit(" is defined in "), F.col("n_modules").cast("string"), F.lit(" modules ("), shorts, F.lit(") — consolidate into one shared util"))
    return _finding(duplicates(g), "warn", "duplicate", msg, F.element_at("modules", 1), F.col("first_id"))


# Fixed texts: the messages of the findings, here and above.


def run_checks(g: Graph) -> DataFrame:
    """All findings: rule_ord (the order of the checks), level, rule, msg, module, id."""
    sm, parts = g.short_module, []
    for r in g.config.rules:
        if not r.checkable or not r.type:
            continue
        if r.type in RULE_TYPES:
            parts.append(RULE_TYPES[r.type](g, r))
        else:
            parts.append(g.spark.createDataFrame([("warn", "adr-coverage", f'{r.adr} uses unknown rule type "{r.type}"', None, None)], "level string, rule string, msg string, module string, id string"))
    v = layer_violations(g)
    msg = F.concat(sm("src"), F.lit(" ("), "src_group", F.lit(") depends on higher layer "), sm("dst"), F.lit(" ("), "dst_group", F.lit(") — "), F.col("cnt").cast("string"), F.lit(" call site(s)"))
    parts.append(_finding(v, "warn", "layers", msg, F.col("src")))
    rings = cycles(g).groupBy("component").agg(F.sort_array(F.collect_list(sm("module"))).alias("members"))
    msg = F.concat(F.lit("circular module dependency ("), F.size("members").cast("string"), F.lit("): "), F.array_join("members", " → "), F.lit(" → …"))
    parts.append(_finding(rings, "error", "cycle", msg, F.col("component")))
    msg = F.concat(sm(), F.lit(" has "), F.col("fns").cast("string"), F.lit(f" functions (> {g.config.god_functions}) — consider splitting"))
    parts.append(_finding(god_modules(g), "warn", "god-module", msg, F.col("module")))
    msg = F.concat(sm(), F.lit("::"), "short", F.lit(" is never called (dead code?)"))
    parts.append(_finding(orphans(g, dotted=False), "warn", "orphan", msg, F.col("module"), F.col("id")))
    msg = F.concat("id", F.lit(" ("), "title", F.lit(") is not onboarded into the checks"))
    parts.append(_finding(adr_coverage(g), "warn", "adr-coverage", msg))
    parts.append(duplicate_findings(g))
    return reduce(DataFrame.unionByName, [p.withColumn("rule_ord", F.lit(i).cast("long")) for i, p in enumerate(parts)]).select("rule_ord", *FINDING)


def rule_list(g: Graph) -> list[str]:
    return [r.adr for r in g.config.rules if r.checkable and r.type in RULE_TYPES] + ["cycle", "layers", "god-module", "orphan", "duplicate", "adr-coverage"]


def findings_by_rule(g: Graph, findings: DataFrame) -> DataFrame:
    """rule, hits, has_error of every rule, those without hits included."""
    rules = g.spark.createDataFrame([(r,) for r in dict.fromkeys(rule_list(g))], "rule string")
    counted = findings.groupBy("rule").agg(F.count("*").alias("hits"), F.max(F.col("level") == "error").alias("has_error"))
    return rules.join(counted, "rule", "left").fillna(0, ["hits"]).fillna(False, ["has_error"])


def finding_totals(findings: DataFrame) -> DataFrame:
    """errors and warnings (all findings that aren't errors)."""
    return findings.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") != "error").alias("warnings"))


def port_candidates(g: Graph, limit: int | None = 15) -> DataFrame:
    """Modules worth porting: much arithmetic, little coupling to layers of rank 2 and above."""
    higher = [grp for grp, rank in g.config.layers.items() if rank >= 2]
    ops = F.coalesce("numeric_ops", F.lit(0))
    a = g.nodes.groupBy("module").agg(F.count("*").alias("functions"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"), F.sum(ops).alias("ops"), F.max_by("short", F.struct(ops, -F.col("node_ord"))).alias("hottest_function"))
    up = g.module_nodes.filter(F.col("grp").isin(*higher)).select(F.col("module").alias("dst"))
    cross = g.module_edges.join(up, "dst", "left_semi").groupBy(F.col("src").alias("module")).agg(F.count("*").alias("coupling"))
    m = g.module_nodes.filter(~F.col("grp").isin(*g.config.unported_groups)).select("mod_ord", "module", "grp").join(a, "module").join(cross, "module", "left").fillna(0, ["coupling"])
    m = m.filter("ops > 0").withColumn("score", names.round1(F.col("ops") * F.log2(F.col("loc") + 2) / (1 + F.col("coupling"))))
    rows = m.select("mod_ord", g.short_module().alias("module"), F.col("module").alias("full_module"), "grp", "functions", "loc", F.col("ops").alias("numeric_ops"), "coupling", "hottest_function", "score")
    order = [F.desc("score"), F.asc("mod_ord")]
    rows = rows.orderBy(*order).limit(limit) if limit is not None else rows
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def recommendations(g: Graph, component_lines: int = 200, function_lines: int = 80) -> DataFrame:
    """rec_id, severity, id, label, sub, rank: advice, one row a finding, ranked within its recommendation."""
    n = g.nodes
    loc, calls = F.coalesce("loc", F.lit(0)), F.coalesce("callers", F.lit(0))
    parts = []
    if "legacy_reactive" in n.columns:
        old = n.filter((F.col("kind") == "component") & (F.col("legacy_reactive") > 0))
        parts.append(("runes", "warn", old, F.concat(F.col("legacy_reactive").cast("string"), F.lit(" legacy $: statement(s)")), F.col("legacy_reactive")))
    parts.append(("component-size", "warn", n.filter((F.col("kind") == "component") & (loc > component_lines)), F.concat(F.col("loc").cast("string"), F.lit(" lines")), F.col("loc")))
    own = F.col("kind").isin("function", "method")
    parts.append(("function-size", "info", n.filter(own & (loc > function_lines)), F.concat(F.col("loc").cast("string"), F.lit(" lines · "), g.short_module()), F.col("loc")))
    called = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    core = core_functions(g).join(sorted_side(called), "id").filter(~F.coalesce("tested", F.lit(False)))
    parts.append(("coverage", "info", core, F.concat(calls.cast("string"), F.lit(" callers · "), g.short_module()), F.col("callers")))
    rows = [
        df.select(F.lit(rec).alias("rec_id"), F.lit(severity).alias("severity"), "id", F.col("short").alias("label"), sub.alias("sub"), weight.cast("long").alias("weight"), "node_ord")
        for rec, severity, df, sub, weight in parts
    ]
    return ranked_within(reduce(DataFrame.unionByName, rows), "rec_id", "weight", "node_ord").drop("weight", "node_ord")


def ranked_within(rows: DataFrame, group: str, weight: str, tie: str, chunk: int = 1_024) -> DataFrame:
    """``rows`` with their rank in a group by descending weight, then ``tie``; no task gets a group whole.

    Rows are ranked among those of their weight and of a slice of ``tie``; how many come before is a sum over these
    slices, of which there are few.
    """
    sliced = rows.withColumn("__slice", F.floor(F.col(tie) / chunk))
    sizes = sliced.groupBy(group, weight, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(F.desc(weight), "__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(group, weight, "__slice").orderBy(tie))
    placed = sliced.withColumn("__within", within).join(starts, [group, weight, "__slice"])
    return placed.withColumn("rank", (F.col("__before") + F.col("__within")).cast("long")).drop("__slice", "__within", "__before")


# Fixed texts: titles and reasons of the recommendations.
TITLES = {
    "runes": ("Migrate {n} component(s) from legacy `$:` to runes", "Svelte 5 favours $state/$derived/$effect over legacy `$:` reactivity — clearer dependencies, smaller bundles, better tree-shaking."),
    "component-size": ("{n} Svelte component(s) exceed {component_lines} lines", "Large components are hard to test and re-render less efficiently — extract sub-components."),
    "function-size": ("{n} function(s) over {function_lines} lines", "Long functions concentrate complexity and resist unit testing. Split the largest into named helpers."),
    "coverage": ("Test core logic — {n}/{core} used service/engine fns are untested", "A layered architecture pays off when the business layer is covered. These have callers but no test — the most-called are the highest-value targets."),
}


def recommendation_titles(g: Graph, component_lines: int = 200, function_lines: int = 80) -> DataFrame:
    """rec_id, title, rationale, rec_rank of the recommendations that have findings."""
    rows = recommendation_order(recommendations(g, component_lines, function_lines))
    core = core_functions(g).agg(F.count("*").cast("string").alias("core"))
    told = g.spark.createDataFrame([(k, t.format(n="%n", core="%core", component_lines=component_lines, function_lines=function_lines), why) for k, (t, why) in TITLES.items()], "rec_id string, title string, rationale string")
    title = F.replace(F.replace("title", F.lit("%n"), F.col("n").cast("string")), F.lit("%core"), F.col("core"))
    return rows.join(told, "rec_id").join(F.broadcast(core)).select("rec_id", title.alias("title"), "rationale", F.col("rank").alias("rec_rank"))


def core_functions(g: Graph) -> DataFrame:
    """Functions and methods of the core groups that something calls."""
    core = g.nodes.filter(F.col("grp").isin(*g.config.core_groups) & F.col("kind").isin("function", "method"))
    return core.join(sorted_side(g.edges.select(F.col("dst").alias("id"))), "id", "left_semi")


def recommendation_order(rows: DataFrame) -> DataFrame:
    """rec_id, severity, n, rank: by severity, then number of findings."""
    level = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    counted = rows.groupBy("rec_id", "severity").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(level, F.desc("n"), "rec_id")).cast("long"))
