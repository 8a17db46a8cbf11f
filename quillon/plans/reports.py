"""Reports on checks and on what changed, as tables of lines, and the exit status that goes with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import diff, rules
from ..shared import global_index

#: Findings of a rule and new or gone dependencies that a report shows.
RULE_ROWS, DEP_ROWS = 25, 30


def check_lines(g: Graph, findings: DataFrame, most: int | None = RULE_ROWS) -> DataFrame:
    """rule_ord, line_ord, line: every rule with its mark and number of findings, the first findings, and how many more."""
    listed = list(dict.fromkeys(rules.rule_list(g)))
    order = g.spark.createDataFrame([(r, i) for i, r in enumerate(listed)], "rule string, rule_no long")
    counted = rules.findings_by_rule(g, findings).join(order, "rule")
    mark = F.when(F.col("has_error"), "✗").when(F.col("hits") > 0, "!").otherwise("✓")
    heads = counted.select("rule_no", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("  "), mark, F.lit(" "), "rule", F.when(F.col("hits") > 0, F.concat(F.lit(" ("), F.col("hits").cast("string"), F.lit(")"))).otherwise("")).alias("line"))
    places = g.nodes.select(F.col("id").alias("n_id"), "file", "line")
    by = Window.partitionBy("rule").orderBy("rule_ord", F.coalesce("module", F.lit("")), F.coalesce("id", F.lit("")), "msg")
    shown = findings.withColumn("nth", F.row_number().over(by).cast("long"))
    if most is not None:
        shown = shown.filter(F.col("nth") <= most)
    shown = shown.join(places, F.col("id") == F.col("n_id"), "left").join(order, "rule")
    place = F.coalesce(F.concat(F.lit(" — "), F.col("file"), F.lit(":"), F.col("line").cast("string")), F.lit(""))
    body = shown.select("rule_no", F.col("nth").alias("line_no"), F.concat(F.lit("      • "), "msg", place).alias("line"))
    out = heads.unionByName(body)
    if most is not None:
        more = counted.filter(F.col("hits") > most).select("rule_no", F.lit(most + 1).cast("long").alias("line_no"), F.concat(F.lit("      … +"), (F.col("hits") - most).cast("string"), F.lit(" more")).alias("line"))
        out = out.unionByName(more)
    return out


def exit_status(errors: int, warnings: int, strict: bool = False) -> int:
    return int(errors > 0 or (strict and warnings > 0))


def check_report(g: Graph, strict: bool = False, most: int | None = RULE_ROWS) -> tuple[str, int]:
    """The text of a check and its exit status."""
    found = rules.run_checks(g).persist()
    totals = rules.finding_totals(found).first()
    lines = [r["line"] for r in check_lines(g, found, most).orderBy("rule_no", "line_no").collect()]
    found.unpersist()
    head = f"{g.config.name} — architecture check ({g.nodes.count()} fns, {g.module_nodes.count()} modules)"
    foot = f"  {totals['errors']} error(s), {totals['warnings']} warning(s)" + (" (strict)" if strict else "")
    return "\n".join(["", head, "", *lines, "", foot, ""]), exit_status(totals["errors"], totals["warnings"], strict)


def diff_lines(base: Graph, current: Graph, most: int = DEP_ROWS) -> DataFrame:
    """section, rank, line of what changed: totals, modules, sizes, dependencies (the first of each direction)."""
    sm = current.short_module
    number = lambda c: F.col(c).cast("string")
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # noqa: E731  (of few rows)
    placed = lambda df, *order: global_index(df, order, "diff-lines").withColumn("rank", F.col("idx") + 1)  # noqa: E731  (of any number)
    totals = ranked(diff.totals(base, current), "what").select(F.lit("totals").alias("section"), "rank", F.concat("what", F.lit(" "), number("was"), F.lit(" → "), number("now"), F.lit(" ("), "delta", F.lit(")")).alias("line"))
    added = F.col("change") == "added"
    mods = placed(diff.modules(base, current), F.when(added, 0).otherwise(1), "module").select(F.lit("modules").alias("section"), "rank", F.concat(F.when(added, "+ ").otherwise("- "), sm(), F.when(added, " (").otherwise(" (was "), number("fns"), F.lit(" fns)")).alias("line"))
    warned = F.when(F.col("now_god"), F.concat(F.lit("  ⚠ now a god-module (>"), F.lit(str(current.config.god_functions)), F.lit(")"))).otherwise("")
    sizes = placed(diff.sizes(base, current), F.desc("delta"), "module").select(F.lit("sizes").alias("section"), "rank", F.concat(F.when(F.col("now") > F.col("was"), "▲ ").otherwise("▼ "), sm(), F.lit(" "), number("was"), F.lit(" → "), number("now"), F.lit(" fns"), warned).alias("line"))
    parts = [totals, mods, sizes]
    for change, sign in (("new", "+ "), ("gone", "- ")):
        d = diff.dependencies(base, current).filter(F.col("change") == change).orderBy("src", "dst").limit(most)
        parts.append(ranked(d, "src", "dst").select(F.lit(f"{change} dependencies").alias("section"), "rank", F.concat(F.lit(sign), sm("src"), F.lit(" → "), sm("dst")).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def diff_report(base: Graph, current: Graph, most: int = DEP_ROWS) -> tuple[str, int]:
    """The text of what changed and the number of changes that it shows."""
    titles = {"totals": "Totals", "modules": "Modules", "sizes": "Module size changes", "new dependencies": "Module dependencies: new", "gone dependencies": "Module dependencies: gone"}
    found = {name: [] for name in titles}
    for r in diff_lines(base, current, most).orderBy("section", "rank").collect():
        found[r["section"]].append(r["line"])
    changes = sum(len(v) for k, v in found.items() if k != "totals")
    lines = [x for k, title in titles.items() if found[k] for x in ("", f"  {title}", *(f"    {line}" for line in found[k]))]
    n = diff.dependencies(base, current).groupBy("change").count().collect()
    counts = {r["change"]: r["count"] for r in n}
    if max(counts.values(), default=0) > most:
        lines.append(f"    … ({counts.get('new', 0)} new, {counts.get('gone', 0)} removed)")
    return "\n".join([*lines, "" if changes else "\n  No structural changes.", ""]), changes
