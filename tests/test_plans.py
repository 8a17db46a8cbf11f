"""Plans: the first rows of a rule or a group are cut in every task before they meet in one."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import rules, view
from quillon.plans import reports
from quillon.sources import lens


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark):
    """Findings, all of one rule (``same``, which the planner can't know for a constant)."""
    none = F.lit(None).cast("string")
    return spark.range(5000).select(F.concat(F.lit("R"), F.floor(F.col("id") / 5000)).alias("same"), F.lit("error").alias("level"), F.lit(0).cast("long").alias("rule_ord"), none.alias("module"), none.alias("id"), F.format_string("finding %05d", "id").alias("msg"))


def test_findings_are_cut_before_they_meet(spark, many):
    g = lens.graph(spark, "/root/testdata/sf0.001", 48)
    rule = rules.rule_list(g)[0]
    lines = reports.check_lines(g, many.withColumn("rule", F.replace("same", F.lit("R0"), F.lit(rule))))
    limits = [x for x in plan_of(lines).splitlines() if "WindowGroupLimit" in x]
    assert any("Partial" in x for x in limits) and any("Final" in x for x in limits)


def test_insights_are_cut_before_they_meet(many):
    rows = many.select(*[F.lit(0).cast("long").alias(c) if c.endswith("_ord") else F.col("same").alias(c) for c in view._GROUP], F.monotonically_increasing_id().alias("row_ord"), F.col("msg").alias("label"))
    shown = view.insight_shown(rows)
    assert "Partial" in "".join(x for x in plan_of(shown).splitlines() if "WindowGroupLimit" in x)
    got = shown.collect()
    assert len(got) == view.GROUP_ROWS and {r["more"] for r in got} == {5000 - view.GROUP_ROWS} and {r["label"] for r in got} == {f"finding {i:05d}" for i in range(view.GROUP_ROWS)}


def test_tables_of_nodes_are_not_broadcast(spark):
    g = lens.graph(spark, "/root/testdata/sf0.001", 48)
    for df in (g.nodes, g.edge_ends("module"), rules.orphans(g), rules.core_functions(g), rules.duplicates(g)):
        assert "Broadcast" not in plan_of(df)


def test_insights_without_findings_are_rows(spark):
    g = lens.graph(spark, "/root/testdata/sf0.001", 48)
    g = g.having(nodes=g.nodes.filter("kind <> 'function'"))
    rows = view.insight_rows(g)
    got = {(r["section"], r["title"]): r["n"] for r in view.insight_groups(rows).collect()}
    assert got["orphans", "Dead-code candidates"] == 0 and got["check", "orphan"] == 0
    assert rows.filter("label IS NULL").count() == sum(n == 0 for n in got.values())
