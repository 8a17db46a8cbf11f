"""Registered queries against their SQL on the smallest tables, and the entry module with and without its optional parts."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import quillon.catalog as catalog
from quillon.config import Config, num, slice_end
from quillon.functions import names
from quillon.operators import paths, rollups
from quillon.streaming import watch

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHOSEN = """calls calls_by_module calls_q client_index debounce_sessions describe_fn detail_panel diff_deps diff_modules diff_totals duplicates files_filter fn_detail fn_row functions_q hubs_modules
    is_stale layer_violations machines markdown_render module_coverage module_summary names orphans_check orphans_list page_files port_candidates rec_coverage resolve_function run_checks
    search_functions shortest_path stale_days test_depth typeahead union_nodes wikilink_join mdlink_join unit_dep_join extract_links fs_edges fs_nodes fs_walk adr_scan legacy_reactive porcelain_paths
    stale_decision machine_of online_ratio list_sort list_sort_files list_rows_calls list_filter word_wrap insight_filter check_lines markdown_modules diff_lines functions_sort_name
    client_index_modules""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events pages".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    def cell(v):
        if pd.isna(v):
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v).removesuffix(".0")

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_works_without_the_optional_parts(tmp_path):
    code = "import sys; sys.path.insert(0, %r)\nfor m in ('corpus_pipeline', 'quillon.llm'): sys.modules[m] = None\nimport __spark_entry__ as e; assert 'calls' in e.queries() and not any(q.startswith('op') for q in e.queries())" % ROOT
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0


def test_parameters():
    assert num(None, 5) == 5 and num("", 5) == 5 and num("x", 5) == 5 and num("2.5", 1) == 2.5 and num("-3", 1) == -3
    assert slice_end(-2, 5) == 3 and slice_end(2.9, 5) == 2 and slice_end(0, 5) == 0 and slice_end(9, 5) == 5
    assert Config.parse({"adrRules": [{"adr": "A", "callee": "f"}]}).rules[0].callees == ("f",)


def test_rounding_and_globs(spark):
    got = [r[0] for r in spark.createDataFrame([(1.45,), (0.25,), (0.75,), (2.05,), (1234.56,)], "x double").select(names.round1(pd_col("x"))).collect()]
    assert got == [1.4, 0.3, 0.8, 2.0, 1234.6]
    paths_ = spark.createDataFrame([("a/node_modules/b",), ("a/x1.md",), ("deep/er/x1.md",)], "p string")
    assert [r[0] for r in paths_.select(names.ignored(pd_col("p"), ["node_modules", "deep/**"])).collect()] == [True, False, True]


def pd_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_components_of_a_known_graph(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "a")]
    got = {r["id"]: r["component"] for r in paths.strong_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_reach_depth(spark):
    edges, sources = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "src string, dst string"), spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["depth"] for r in paths.reach_depth(edges, sources).collect()} == {"a": 0, "b": 1, "c": 1}


def test_edge_counts_drop_loops_and_unknown_ends(spark):
    sites = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", None)], "src string, dst string")
    assert [tuple(r) for r in rollups.edge_counts(sites).collect()] == [("a", "b", 2)]


def test_watch_rebuilds_once_a_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.ts").write_text("x")
    (tmp_path / "f.test.ts").write_text("x")
    seen = []
    changes = watch.watched(spark, str(tmp_path))
    assert changes.isStreaming and watch.debounced(changes).isStreaming
    query = watch.rebuild_on_change(changes, seen.append, str(tmp_path / "state"))
    query.awaitTermination(120)
    assert seen == [0]
