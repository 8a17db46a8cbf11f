"""Extraction of a small tree of several languages: what becomes a node, what calls what, and what a wrong tree is told."""

import json

import pytest

from quillon.config import Config, load_project, tsconfig
from quillon.extract import build, scan, syntax, text
from quillon.operators import endpoints, paths, rules
from quillon.plans.dispatch import dispatch
from quillon.sources import graph_json

SPANS = """// ===== LIST HELPERS =====
/**
 * Splits a list into rows of a width.
 * @param width how many go into a row
 */
export function rowsOf<T>(list: T[], width: number): T[][] {
  const out: T[][] = [];
  for (let i = 0; i < list.length; i += width) {
    out.push(list.slice(i, i + width));
  }
  return out;
}

export const median = (values: number[]) => {
  const ordered = ranked(values);
  return ordered[Math.floor(ordered.length / 2)];
};

function ranked(values: number[]): number[] {
  return [...values].sort(byValue);
}

function byValue(a: number, b: number): number {
  return a - b;
}
"""
ORCHARD = """import { median, rowsOf as grid } from '../utils/spans';

export abstract class Plot {
  abstract area(): number;
  get label(): string {
    return `a plot of ${this.describe()} and { ${median([1, 2])} trees`;
  }
  describe(): string {
    return 'bare: area( { not code';
  }
}

export class Orchard extends Plot {
  constructor(private trees: number[]) {
    super();
  }
  area(): number {
    return grid(this.trees, 4).length;
  }
  async harvest(): Promise<number> {
    return this.area() * median(this.trees);
  }
}
"""
SEASON = """import { Orchard } from '$lib/core/Orchard';

type Step = (o: Orchard) => unknown;

function prune(o: Orchard) {
  return o.harvest();
}
function water(o: Orchard) {
  return o.area();
}
function rest() {
  return 0;
}

export const stages = {
  bud: { enter: water, leave: prune },
  fruit: { enter: (prune as Step), leave: rest }
};

export function advance(stage: 'bud' | 'fruit', o: Orchard) {
  return stages[stage].enter(o);
}

export function finish(stage: 'bud' | 'fruit', o: Orchard) {
  const current = stages[stage];
  return current.leave(o);
}
"""
MARKET = """import { advance, finish } from '../systems/season';
import { sold } from '$lib/stores/ledger';

export class Market {
  open(): void {
    schedule({ onTick: advance, late: { onEnd: finish! } });
    sold.update((n) => n + 1);
  }
}

export const schedule = (hooks: object) => hooks;

function relay() {
  return 1;
}

schedule({ onTick: relay });
"""
FILES = {
    "src/lib/utils/spans.ts": SPANS,
    "src/lib/core/Orchard.ts": ORCHARD,
    "src/lib/systems/season.ts": SEASON,
    "src/lib/services/market.ts": MARKET,
    "src/lib/services/bridge.ts": "import load from 'mill-pkg';\n\nexport async function millAll(n: number) {\n  const mod = await load();\n  return mod.grind_all(n);\n}\n",
    "src/lib/services/types.ts": "export type Price = { amount: number };\n",
    "src/lib/stores/ledger.ts": "/** Running total. */\nexport const sold = {\n  subscribe(run: (n: number) => void) {\n    run(0);\n    return () => {};\n  },\n  update(fn: (n: number) => number) {\n    fn(0);\n  }\n};\n",
    "src/Stall.svelte": "<script lang=\"ts\">\n  import { Market } from '$lib/services/market';\n  import { sold } from '$lib/stores/ledger';\n  const m = new Market();\n  $: double = $sold * 2;\n  m.open();\n</script>\n\n<b>{$sold}</b>\n",
    "src/lib/core/Orchard.test.ts": "import { Orchard } from './Orchard';\nimport { finish } from '../systems/season';\n\nnew Orchard([1]).harvest();\nfinish('bud', new Orchard([]));\n",
    "mill/Cargo.toml": "[package]\nname = \"mill\"\n",
    "mill/src/lib.rs": "/* outer /* fn inner() {} */ fn fake() {} */\npub struct Mill { load: u32 }\n\nimpl Mill {\n    /// Adds grain.\n    pub fn feed(&mut self, n: u32) {\n        self.load += n;\n        weigh(self.load);\n    }\n\n    fn sign(&self) -> char {\n        let raw = r#\"fn ghost() { \"quoted\" }\"#;\n        if raw.len() > 3 { '}' } else { '{' }\n    }\n}\n\nfn weigh<'a>(n: u32) {\n    assert!(n < 100);\n}\n\n#[wasm_bindgen]\npub fn grind_all(n: u32) -> u32 {\n    let mut m = Mill { load: 0 };\n    m.feed(n);\n    n\n}\n\n#[cfg(test)]\nmod tests {\n    use super::*;\n\n    #[test]\n    fn weighs() {\n        weigh(1);\n    }\n}\n",
    "press/Cargo.toml": "[package]\nname = \"press\"\n",
    "press/src/main.rs": "fn main() {}\n",
    "node_modules/dep/Cargo.toml": "[package]\n",
    "node_modules/dep/src/x.rs": "fn hidden() {}\n",
}
LAYERS = {"utils": 0, "core": 1, "systems": 2, "services": 3, "stores": 2, "components": 5}
CONFIG = Config(name="farm", layers=LAYERS)
ALIASES = {"$lib": "src/lib"}


def tree(folder, files):
    for path, content in files.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(content)
    return str(folder)


def extracted(spark, folder, files, config=CONFIG, aliases=ALIASES):
    return build.extract(build.read_files(spark, tree(folder, files)), config, aliases, ("mill",), "mill-pkg")


@pytest.fixture(scope="module")
def farm(spark, tmp_path_factory):
    return extracted(spark, tmp_path_factory.mktemp("farm"), FILES)


@pytest.fixture(scope="module")
def calls(farm):
    name = {r["id"]: r["short"] for r in farm.nodes.collect()}
    return {(name[r["src"]], name[r["dst"]]): r["cnt"] for r in farm.edges.collect()}


def test_declarations(farm):
    got = {r["short"]: r for r in farm.nodes.collect()}
    by_kind = {}
    for short, r in got.items():
        by_kind.setdefault(r["kind"], set()).add(short)
    assert by_kind == {
        "function": {"rowsOf", "median", "ranked", "byValue", "prune", "water", "rest", "advance", "finish", "schedule", "relay", "millAll", "weigh", "grind_all"},
        "method": {"Plot.area", "Plot.describe", "Orchard.constructor", "Orchard.area", "Orchard.harvest", "Market.open", "subscribe", "update", "Mill.feed", "Mill.sign"},
        "accessor": {"Plot.get label"}, "store": {"sold"}, "component": {"Stall"},
    }
    assert {s for s, r in got.items() if r["exported"] and r["lang"] == "ts" and r["kind"] == "function"} == {"rowsOf", "median", "advance", "finish", "schedule", "millAll"}
    assert got["rowsOf"]["doc"] == "Splits a list into rows of a width." and (got["rowsOf"]["line"], got["rowsOf"]["end_line"], got["rowsOf"]["loc"]) == (6, 12, 7)
    assert got["rowsOf"]["numeric_ops"] == 3 and got["median"]["numeric_ops"] == 2 and got["byValue"]["numeric_ops"] == 1
    assert got["Orchard.harvest"]["module"] == "core/Orchard" and got["Orchard.harvest"]["class_name"] == "Orchard" and got["sold"]["doc"] == "Running total."
    assert got["Stall"]["legacy_reactive"] == 1 and got["Mill.feed"]["id"] == "rust:mill/lib::Mill.feed@6" and got["Mill.feed"]["doc"] == "Adds grain."


def test_calls_by_name_and_import(calls):
    assert {(a, b) for a, b in calls if a in ("median", "Orchard.area", "Orchard.harvest", "prune", "water")} == {
        ("median", "ranked"), ("Orchard.area", "rowsOf"), ("Orchard.harvest", "Orchard.area"), ("Orchard.harvest", "median"), ("prune", "Orchard.harvest"), ("water", "Orchard.area"),
    }


def test_code_in_templates_is_code(calls):
    assert {b for a, b in calls if a == "Plot.get label"} == {"Plot.describe", "median"} and not any(a == "Plot.describe" for a, _ in calls)


def test_functions_handed_over(calls):
    assert ("ranked", "byValue") in calls
    assert {b for a, b in calls if a == "Market.open"} == {"schedule", "advance", "finish", "sold", "update"}


def test_calls_through_registries(calls):
    assert {b for a, b in calls if a == "advance"} == {"water", "prune"} and {b for a, b in calls if a == "finish"} == {"prune", "rest"}


def test_components_stores_and_crates(calls):
    assert {b for a, b in calls if a == "Stall"} == {"Market.open", "sold"}
    assert {b for a, b in calls if a in ("millAll", "grind_all", "Mill.feed", "Mill.sign")} == {"grind_all", "Mill.feed", "weigh"} and ("millAll", "grind_all") in calls


def test_marks(farm):
    got = {r["short"]: r for r in farm.nodes.collect()}
    assert {s for s, r in got.items() if r["tested"]} == {"Orchard.harvest", "finish", "weigh"}
    assert {s for s, r in got.items() if r["module_used"]} == {"schedule", "relay"}
    depth = {s: r["test_depth"] for s, r in got.items()}
    assert (depth["finish"], depth["prune"], depth["Orchard.area"], depth["rowsOf"], depth["byValue"], depth["Market.open"]) == (0, 1, 1, 2, 3, None)


def test_files_without_nodes_are_listed(farm):
    got = {r["file"]: r["fns"] for r in farm.files.collect()}
    assert got["src/lib/services/types.ts"] == 0 and got["src/lib/utils/spans.ts"] == 4 and "src/lib/core/Orchard.test.ts" not in got


def test_order_of_nodes_and_edges(farm):
    rows = [(r["file"].endswith(".rs"), r["file"].endswith(".svelte"), r["file"], r["line"]) for r in farm.nodes.orderBy("node_ord").collect()]
    assert rows == sorted(rows) and sorted(r["node_ord"] for r in farm.nodes.collect()) == list(range(len(rows)))
    assert sorted(r["edge_ord"] for r in farm.edges.collect()) == list(range(farm.edges.count()))


def test_crates(spark, tmp_path):
    present = build.crates(spark, tree(tmp_path, FILES))
    assert {r["crate"] for r in present.collect()} == {"mill", "press"}
    assert {tuple(r) for r in build.crate_warnings(present, ["mill", "dryer"]).collect()} == {("dryer", "missing"), ("press", "unlisted")}


def test_endpoints(farm):
    found = dispatch(farm, "/path", {"from": "finish", "to": "byValue"})[1]
    assert [s["name"] for s in found["path"]] == ["finish", "prune", "Orchard.harvest", "median", "ranked", "byValue"] and found["hops"] == 5
    assert not dispatch(farm, "/path", {"from": "byValue", "to": "finish"})[1]["reachable"] and not dispatch(farm, "/path", {"from": "finish", "to": "byValue", "max": "4"})[1]["reachable"]
    assert not dispatch(farm, "/path", {"from": "rest", "to": "rest"})[1]["reachable"]
    assert {c["name"] for c in dispatch(farm, "/callers", {"name": "prune"})[1]["callers"]} == {"advance", "finish"}
    assert dispatch(farm, "/stats")[1]["functions"] == 27 and dispatch(farm, "/function", {"name": "none such"})[0] == 404
    assert dispatch(farm, "/function", {"name": "e"})[1]["ambiguous"] is True and dispatch(farm, "/function")[0] == 400 and dispatch(farm, "/else")[0] == 404
    assert dispatch(farm, "/functions", {"testReachable": "true", "module": "utils/spans"})[1]["count"] == 4
    assert len(dispatch(farm, "/functions", {"limit": "-20"})[1]["functions"]) == 7 and dispatch(farm, "/functions", {"module": "nowhere"})[1]["count"] == 0
    assert dispatch(farm, "/module", {"name": "spans"})[1]["usedBy"] == [{"module": "core/Orchard", "callSites": 3}]
    assert dispatch(farm, "/files", {"q": "TYPES"})[1]["count"] == 1


def test_aliases_of_a_project(tmp_path):
    files = {
        "tsconfig.json": '{ // comments and trailing commas are fine\n "extends": "./base.json", "compilerOptions": {"paths": {"@own/*": ["own/*"],}} }',
        "base.json": '{"compilerOptions": {"paths": {"$lib": ["src/lib"], "$lib/*": ["src/lib/*"]}}}',
        "lost.json": '{"extends": "./made/tsconfig.json"}',
    }
    tree(tmp_path, files)
    assert tsconfig(str(tmp_path / "tsconfig.json"), {}) == ({"@own": "own", "$lib": "src/lib"}, [])
    aliases, warnings = tsconfig(str(tmp_path / "lost.json"), {})
    assert aliases == {} and len(warnings) == 1 and "./made/tsconfig.json" in warnings[0]
    assert tsconfig(str(tmp_path / "lost.json"), {"$lib/*": ["src/lib/*"]}) == ({"$lib": "src/lib"}, [])


def test_imports_by_alias_need_it(spark, tmp_path):
    g = extracted(spark, tmp_path, FILES, aliases={})
    name = {r["id"]: r["short"] for r in g.nodes.collect()}
    assert not any(name[r["src"]] == "Stall" and name[r["dst"]] == "sold" for r in g.edges.collect())


def test_project_with_decisions_and_descriptions(spark, tmp_path):
    told = {
        "name": "farm", "layers": LAYERS, "rustCrates": ["mill"], "adrsDoc": "DECISIONS.md", "descriptions": "words.json", "paths": {"$lib/*": ["src/lib/*"]}, "wasmPackage": "mill-pkg",
        "adrRules": [{"adr": "ADR-001", "type": "restricted-callee", "callee": "median", "allowFrom": ["Orchard.harvest"]}],
    }
    more = {"project.json": json.dumps(told), "DECISIONS.md": "# All\n## ADR-001 (old): Keep medians apart\ntext\n### ADR-002: No cycles \n##### ADR-003: too deep\n", "words.json": json.dumps({"modules": {"utils/spans": "Lists."}, "functions": {"utils/spans::median": "The middle."}})}
    root = tree(tmp_path, FILES | more)
    project = load_project(str(tmp_path / "project.json"))
    assert project.src_token == "/src/lib/" and project.config.god_functions == 40 and project.tsconfig == str(tmp_path / "tsconfig.json")
    g, warnings = build.extract_project(spark, root, project)
    assert [(r["id"], r["title"]) for r in g.adrs.orderBy("id").collect()] == [("ADR-001", "Keep medians apart"), ("ADR-002", "No cycles")]
    assert {(w["what"], w["subject"]) for w in warnings.collect()} == {("crate unlisted", "press")}
    assert endpoints.fn_rows(g).filter("name = 'median'").first()["description"] == "The middle."
    got = {(r["rule"], r["msg"]) for r in rules.run_checks(g).collect()}
    assert ("adr-coverage", "ADR-002 (No cycles) is not onboarded into the checks") in got and sum(r == "ADR-001" for r, _ in got) == 1
    with pytest.raises(FileNotFoundError):
        load_project(str(tmp_path / "none.json"))


def test_wrong_tree(spark, tmp_path):
    wrong = FILES | {
        "src/lib/utils/up.ts": "import { advance } from '../systems/season';\n\nexport function climb() {\n  return advance('bud', null);\n}\n",
        "src/lib/systems/season.ts": "import { climb } from '../utils/up';\n" + SEASON.replace("return 0;", "return climb();") + "\nfunction unused() {\n  return 3;\n}\n",
    }
    found = [(r["level"], r["rule"], r["msg"]) for r in rules.run_checks(extracted(spark, tmp_path, wrong)).collect()]
    assert ("warn", "layers", "utils/up (utils) depends on higher layer systems/season (systems) — 1 call site(s)") in found
    assert [lv for lv, r, _ in found if r == "cycle"] == ["error"]
    assert any(r == "orphan" and m.startswith("systems/season::unused ") for _, r, m in found)


def test_right_tree_has_no_errors(farm):
    status, body = dispatch(farm, "/check")
    assert status == 200 and body["errors"] == 0 and {f["rule"] for f in body["findings"]} <= {"orphan"}


def test_documents_round_trip(spark, farm, tmp_path):
    path = str(tmp_path / "farm.json")
    graph_json.write(farm, path, generatedAt="2024-01-01T00:00:00Z")
    back = graph_json.read(spark, path)
    assert graph_json.list_graphs(str(tmp_path)) == ["farm"] and back.edges.count() == farm.edges.count() and back.config.layers["systems"] == 2
    assert {(r["src"], r["dst"], r["cnt"]) for r in back.edges.collect()} == {(r["src"], r["dst"], r["cnt"]) for r in farm.edges.collect()}
    graph_json.write_tables(farm, str(tmp_path / "t"), "one")
    assert graph_json.read_tables(spark, str(tmp_path / "t"), "one", CONFIG).edges.count() == farm.edges.count()


def test_registry(spark):
    old = spark.createDataFrame([("a", "/a", "filesystem", "box", None)], "name string, path string, kind string, machine string, ts_host string")
    got = {r["name"]: r for r in graph_json.register(graph_json.register(old, {"name": "a", "path": "/b"}), {"name": "n", "path": "/n"}).collect()}
    assert (got["a"]["path"], got["a"]["machine"], got["a"]["kind"]) == ("/b", "box", "filesystem") and got["n"]["kind"] == "code"


def test_path_ties_follow_edge_order(spark, farm):
    e = spark.createDataFrame([(0, "s", "b", 1), (1, "s", "a", 1), (2, "a", "t", 1), (3, "b", "t", 1)], "edge_ord long, src string, dst string, cnt long")
    n = spark.createDataFrame([(x, x) for x in "sabt"], "id string, short string")
    assert [r["id"] for r in paths.shortest_path(farm.having(nodes=n, edges=e), "s", "t").orderBy("hop").collect()] == ["s", "b", "t"]


def test_innermost_span_of_a_point(spark):
    spans = spark.createDataFrame([("f", "outer", 0, 100), ("f", "inner", 10, 20), ("f", "twin", 30, 40), ("g", "other", 0, 5)], "file string, id string, start long, stop long")
    points = spark.createDataFrame([("f", p) for p in (0, 1, 10, 11, 20, 21, 35, 100, 101)] + [("g", 3), ("h", 1)], "file string, at long")
    got = {(r["file"], r["at"]): r["owner"] for r in build.innermost(points, spans, "at").collect()}
    assert got == {("f", 0): None, ("f", 1): "outer", ("f", 10): "outer", ("f", 11): "inner", ("f", 20): "inner", ("f", 21): "outer", ("f", 35): "twin", ("f", 100): "outer", ("f", 101): None, ("g", 3): "other", ("h", 1): None}


def test_scripts_and_blanks_keep_their_place():
    html = "<p>\n</p><script>\nlet a = 1;\n</script>\n<script lang='ts'>let b;</script>"
    blanked = scan.script_only(html)
    assert len(blanked) == len(html) and blanked.index("let a") == html.index("let a") and "<p>" not in blanked and "let b" in blanked
    code = "a(`x ${b({c: `deep ${d()} }`})} y(` + 'z(' + \"w(\") // v(\n"
    blanked = text.blank(code)
    assert len(blanked) == len(code) and all(x in blanked for x in ("a(", "b({c:", "d()")) and not any(x in blanked for x in ("x", "deep", "y(", "z(", "w(", "v("))


@pytest.mark.parametrize(("given", "bare"), [("f", "f"), (" (f) ", "f"), ("f as Handler", "f"), ("({ a: b } satisfies T)", "{ a: b }"), ("f!", "f"), ("(a)(b)", "(a)(b)"), ("x.y as unknown as Z", "x.y")])
def test_arguments_without_wrappers(given, bare):
    assert scan.bare_argument(given) == bare


GROVE = {
    "src/lib/a/body.ts": """const own = (n: number) => n, foo = (n) => { n; };
const p = () => own(1);
const q = () => 1 + own(2);
const r = async (x) => await own(x);
const s = x => foo(x);
export function t() { return foo(3) }
const memo = lazily(() => foo(4));
function lazily(make = own(5)) { return make; }
""",
    "src/lib/a/kinds.ts": """import { writable as made, derived } from 'svelte/store';
export class Pump {
  private state = { a: 1 };
  get level(): number { return this.read(); }
  set level(n: number) { this.write(n); }
  read = () => 1;
  write = async (n: number): Promise<void> => { const local = () => this.read(); local(); };
  idle = function () { return 0; };
}
export const count = made(0);
export const twice = derived<number>(count, ($c) => $c * 2);
export const plain = { size: 1 };
export function raise() { count.update((n) => n + 1); }
""",
    "src/lib/a/Meter.svelte": """<script lang="ts">
  import { count, twice as double } from './kinds';
  function local() { return 1; }
</script>
<p>{$count} {$double}</p>
""",
    "src/lib/b/one.ts": "export function alpha() {}\nexport function beta() {}\nexport default function gamma() {}\nfunction hidden() {}\nexport { hidden as shown };\n",
    "src/lib/b/two.ts": "import { beta } from './one';\nexport function alpha() {}\nexport { beta as relayed };\nexport * from './three';\n",
    "src/lib/b/three.ts": "export * from './two';\nexport * from './one';\nexport function delta() {}\n",
    "src/lib/b/index.ts": "export * from './two';\nexport { default as fifth } from './one';\nexport * as inner from './one';\n",
    "src/lib/c/use.ts": """import * as ns from '../b/one';
import main from '../b/one';
import { alpha, delta, relayed, fifth, shown, inner } from '../b';
import type { Nothing } from './none';
export function u1() { ns.alpha(); }
export function u2() { main(); }
export function u3() { alpha(); }
export function u4() { delta(); }
export function u5() { relayed(); }
export function u6() { fifth(); }
export function u7() { shown(); }
export function u8() { inner.beta(); }
export function u9() { ns.missing(); }
""",
    "src/lib/d/registry.ts": """export const table = { open: { run: first }, shut: { run: second, other: () => third() } };
function first() {}
function second() {}
function third() {}
export class Desk {
  handlers = { go: first, stop: (n) => second() };
  act(key) { const h1 = this.handlers[key]; const h2 = h1; const h3 = h2; h3(1); }
  far(key) { const w1 = this.handlers[key]; const w2 = w1; const w3 = w2; const w4 = w3; const w5 = w4; const w6 = w5; const w7 = w6; w7(1); }
}
export function each(key) { table[key].run(); }
export function any(a, b) { table[a][b](); }
export function list(xs) { xs[0].map(first); }
""",
    "src/lib/d/away.ts": "import { table as held } from './registry';\nexport function there(k) { const now = held[k]; now.run(); }\n",
}


@pytest.fixture(scope="module")
def grove(spark, tmp_path_factory):
    g = build.extract(build.read_files(spark, tree(tmp_path_factory.mktemp("grove"), GROVE)), CONFIG, ALIASES)
    name = {r["id"]: r["name"] for r in g.nodes.collect()}
    return {(r["file"].rsplit("/", 1)[-1], r["name"]): r for r in g.nodes.collect()}, {(name[r["src"]], name[r["dst"]]) for r in g.edges.collect()}


def test_an_expression_that_is_the_body_belongs_to_it(grove):
    nodes, calls = grove
    assert {(a, b) for a, b in calls if b in ("own", "foo")} == {("p", "own"), ("q", "own"), ("r", "own"), ("s", "foo"), ("t", "foo")}
    used = {name for (file, name), r in nodes.items() if file == "body.ts" and r["module_used"]}
    assert used == {"lazily", "foo"}  # foo by the function that only lazily() gets; own(5) stands among parameters


def test_members_and_accessors_are_kept_apart(grove):
    nodes, calls = grove
    kinds = {name: (r["kind"], r["class_name"]) for (file, name), r in nodes.items() if file == "kinds.ts"}
    assert kinds == {
        "Pump.get level": ("accessor", "Pump"), "Pump.set level": ("accessor", "Pump"), "Pump.read": ("method", "Pump"), "Pump.write": ("method", "Pump"), "Pump.idle": ("method", "Pump"), "Pump.local": ("function", "Pump"),
        "count": ("store", None), "twice": ("store", None), "raise": ("function", None),
    }
    assert {(a, b) for a, b in calls if a.startswith("Pump.")} == {("Pump.get level", "Pump.read"), ("Pump.set level", "Pump.write"), ("Pump.local", "Pump.read"), ("Pump.write", "Pump.local")}


def test_stores_of_factories_are_read_and_updated(grove):
    nodes, calls = grove
    assert {(a, b) for a, b in calls if b in ("count", "twice")} == {("raise", "count"), ("Meter", "count"), ("Meter", "twice")}
    assert [name for file, name in nodes if file == "Meter.svelte"] == ["Meter"]


def test_names_are_followed_through_modules(grove):
    nodes, calls = grove
    assert {(a, b) for a, b in calls if a.startswith("u")} == {("u1", "alpha"), ("u2", "gamma"), ("u3", "alpha"), ("u4", "delta"), ("u5", "beta"), ("u6", "gamma"), ("u7", "hidden"), ("u8", "beta")}


def test_own_exports_shadow_starred_ones(spark):
    gives = spark.createDataFrame([("m", "*", "n", "*"), ("m", "a", None, "a0"), ("n", "a", None, "a1"), ("n", "b", None, "b1"), ("n", "default", None, "d"), ("n", "*", "m", "*"), ("m", "k", "n", "b"), ("p", "q", None, "local")], "module string, name string, source string, original string")
    brings = spark.createDataFrame([("p", "local", "m", "k"), ("x", "ns", "n", "*")], "module string, local string, source string, name string")
    wanted = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "default"), ("m", "none"), ("p", "q"), ("z", "free")], "module string, name string")
    got = {(r["module"], r["name"]): (r["d_module"], r["d_name"]) for r in build.exported_names(wanted, gives, brings).collect()}
    assert (got["m", "a"], got["m", "b"], got["p", "q"], got["z", "free"], got["m", "default"]) == (("m", "a0"), ("n", "b1"), ("n", "b1"), ("z", "free"), ("m", "default"))


def test_registries_are_found_through_values(grove):
    nodes, calls = grove
    assert {b for a, b in calls if a == "Desk.act"} == {"first", "Desk.handlers.stop"} and not any(a == "Desk.far" for a, _ in calls)
    assert {b for a, b in calls if a == "each"} == {"first", "second"} and {b for a, b in calls if a == "any"} == {"first", "second", "table.shut.other"}
    assert {b for a, b in calls if a == "there"} == {"first", "second"} and {b for a, b in calls if a == "list"} == {"first"}
    assert nodes["registry.ts", "Desk.handlers.stop"]["short"] == "Desk.stop"


@pytest.mark.parametrize(
    ("code", "weight"),
    [
        ("a + b", 1), ("-x", 1), ("+x + -y", 3), ("x[i]", 1), ("x[0][1]", 2), ("x?.[0]", 1), ("f(x, y)[0]", 1), ("for (;;) {}", 2), ("for (const a of b) {}", 2), ("for await (const a of b) {}", 2), ("for (const a in b) {}", 0),
        ("while (x) {}", 2), ("do { x } while (y)", 0), ("a * b / c % d ** e", 4), ("i++; --j; k += 1", 0), ("'a' + b", 1), ("let x: number[] = y;", 0), ("const x: Foo['bar'] = y", 0), ("const [a, b] = c", 0), ("f(a as Foo[], b)", 0),
        ("/a+b/.test(c)", 0), ("a / b / c", 2), ("if (a) /b+/.exec(c)", 0), ("return /x*[/]y/g", 0), ("function* g() {}", 0), ("a < b && c > d", 0), ("new Map<string, number[]>()", 0), ("`${a + b} + c`", 1), ("(a: number[]) => a[0]", 1),
        ("x = y ? [1] : [2]", 0), ("type A = B[0];", 0), ("{ [k]: 1 }", 0), ("return [a][0] - 1", 2), ("// a + b\n/* c * d */ '+'", 0),
    ],
)
def test_numeric_weights(code, weight):
    assert syntax.Tokens(code).numeric(0, len(code)) == weight


@pytest.mark.parametrize("code", ["", "}", "(", "`${", "`${a", "class", "class {", "const", "const x", "export", "export {", "export default", "import", "import {", "x => ", "a ? b :", "({", "function", "function f(", "get", "'", "/", "<", "type", "type A", "async", "@", "\\", "export const x: Map<", "class A { static", "class A { get", "class A { x", "for (", "\u2028 é"])
def test_broken_sources_end(code):
    module = syntax.Module(code)
    list(scan.calls("a.ts", code, "a")), list(scan.typescript("a.ts", code, "g"))
    assert module.tokens.numeric(0, len(code)) >= 0


def test_few_bytes_of_texts_are_many_tasks(spark):
    files = spark.range(40).selectExpr("concat('src/lib/s', id, '.ts') AS path", "concat('export function f', id, '() { return 1; }') AS text").coalesce(1)
    found = build._facts(files, Config(name="many"), {}, ())["decl"]
    assert found.count() == 40 and found.select("module").distinct().count() == 40
    assert len(found.inputFiles()) > 2
