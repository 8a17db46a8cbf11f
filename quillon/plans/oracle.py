"""SQL (DuckDB) with which the registered queries of the graph engine are compared."""

from __future__ import annotations

from ..functions import names
from ..operators import rules
from ..sources import lens


def _sm(column: str) -> str:
    return f"CASE WHEN starts_with({column}, 'lib/') THEN substr({column}, 5) ELSE {column} END"


def _humanize(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace({x}, 'Impl$', ''), 'Service$', '')"
    low = f"lower({_spaced(spaced)})"
    return f"(upper(substr({low}, 1, 1)) || substr({low}, 2))"


def _spaced(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_\-]+', ' ', 'g'))"


def _case(values: dict[str, str], of: str, other: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


def _round1(x: str) -> str:
    return f"(CASE WHEN ({x}) - floor({x}) IN (0.25, 0.75) THEN ceil(({x}) * 10) / 10 ELSE CAST(format('{{:.1f}}', CAST({x} AS DOUBLE)) AS DOUBLE) END)"


def _fmt_size(x: str) -> str:
    text = lambda v: f"format('{{:.1f}}', {_round1(v)})"
    return f"CASE WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} < 1048576 THEN {text(f'{x} / 1024.0::DOUBLE')} || ' KB' ELSE {text(f'{x} / 1048576.0::DOUBLE')} || ' MB' END"


def _graph(q: int, until: str | None = None, prefix: str = "", keep: str = "true") -> str:
    """The lens and everything that is derived from its nodes and edges, as CTEs."""
    p = prefix
    shipped = f" AND l_shipdate < TIMESTAMP '{until}'" if until else ""
    return f"""
{p}p AS (SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS bn, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
{p}n0 AS (SELECT *, CASE WHEN bn = 25 THEN 'dev' ELSE ['core', 'utils', 'services', 'systems', 'stores', 'components'][bn % 6 + 1] END AS grp,
  CASE WHEN p_partkey % 8 <= 3 THEN 'function' WHEN p_partkey % 8 = 4 THEN 'method' WHEN p_partkey % 8 = 5 THEN 'accessor' WHEN p_partkey % 8 = 6 THEN 'component' ELSE 'store' END AS kind FROM {p}p),
{p}n1 AS (SELECT CAST(p_partkey AS BIGINT) AS node_ord, 'part/' || p_partkey AS id,
  CASE WHEN kind IN ('method', 'accessor') THEN w1 || '.' || w2 || (p_partkey % 300) WHEN kind = 'function' AND p_partkey % 16 = 1 THEN w1 || '.' || w2
       WHEN kind = 'function' THEN w2 || (p_partkey % 300) ELSE w1 || p_partkey END AS short,
  'lib/' || grp || '/Brand' || bn AS module, grp, kind, CASE WHEN kind IN ('method', 'accessor') THEN w1 END AS class_name, p_size % 2 = 0 AS exported, p_size = 50 AS tested,
  p_size = 1 AS module_used, p_partkey % 13 = 0 AS nested, CAST(p_size * 3 AS BIGINT) AS loc, CAST(floor(p_retailprice) AS BIGINT) AS chars, CAST(p_partkey % 11 AS BIGINT) AS numeric_ops,
  CASE WHEN p_size % 3 = 0 THEN p_type || ' ' || p_name ELSE '' END AS doc, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Handle ' || p_name || '.' END AS descr,
  CASE WHEN kind = 'component' THEN CAST(p_partkey % 4 AS BIGINT) ELSE 0 END AS legacy_reactive FROM {p}n0),
{p}n2 AS (SELECT * FROM {p}n1 WHERE {keep}),
{p}t AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem WHERE l_quantity >= {q}{shipped}),
{p}edges AS (SELECT CAST(a * 10000000000 + b AS BIGINT) AS edge_ord, 'part/' || a AS src, 'part/' || b AS dst, CAST(count(*) AS BIGINT) AS cnt FROM {p}t WHERE b IS NOT NULL AND a <> b GROUP BY a, b),
{p}nodes AS (SELECT n.*, 'src/' || module || '.ts' AS file, node_ord AS line, {_humanize('short')} AS humanized, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM {p}n2 n
  LEFT JOIN (SELECT dst, count(*) AS c FROM {p}edges GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM {p}edges GROUP BY 1) o ON o.src = n.id),
{p}mn AS (SELECT min(node_ord) AS mod_ord, module, arg_min(grp, node_ord) AS grp, arg_min(file, node_ord) AS file, CAST(count(*) AS BIGINT) AS fns FROM {p}nodes GROUP BY module),
{p}ee AS (SELECT e.*, a.module AS am, b.module AS bm, a.short AS ash, b.short AS bsh FROM {p}edges e JOIN {p}nodes a ON a.id = e.src JOIN {p}nodes b ON b.id = e.dst),
{p}me AS (SELECT am AS src, bm AS dst, CAST(sum(cnt) AS BIGINT) AS cnt, min(edge_ord) AS medge_ord FROM {p}ee WHERE am <> bm GROUP BY 1, 2)"""


_DERIVED = f"""
curated AS (SELECT DISTINCT module || '::' || short AS key, 'Curated note on ' || short AS text FROM nodes WHERE node_ord % 17 = 0),
d AS (SELECT n.*, CASE WHEN c.text <> '' THEN c.text WHEN doc <> '' THEN descr ELSE coalesce(nullif(descr, ''), humanized) END AS description,
  CASE WHEN c.text <> '' THEN 'curated' WHEN doc <> '' THEN 'jsdoc' ELSE 'inferred' END AS description_source FROM nodes n LEFT JOIN curated c ON c.key = n.module || '::' || n.short),
rows AS (SELECT node_ord, id, short AS name, {_sm('module')} AS module, grp, kind, exported, tested, file, line, loc, chars, numeric_ops, description, description_source, in_degree, out_degree FROM d),
msz AS (SELECT m.module, s.loc, s.chars, coalesce(o.c, 0) AS dep_out, coalesce(i.c, 0) AS dep_in FROM mn m
  JOIN (SELECT module, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(chars) AS BIGINT) AS chars FROM nodes GROUP BY 1) s USING (module)
  LEFT JOIN (SELECT src, count(*) AS c FROM me GROUP BY 1) o ON o.src = m.module LEFT JOIN (SELECT dst, count(*) AS c FROM me GROUP BY 1) i ON i.dst = m.module),
md AS (SELECT *, CASE WHEN module LIKE '%5' THEN 'Curated text of ' || module ELSE fns || ' functions. No curated description yet.' END AS description FROM mn),
ms AS (SELECT mod_ord, {_sm('module')} AS module, module AS full_module, grp, file, fns AS function_count, description, loc, chars, dep_out AS depends_on_count, dep_in AS used_by_count FROM md JOIN msz USING (module)),
fl AS (SELECT min(node_ord) AS file_ord, file, arg_min(module, node_ord) AS module, arg_min(grp, node_ord) AS grp, CAST(count(*) AS BIGINT) AS fns FROM nodes GROUP BY file),
fs AS (SELECT file_ord, file, {_sm('module')} AS module, grp, fns AS functions, loc, chars FROM fl JOIN msz USING (module)),
cl AS (SELECT edge_ord, ash AS caller, bsh AS callee, {_sm('am')} AS from_module, {_sm('bm')} AS to_module, cnt, am <> bm AS cross_module, src AS caller_id, dst AS callee_id, am, bm FROM ee),
lay AS (SELECT * FROM (VALUES {", ".join(f"('{g}', {r})" for g, r in lens.LAYERS.items())}) AS l(grp, layer)),
cm AS (SELECT src, dst, cnt FROM me),
viol AS (SELECT c.src, c.dst, a.grp AS src_group, b.grp AS dst_group, c.cnt FROM cm c JOIN mn a ON a.module = c.src JOIN mn b ON b.module = c.dst JOIN lay la ON la.grp = a.grp JOIN lay lb ON lb.grp = b.grp
  WHERE la.layer >= 0 AND lb.layer >= 0 AND la.layer < lb.layer),
lone AS (SELECT * FROM nodes WHERE kind = 'function' AND NOT exported AND NOT tested AND NOT module_used AND grp <> 'stores' AND id NOT IN (SELECT dst FROM edges)),
dup0 AS (SELECT short, module, min(node_ord) AS first_ord, count(*) AS n FROM nodes WHERE kind = 'function' AND NOT contains(short, '.') AND NOT nested GROUP BY 1, 2),
dups AS (SELECT short AS name, CAST(count(*) AS BIGINT) AS n_modules, CAST(sum(n) AS BIGINT) AS n_nodes, string_agg(module, ',' ORDER BY first_ord) AS modules, string_agg({_sm('module')}, ', ' ORDER BY first_ord) AS shorts,
  arg_min(module, first_ord) AS first_module, 'part/' || min(first_ord) AS first_id FROM dup0 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4),
adrs AS (SELECT * FROM (VALUES {", ".join(str(a) for a in lens.ADRS)}) AS a(id, title)),
uncovered AS (SELECT * FROM adrs WHERE id NOT IN ('ADR-001', 'ADR-002', 'ADR-003')),
forbid AS (SELECT 'error' AS level, 'ADR-001' AS rule, {_sm('am')} || '::' || ash || ' calls ' || {_sm('bm')} || '::' || bsh AS msg, am AS module, src AS id FROM ee
  WHERE bm = 'lib/core/Brand6' AND am NOT IN ('lib/core/Brand6', 'lib/core/Brand12', 'lib/utils/Brand1')),
restrict AS (SELECT 'warn' AS level, 'ADR-002' AS rule, {_sm('am')} || '::' || ash || ' calls ' || bsh AS msg, am AS module, src AS id FROM ee
  WHERE bsh IN {lens.CONFIG.rules[1].callees} AND ash NOT IN {lens.CONFIG.rules[1].allow_from} AND {_sm('am')} || '::' || ash NOT IN {lens.CONFIG.rules[1].allow_from} AND am || '::' || ash NOT IN {lens.CONFIG.rules[1].allow_from}),
indeg AS (SELECT dst AS id, count(*) AS callers FROM edges GROUP BY 1),
recs AS (SELECT 'runes' AS rec_id, 'warn' AS severity, id, short AS label, legacy_reactive || ' legacy $: statement(s)' AS sub, row_number() OVER (ORDER BY legacy_reactive DESC, node_ord) AS rank FROM nodes WHERE kind = 'component' AND legacy_reactive > 0
  UNION ALL SELECT 'component-size', 'warn', id, short, loc || ' lines', row_number() OVER (ORDER BY loc DESC, node_ord) FROM nodes WHERE kind = 'component' AND loc > 120
  UNION ALL SELECT 'function-size', 'info', id, short, loc || ' lines · ' || {_sm('module')}, row_number() OVER (ORDER BY loc DESC, node_ord) FROM nodes WHERE kind IN ('function', 'method') AND loc > 80
  UNION ALL SELECT 'coverage', 'info', n.id, short, callers || ' callers · ' || {_sm('module')}, row_number() OVER (ORDER BY callers DESC, node_ord) FROM nodes n JOIN indeg i ON i.id = n.id WHERE grp IN ('services', 'systems') AND kind IN ('function', 'method') AND NOT tested),
ports0 AS (SELECT module, count(*) AS functions, sum(loc) AS loc, sum(numeric_ops) AS ops, arg_max(short, numeric_ops * 100000000 - node_ord) AS hottest_function FROM nodes GROUP BY 1),
cross0 AS (SELECT e.src AS module, count(*) AS coupling FROM me e JOIN mn b ON b.module = e.dst WHERE b.grp IN ('services', 'systems', 'stores', 'components') GROUP BY 1),
ports AS (SELECT mod_ord, {_sm('m.module')} AS module, m.module AS full_module, m.grp, CAST(functions AS BIGINT) AS functions, CAST(p.loc AS BIGINT) AS loc, CAST(ops AS BIGINT) AS numeric_ops, coalesce(coupling, 0) AS coupling, hottest_function,
  {_round1('CAST(ops AS DOUBLE) * log2(CAST(p.loc AS DOUBLE) + 2) / (1 + coalesce(coupling, 0))')} AS score FROM mn m JOIN ports0 p USING (module) LEFT JOIN cross0 c USING (module) WHERE m.grp NOT IN ('rust', 'dev') AND ops > 0)"""

_REACH = """
reach AS (SELECT id, 0 AS d FROM nodes WHERE tested UNION SELECT e.dst, r.d + 1 FROM reach r JOIN edges e ON e.src = r.id WHERE r.d < 30),
depth AS (SELECT id, CAST(min(d) AS BIGINT) AS test_depth FROM reach GROUP BY 1)"""

_CLOSURE = """
clo AS (SELECT src, dst FROM cm UNION SELECT c.src, e.dst FROM clo c JOIN cm e ON e.src = c.dst),
ring AS (SELECT a.src AS module, min(a.dst) AS component FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
rings AS (SELECT module, component, CAST(count(*) OVER (PARTITION BY component) AS BIGINT) AS size FROM ring),
found AS (SELECT * FROM forbid UNION ALL SELECT * FROM restrict
  UNION ALL SELECT 'warn', 'layers', %(src)s || ' (' || src_group || ') depends on higher layer ' || %(dst)s || ' (' || dst_group || ') — ' || cnt || ' call site(s)', src, NULL FROM viol
  UNION ALL SELECT 'error', 'cycle', 'circular module dependency (' || count(*) || '): ' || string_agg(%(module)s, ' → ' ORDER BY %(module)s) || ' → …', component, NULL FROM rings WHERE size > 1 GROUP BY component
  UNION ALL SELECT 'warn', 'god-module', %(module)s || ' has ' || fns || ' functions (> 80) — consider splitting', module, NULL FROM mn WHERE fns > 80
  UNION ALL SELECT 'warn', 'orphan', %(module)s || '::' || short || ' is never called (dead code?)', module, id FROM lone WHERE NOT contains(short, '.')
  UNION ALL SELECT 'warn', 'adr-coverage', id || ' (' || title || ') is not onboarded into the checks', NULL, NULL FROM uncovered
  UNION ALL SELECT 'warn', 'duplicate', name || ' is defined in ' || n_modules || ' modules (' || shorts || ') — consolidate into one shared util', first_module, first_id FROM dups),
ruled AS (SELECT r.rule, CAST(count(f.rule) AS BIGINT) AS hits, coalesce(bool_or(f.level = 'error'), false) AS has_error FROM (VALUES ('ADR-001'), ('ADR-002'), ('cycle'), ('layers'), ('god-module'), ('orphan'), ('duplicate'), ('adr-coverage')) AS r(rule) LEFT JOIN found f USING (rule) GROUP BY 1)""" % {
    "src": _sm("src"), "dst": _sm("dst"), "module": _sm("module"),
}

_NODE_CLOSURE = """
nclo AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM nclo c JOIN edges e ON e.src = c.dst),
nring AS (SELECT a.src AS id, min(a.dst) AS component FROM nclo a JOIN nclo b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
nrings AS (SELECT id, component, CAST(count(*) OVER (PARTITION BY component) AS BIGINT) AS size FROM nring)"""


def _top(select: str, order: str, limit: int | None, drop: str = "") -> str:
    cut = f" QUALIFY rank <= {limit}" if limit is not None else ""
    body = f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({select}){cut}"
    return f"SELECT * EXCLUDE ({drop}) FROM ({body})" if drop else body


def _names() -> str:
    verbs = ["get", "findAll", "isReady", "toJson", "onClick", "calcDist", "loadById", "Xyz", "setCfg", "fromSrc"]
    camel = f"({verbs}[node_ord % 10 + 1] || upper(substr(split_part(short, '.', 1), 1, 1)) || lower(substr(split_part(short, '.', 1), 2)) || CASE WHEN node_ord % 10 = 6 THEN 'ById' WHEN node_ord % 4 = 0 THEN 'ServiceImpl' ELSE '' END)"
    spaced = _spaced("regexp_replace(camel, '^_+', '')")
    word = _case(names.ABBREVIATIONS, "lower(w)", "w")
    cap = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
    said = _case(names.VERBS, "verb", "NULL")
    path = "('src/lib/' || module || CASE WHEN node_ord % 3 = 0 THEN '.svelte' ELSE '.ts' END)"
    pure = ", ".join(f"'{x}'" for x in names.PREDICATES)
    return f""", w0 AS (SELECT *, {camel} AS camel FROM nodes),
w1 AS (SELECT *, list_transform(list_filter(regexp_split_to_array({spaced}, '\\s+'), lambda w: w <> ''), lambda w: {word}) AS ws, 'function  ' || camel || '(a,' || chr(10) || ' b) ' || CASE WHEN node_ord % 2 = 0 THEN '{{ return 1 }}' ELSE '=> a' END AS srct, {path} AS path FROM w0),
w2 AS (SELECT *, list_transform(ws, lambda w: lower(w)) AS low, lower(ws[1]) AS verb, len(ws) AS n FROM w1),
w3 AS (SELECT *, array_to_string(low[2:], ' ') AS rest, array_to_string(low, ' ') AS full_, list_position(low, 'by') AS pos, {said} AS said FROM w2)
SELECT id, camel, {_humanize('camel')} AS humanized, array_to_string(ws, ' ') AS words,
CASE WHEN verb IN ('get', 'find', 'fetch', 'lookup', 'load') AND pos > 0 AND low[-1] = 'id' THEN 'Look up the ' || coalesce(nullif(array_to_string(low[2:pos - 1], ' '), ''), 'record') || ' with the given id.'
 WHEN verb IN ({pure}) THEN 'Report whether ' || CASE WHEN n > 1 THEN rest ELSE full_ END || '.' WHEN verb = 'to' AND n > 1 THEN 'Convert to ' || rest || '.' WHEN verb = 'from' AND n > 1 THEN 'Build from ' || rest || '.'
 WHEN verb = 'on' AND n > 1 THEN 'Handle the ' || rest || ' event.' WHEN said IS NOT NULL THEN said || CASE WHEN n > 1 THEN ' ' || rest ELSE '' END || '.' ELSE {cap.format('full_')} || '.' END AS auto,
trim(regexp_replace(CASE WHEN node_ord % 2 = 0 THEN split_part(srct, '{{', 1) ELSE split_part(srct, '=>', 1) || '=>' END, '\\s+', ' ', 'g')) AS signature,
module AS module_of, grp AS group_of, {_sm('module')} AS short_module, {_fmt_size('(chars * loc)')} AS size, {_case(names.COLOURS, 'grp', repr(names.OTHER_COLOUR))} AS color, node_ord % 3 <> 0 AS is_source,
module || '::' || short || '@' || line || '#' || node_ord AS made_id FROM w3"""


def oracle_sql(dense: int, middle: int, sparse: int, snapshot: str, now: str) -> dict[str, str]:
    out: dict[str, str] = {}

    def put(name: str, select: str, q: int = dense, more: str = "", recursive: bool = False, before: str = "") -> None:
        out[name] = f"WITH {'RECURSIVE ' if recursive else ''}{before}{_graph(q)},{_DERIVED}{',' + more if more else ''} {select}"

    def fn(name: str, where: str, limit: int, order: str = "in_degree DESC, node_ord") -> None:
        put(name, _top(f"SELECT * FROM rows WHERE {where}", order, limit))

    calls = "SELECT * EXCLUDE (am, bm) FROM cl"
    put("calls", _top(calls, "cnt DESC, edge_ord", 200))
    put("calls_cross", _top(calls + " WHERE cross_module", "cnt DESC, edge_ord", 100))
    put("calls_by_module", _top(calls + " WHERE am = 'lib/components/Brand11' OR bm = 'lib/components/Brand11'", "cnt DESC, edge_ord", 150))
    put("calls_q", _top(calls + " WHERE contains(lower(caller || ' ' || callee || ' ' || from_module || ' ' || to_module), 'ring1')", "cnt DESC, edge_ord", 100))
    put("fn_row", "SELECT * FROM rows")
    put("fn_ref", "SELECT id, name, module, file, line, description FROM rows")
    neighbours = "coalesce((SELECT string_agg(x.short, ',' ORDER BY e.edge_ord) FROM edges e JOIN nodes x ON x.id = e.{far} WHERE e.{near} = n.id), '')"
    put("fn_detail", f"SELECT id, short AS name, {neighbours.format(far='dst', near='src')} AS calls, {neighbours.format(far='src', near='dst')} AS called_by FROM nodes n")
    put("module_summary", "SELECT * FROM ms")
    sides = f"""SELECT src AS module, 'depends_on' AS direction, {_sm('dst')} AS other, cnt AS call_sites, row_number() OVER (PARTITION BY src ORDER BY cnt DESC, medge_ord) AS rank FROM me
      UNION ALL SELECT dst, 'used_by', {_sm('src')}, cnt, row_number() OVER (PARTITION BY dst ORDER BY cnt DESC, medge_ord) FROM me"""
    put("module_detail", f"SELECT * FROM ({sides}) WHERE module = 'lib/utils/Brand13'")
    put("detail_panel", sides)
    put("describe_fn", "SELECT id, description, description_source FROM d")
    put("describe_module", "SELECT module, description FROM md")
    put("describe_view", "SELECT id, coalesce(nullif(c.text, ''), nullif(descr, ''), nullif(doc, ''), nullif(humanized, ''), short) AS description FROM nodes n LEFT JOIN curated c ON c.key = n.module || '::' || n.short")
    put("graph_dump", "SELECT src, dst, cnt FROM edges")
    put("graph_dump_modules", f"SELECT {_sm('src')} AS src, {_sm('dst')} AS dst, cnt FROM me")
    fn("functions_by_module", "module = 'utils/Brand7'", 50)
    fn("functions_q", "contains(lower(name), 'ring') OR contains(lower(description), 'ring')", 50)
    fn("functions_by_kind", "kind = 'method'", 40)
    fn("functions_by_group", "grp = 'services'", 40)
    fn("functions_exported", "exported", 60)
    fn("functions_tested", "tested", 60)
    reach = "SELECT r.id, r.name, dp.test_depth, r.in_degree, r.node_ord FROM rows r LEFT JOIN depth dp USING (id)"
    put("functions_max_test_depth", _top(f"SELECT * FROM ({reach}) WHERE test_depth <= 2", "in_degree DESC, node_ord", 100, "in_degree, node_ord"), more=_REACH, recursive=True)
    put("functions_test_reachable", _top(f"SELECT * FROM ({reach}) WHERE test_depth IS NULL", "in_degree DESC, node_ord", 100, "in_degree, node_ord"), more=_REACH, recursive=True)
    for sort, order in {"indegree": "in_degree", "outdegree": "out_degree", "connected": "(in_degree + out_degree)", "loc": "loc", "chars": "chars"}.items():
        fn(f"functions_sort_{sort}", "true", 100, f"{order} DESC, node_ord")
    # names are of small letters, digits and points, files differ in small letters, digits and points: collated order is that of bytes
    fn("functions_sort_name", "true", 100, "name, node_ord")
    put("files_sort_name", _top("SELECT * FROM fs", "file, file_ord", 200))
    put("calls_sort_name", _top(calls, "caller, edge_ord", 200))
    put("files_filter", _top("SELECT * FROM fs WHERE grp = 'utils' AND contains(lower(file), 'brand1')", "functions DESC, file_ord", 200))
    for sort in ("functions", "loc", "chars"):
        put(f"files_sort_{sort}", _top("SELECT * FROM fs", f"{sort} DESC, file_ord", 200))
    put("file_sizes", "SELECT file, loc, chars FROM fs")
    ref = "SELECT e.edge_ord, r.name, r.module, r.file, r.line, r.description FROM edges e JOIN rows r ON r.id = e.{far} WHERE e.{near} = 'part/17'"
    put("callers", ref.format(far="src", near="dst"))
    put("callees", ref.format(far="dst", near="src"))
    ids = "coalesce((SELECT string_agg(e.{far}, ',' ORDER BY e.edge_ord) FROM edges e WHERE e.{near} = n.id), '')"
    put("client_index", f"SELECT id, {ids.format(far='dst', near='src')} AS callees, {ids.format(far='src', near='dst')} AS callers FROM nodes n")
    ends = "coalesce((SELECT string_agg({far}, ',' ORDER BY medge_ord) FROM me WHERE {near} = m.module), '')"
    put("client_index_modules", f'''SELECT module, {ends.format(far='dst', near='src')} AS "out", {ends.format(far='src', near='dst')} AS "into" FROM mn m''')
    put("neighbour_focus", """SELECT id, bool_or(own) AS own FROM (SELECT id, true AS own FROM nodes WHERE module = 'lib/core/Brand6' UNION ALL SELECT dst, false FROM ee WHERE am = 'lib/core/Brand6'
      UNION ALL SELECT src, false FROM ee WHERE bm = 'lib/core/Brand6') GROUP BY id""")
    put("hidden_groups", "SELECT e.src, e.dst, e.cnt FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.grp NOT IN ('dev', 'stores') AND b.grp NOT IN ('dev', 'stores')")
    tiers = "SELECT id, short, CASE WHEN id = '{q}' THEN 1 WHEN lower(short) = '{q}' THEN 2 WHEN regexp_extract(lower(short), '([^.]*)$', 1) = '{q}' THEN 3 WHEN contains(lower(short), '{q}') THEN 4 END AS tier FROM nodes"
    for name, q in (("resolve_function", "bolt11"), ("resolve_function_part", "olt1")):
        put(name, f"SELECT id, short FROM (SELECT *, min(tier) OVER () AS best FROM ({tiers.format(q=q)})) WHERE tier = best")
    put("resolve_module", f"SELECT module, fns FROM mn WHERE contains(lower(module), 'brand2') ORDER BY CASE WHEN lower(module) = 'brand2' OR lower({_sm('module')}) = 'brand2' OR regexp_extract(lower(module), '([^/]*)$', 1) = 'brand2' THEN 1 ELSE 2 END, mod_ord LIMIT 1")
    score = "CAST(greatest(CASE WHEN lower({n}) = '{q}' THEN 100 WHEN starts_with(lower({n}), '{q}') THEN 70 WHEN contains(lower({n}), '{q}') THEN 45 ELSE 0 END, CASE WHEN lower(description) = '{q}' THEN 60 WHEN starts_with(lower(description), '{q}') THEN 40 WHEN contains(lower(description), '{q}') THEN 25 ELSE 0 END) AS BIGINT) AS score"
    put("search_functions", _top(f"SELECT id, name, score, in_degree, node_ord FROM (SELECT *, {score.format(n='name', q='ring1')} FROM rows) WHERE score > 0", "score DESC, in_degree DESC, node_ord", 20, "node_ord"))
    put("search_modules", _top(f"SELECT full_module, score, function_count, mod_ord FROM (SELECT *, {score.format(n='module', q='utils')} FROM ms) WHERE score > 0", "score DESC, function_count DESC, mod_ord", 20, "mod_ord"))
    typed = f"""SELECT 'modules' AS section, id, label, rank FROM ({_top(f"SELECT * FROM (SELECT module AS id, {_sm('module')} AS label, fns, mod_ord FROM mn) WHERE contains(lower(label), '{{q}}')", "instr(lower(label), '{q}'), fns DESC, mod_ord", 4)})
      UNION ALL SELECT 'functions', id, label, rank FROM ({_top("SELECT id, short AS label, in_degree, node_ord FROM nodes WHERE contains(lower(short), '{q}')", "instr(lower(label), '{q}'), in_degree DESC, node_ord", 10)})"""
    put("typeahead", typed.replace("{q}", "bolt1"))
    put("typeahead_modules", typed.replace("{q}", "nd1"))
    put("hubs_functions", _top("SELECT id, name, in_degree, node_ord FROM rows", "in_degree DESC, node_ord", 15, "node_ord"))
    put("hubs_modules", _top("SELECT full_module, coalesce(u, 0) AS incoming_call_sites, function_count, mod_ord FROM ms LEFT JOIN (SELECT dst, CAST(sum(cnt) AS BIGINT) AS u FROM me GROUP BY 1) ON dst = full_module", "incoming_call_sites DESC, mod_ord", 15, "mod_ord"))
    put("top_functions_of_module", "SELECT module, id, short, line, in_degree, row_number() OVER (PARTITION BY module ORDER BY in_degree DESC, node_ord) AS rank FROM nodes QUALIFY rank <= 12")
    fn_sub, sm_module = f"{_sm('module')} || ' · ' || loc || 'ln · ' || in_degree || '←' || out_degree || '→'", _sm("module")
    lists = {
        "functions": f"SELECT node_ord AS ord, id, short AS label, {fn_sub} AS sub, in_degree AS indegree FROM nodes",
        "calls": f"SELECT edge_ord AS ord, src AS id, ash || ' → ' || bsh AS label, {_sm('am')} || ' → ' || {_sm('bm')} || ' · ' || cnt || '×' AS sub, cnt AS weight FROM ee",
        "files": "SELECT file_ord AS ord, file AS id, regexp_replace(file, '^src/', '') AS label, grp || ' · ' || fns || ' fns · ' || loc || 'ln' AS sub, loc FROM fl JOIN msz USING (module)",
        "modules": f"SELECT mod_ord AS ord, module AS id, {sm_module} AS label, grp || ' · ' || fns || ' fns · ' || loc || 'ln · ' || dep_out || '→ ' || dep_in || '←' AS sub, module AS name FROM mn JOIN msz USING (module)",
    }

    def shown(name: str, kind: str, order: str, where: str = "true") -> None:
        rows = f"SELECT *, row_number() OVER (ORDER BY {order}, ord) AS rank, greatest(count(*) OVER () - 300, 0) AS more FROM ({lists[kind]}) WHERE {where}"
        put(name, f"SELECT rank, id, label, sub, more FROM ({rows}) WHERE rank <= 300")

    for kind, rows in lists.items():
        put("list_rows" if kind == "functions" else f"list_rows_{kind}", f"SELECT id, label, sub FROM ({rows})")
    shown("list_sort", "functions", "indegree DESC")
    shown("list_sort_files", "files", "loc DESC")
    shown("list_sort_modules", "modules", "name")
    shown("list_sort_calls", "calls", "weight DESC")
    shown("list_filter", "functions", "indegree DESC", "contains(lower(label || ' ' || sub), 'rod1')")
    put("hover_split", "SELECT DISTINCT dst AS id, 'out' AS direction FROM edges WHERE src = 'part/17' UNION ALL SELECT DISTINCT src, 'in' FROM edges WHERE dst = 'part/17'")
    put("node_marks", "SELECT id, 'vscode://file//w/' || file || ':' || line AS link, CASE WHEN kind NOT IN ('function', 'method') THEN '#3a4453' WHEN tested THEN '#7ee787' ELSE '#ff6b6b' END AS color FROM nodes")
    wrap = "list_reduce(string_split(description, ' '), lambda a, w: CASE WHEN length(regexp_extract(a, '[^' || chr(10) || ']*$')) + 1 + length(w) > 18 THEN a || chr(10) || w ELSE a || ' ' || w END)"
    put("word_wrap", f"SELECT id, CASE WHEN length(description) <= 18 THEN description ELSE {wrap} END AS lines FROM d")
    put("edge_counts", "SELECT src, dst, cnt FROM edges")
    put("module_edges", "SELECT src, dst, cnt FROM me")
    put("module_nodes", "SELECT module, grp, file, fns FROM mn")
    put("degrees", "SELECT id, in_degree, out_degree FROM nodes")
    put("degrees_weighted", "SELECT id, coalesce((SELECT CAST(sum(cnt) AS BIGINT) FROM edges WHERE dst = n.id), 0) AS in_degree, coalesce((SELECT CAST(sum(cnt) AS BIGINT) FROM edges WHERE src = n.id), 0) AS out_degree FROM nodes n")
    put("module_sizes", "SELECT module, loc, chars, dep_out, dep_in FROM msz")
    put("file_list", "SELECT file, module, grp, fns FROM fl")
    put("stats", "SELECT (SELECT count(*) FROM fl) AS files, (SELECT count(*) FROM nodes) AS functions, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM mn) AS modules")
    put("module_coverage", """SELECT module, coalesce(t, 0) AS tested, coalesce(n, 0) AS total, CASE WHEN n IS NULL THEN '#3a4453' WHEN t / n > 0.66 THEN '#7ee787' WHEN t / n > 0.2 THEN '#f5a623' ELSE '#ff6b6b' END AS color
      FROM mn LEFT JOIN (SELECT module, count(*) FILTER (tested) AS t, count(*) AS n FROM nodes WHERE kind IN ('function', 'method') GROUP BY 1) USING (module)""")
    put("group_census", "SELECT grp, count(*) AS n FROM nodes GROUP BY 1")
    put("port_candidates", _top("SELECT * FROM ports", "score DESC, mod_ord", 15))
    put("duplicates", "SELECT name, n_modules, n_nodes, modules, first_id FROM dups")
    put("orphan_indegree", "SELECT * FROM indeg")
    put("layer_violations", "SELECT * FROM viol")
    put("layer_join", "SELECT src_group, dst_group, CAST(sum(cnt) AS BIGINT) AS cnt FROM viol GROUP BY 1, 2")
    put("scc_cycles", "SELECT * FROM rings WHERE size > 1", sparse, _CLOSURE, True)
    put("scc_cycles_dense", "SELECT * FROM rings WHERE size > 1", dense, _CLOSURE, True)
    put("run_checks_dense", "SELECT level, rule, msg, id FROM found", dense, _CLOSURE, True)
    put("scc_cycles_nodes", "SELECT * FROM nrings WHERE size > 1", middle, _NODE_CLOSURE, True)
    put("god_modules", "SELECT module, fns FROM mn WHERE fns > 80")
    put("orphans_check", "SELECT id, short, module FROM lone WHERE NOT contains(short, '.')")
    put("orphans_list", "SELECT id, short, module FROM lone")
    put("duplicate_findings", "SELECT level, rule, msg, module, id FROM found WHERE rule = 'duplicate'", dense, _CLOSURE, True)
    put("adr_coverage", "SELECT * FROM uncovered")
    put("forbidden_module", "SELECT * FROM forbid")
    put("restricted_callee", "SELECT * FROM restrict")
    put("run_checks", "SELECT level, rule, msg, id FROM found", sparse, _CLOSURE, True)
    put("findings_by_rule", "SELECT * FROM ruled", sparse, _CLOSURE, True)
    put("finding_totals", "SELECT count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level <> 'error') AS warnings FROM found", sparse, _CLOSURE, True)
    for key, rec in (("rec_runes", "runes"), ("rec_component_size", "component-size"), ("rec_function_size", "function-size"), ("rec_coverage", "coverage")):
        put(key, f"SELECT id, label, sub, rank FROM recs WHERE rec_id = '{rec}'")
    put("recommendation_order", "SELECT rec_id, severity, count(*) AS n, row_number() OVER (ORDER BY CASE severity WHEN 'warn' THEN 1 ELSE 2 END, count(*) DESC, rec_id) AS rank FROM recs GROUP BY 1, 2")
    put("test_depth", "SELECT n.id, test_depth FROM nodes n LEFT JOIN depth USING (id)", more=_REACH, recursive=True)
    put("test_reach_histogram", "SELECT test_depth, count(*) AS n FROM nodes LEFT JOIN depth USING (id) GROUP BY 1", more=_REACH, recursive=True)
    walk = """
bfs AS (SELECT 'part/3' AS id, 0 AS d UNION SELECT e.dst, b.d + 1 FROM bfs b JOIN edges e ON e.src = b.id WHERE b.d < 12), lev AS (SELECT id, min(d) AS d FROM bfs GROUP BY 1),
trail AS (SELECT 'part/3' AS id, 0 AS d, CAST([] AS BIGINT[]) AS path UNION ALL SELECT e.dst, t.d + 1, list_append(t.path, e.edge_ord) FROM trail t JOIN edges e ON e.src = t.id JOIN lev l ON l.id = e.dst AND l.d = t.d + 1
  WHERE t.d < (SELECT d FROM lev WHERE id = 'part/150')),
best AS (SELECT min(path) AS path FROM trail WHERE id = 'part/150'), steps AS (SELECT unnest(path) AS edge_ord, generate_subscripts(path, 1) AS hop FROM best)"""
    put("shortest_path", "SELECT hop, x.id, short AS name FROM (SELECT CAST(hop AS BIGINT) AS hop, dst AS id FROM steps JOIN edges USING (edge_ord) UNION ALL SELECT 0, 'part/3' FROM best WHERE path IS NOT NULL) x JOIN nodes n ON n.id = x.id", more=walk, recursive=True)
    spot = "CAST(round(greatest(40.0, 4 * sqrt(N)) * {f}(2 * pi() * (i / N)) * 1000) AS BIGINT)"
    put("layout_seed", f"SELECT id, label, {spot.format(f='cos')} AS x, {spot.format(f='sin')} AS y, CAST(round((2 + 1.4 * sqrt(in_degree)) * 1000) AS BIGINT) AS size, {_case(names.COLOURS, 'grp', repr(names.OTHER_COLOUR))} AS color, grp FROM (SELECT *, short AS label, CAST(row_number() OVER (ORDER BY node_ord) - 1 AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS N FROM nodes)")
    put("force_layout", "SELECT count(*) AS n_nodes, count(*) AS n_placed, true AS nearer FROM nodes")
    put("layout_edges", "SELECT src, dst, cnt AS weight, least(1 + CAST(cnt AS DOUBLE) / 4, 6.0::DOUBLE) AS size FROM me")
    titled = " UNION ALL ".join(f"SELECT '{k}' AS rec_id, '{t.format(n='%n', core='%core', component_lines=120, function_lines=80)}' AS t, '{why}' AS why" for k, (t, why) in rules.TITLES.items())
    core = "(SELECT count(*) FROM nodes WHERE grp IN ('services', 'systems') AND kind IN ('function', 'method') AND id IN (SELECT dst FROM edges))"
    more = f""" titles0 AS ({titled}), counted AS (SELECT rec_id, severity, count(*) AS n, row_number() OVER (ORDER BY CASE severity WHEN 'warn' THEN 1 ELSE 2 END, count(*) DESC, rec_id) AS rec_rank FROM recs GROUP BY 1, 2),
      titles AS (SELECT rec_id, severity, n, rec_rank, replace(replace(t, '%n', CAST(n AS VARCHAR)), '%core', CAST({core} AS VARCHAR)) AS title, why FROM counted JOIN titles0 USING (rec_id))"""
    irows = f""", irows AS (SELECT 'check' AS section, CASE WHEN r.has_error THEN 'error' WHEN r.hits > 0 THEN 'warn' ELSE 'info' END AS sev, r.rule AS title, NULL AS why, f.msg AS label, CASE WHEN f.msg IS NULL THEN NULL ELSE coalesce(n.file || ':' || n.line, '') END AS sub FROM ruled r LEFT JOIN found f USING (rule) LEFT JOIN nodes n ON n.id = f.id
      UNION ALL SELECT 'rec', severity, title, why, label, sub FROM recs JOIN titles USING (rec_id, severity)
      UNION ALL SELECT 'ports', 'info', 'TS→Rust port candidates', 'score = compute ÷ coupling', module, 'score ' || format('{{:.1f}}', score) || ' · ' || numeric_ops || ' numeric · ' || loc || ' loc · coupling ' || coupling FROM (SELECT * FROM ports ORDER BY score DESC, mod_ord LIMIT 15)
      UNION ALL SELECT 'orphans', 'info', 'Dead-code candidates', NULL, short, module || ' · ' || file || ':' || line FROM lone),
      igroups AS (SELECT section, sev, title, why, count(label) AS n, CASE WHEN section = 'check' AND count(label) = 0 THEN '✓' ELSE CAST(count(label) AS VARCHAR) END AS badge FROM irows GROUP BY section, sev, title, why)"""
    put("recommendation_titles", "SELECT rec_id, title, rec_rank FROM titles", more=more)
    panel = f"{_CLOSURE},{more}{irows}"
    put("insight_groups", "SELECT section, sev, title, n, badge FROM igroups", sparse, panel, True)
    put("insight_filter", "SELECT section, title, label, sub FROM irows WHERE label IS NOT NULL AND contains(lower(label || ' ' || coalesce(sub, '')), 'ring1')", sparse, panel, True)
    put("insight_shown", "SELECT title, label, rank, greatest(n - 40, 0) AS more FROM recs JOIN titles USING (rec_id, severity) WHERE rank <= 40", sparse, panel, True)
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"check": "Architecture checks", "rec": "Recommendations", "ports": "Port candidates", "orphans": "Dead code"}.items())
    put("insight_lines", f"""SELECT DISTINCT chr(10) || '== ' || CASE section {labels} END || ' ==' AS line FROM igroups UNION ALL SELECT chr(10) || '[' || badge || '] ' || title || coalesce(chr(10) || '  (' || why || ')', '') FROM igroups
      UNION ALL SELECT '  - ' || label || CASE WHEN coalesce(sub, '') <> '' THEN '  (' || sub || ')' ELSE '' END FROM irows WHERE label IS NOT NULL""", sparse, panel, True)
    put("check_lines", """SELECT rule_no, 0 AS line_no, '  ' || CASE WHEN has_error THEN '✗' WHEN hits > 0 THEN '!' ELSE '✓' END || ' ' || rule || CASE WHEN hits > 0 THEN ' (' || hits || ')' ELSE '' END AS line FROM numbered
      UNION ALL SELECT rule_no, 26, '      … +' || (hits - 25) || ' more' FROM numbered WHERE hits > 25
      UNION ALL SELECT rule_no, nth, '      • ' || msg || coalesce(' — ' || file || ':' || line, '') FROM (SELECT o.rule_no, f.msg, n.file, n.line, row_number() OVER (PARTITION BY f.rule ORDER BY coalesce(f.module, ''), coalesce(f.id, ''), f.msg) AS nth FROM found f JOIN numbered o USING (rule) LEFT JOIN nodes n ON n.id = f.id) WHERE nth <= 25""",
        sparse, _CLOSURE + ", numbered AS (SELECT rule, hits, has_error, CAST(list_position(['ADR-001', 'ADR-002', 'cycle', 'layers', 'god-module', 'orphan', 'duplicate', 'adr-coverage'], rule) - 1 AS BIGINT) AS rule_no FROM ruled)", True)
    nl = "chr(10)"
    refs = "coalesce((SELECT string_agg({nl} || '- ' || x.name || ' (' || x.module || ') — ' || x.description, '' ORDER BY e.edge_ord) FROM edges e JOIN rows x ON x.id = e.{far} WHERE e.{near} = r.id), '')"
    n_of = "(SELECT count(*) FROM edges e WHERE e.{near} = r.id)"
    side = lambda title, far, near: f"{nl} || {nl} || '## {title} (' || {n_of.format(near=near)} || ')' || {refs.format(nl=nl, far=far, near=near)}"
    put("markdown_render", f"""SELECT id, '# ' || name || '  (' || module || ')' || {nl} || {nl} || description || {nl} || {nl} || '- **kind**: ' || kind || CASE WHEN exported THEN ' · exported' ELSE '' END || '  ·  **source**: ' || file || ':' || line
      || '  ·  **desc from**: ' || description_source || {nl} || '- **signature**: `' || (SELECT short FROM nodes n WHERE n.id = r.id) || '()`' || {side('Calls', 'dst', 'src')} || {side('Called by', 'src', 'dst')} AS markdown FROM rows r""")
    deps = "coalesce((SELECT string_agg({nl} || '- ' || {other} || ' (' || cnt || ')', '' ORDER BY cnt DESC, medge_ord) FROM me WHERE {near} = m.full_module), '')"
    mside = lambda title, far, near: f"{nl} || {nl} || '## {title} (' || (SELECT count(*) FROM me WHERE {near} = m.full_module) || ')' || {deps.format(nl=nl, other=_sm(far), near=near)}"
    put("markdown_modules", f"""SELECT full_module AS module, '# ' || module || '  (' || grp || ')' || {nl} || {nl} || description || {nl} || {nl} || 'Source: ' || file || ' · ' || function_count || ' functions' || {mside('Depends on', 'dst', 'src')} || {mside('Used by', 'src', 'dst')}
      || {nl} || {nl} || '## Functions' || (SELECT string_agg({nl} || '- ' || short || ' — ' || coalesce(description, ''), '' ORDER BY in_degree DESC, node_ord) FROM d WHERE d.module = m.full_module) AS markdown FROM ms m""")
    old = _graph(dense, snapshot, "o_", "node_ord % 29 <> 7 AND module <> 'lib/utils/Brand19'") + ","
    put("diff_modules", "SELECT coalesce(b.module, c.module) AS module, CASE WHEN b.module IS NULL THEN 'added' ELSE 'removed' END AS change, coalesce(c.fns, b.fns) AS fns FROM o_mn b FULL JOIN mn c ON b.module = c.module WHERE b.module IS NULL OR c.module IS NULL", before=old)
    sized = "SELECT module, b.fns AS was, c.fns AS now, abs(c.fns - b.fns) AS delta, c.fns > 80 AND b.fns <= 80 AS now_god FROM o_mn b JOIN mn c USING (module) WHERE b.fns <> c.fns"
    put("diff_sizes", sized, before=old)
    put("diff_order", _top(f"SELECT module, delta FROM ({sized})", "delta DESC, module", 30), before=old)
    deps = "SELECT *, 'new' AS change FROM (SELECT src, dst FROM me EXCEPT SELECT src, dst FROM o_me) UNION ALL SELECT *, 'gone' FROM (SELECT src, dst FROM o_me EXCEPT SELECT src, dst FROM me)"
    put("diff_deps", deps, before=old)
    put("changed_deps", f"SELECT change, count(*) AS n FROM ({deps}) GROUP BY 1", before=old)
    total = " UNION ALL ".join(f"SELECT '{w}' AS what, (SELECT count(*) FROM o_{t}) AS was, (SELECT count(*) FROM {t}) AS now" for w, t in (("functions", "nodes"), ("edges", "edges"), ("modules", "mn")))
    short = _sm("module")
    put("diff_lines", f"""SELECT 'totals' AS section, row_number() OVER (ORDER BY what) AS rank, what || ' ' || was || ' → ' || now || ' (' || CASE WHEN now >= was THEN '+' ELSE '' END || (now - was) || ')' AS line FROM ({total})
      UNION ALL SELECT 'modules', row_number() OVER (ORDER BY CASE WHEN change = 'added' THEN 0 ELSE 1 END, module), CASE WHEN change = 'added' THEN '+ ' ELSE '- ' END || {short} || CASE WHEN change = 'added' THEN ' (' ELSE ' (was ' END || fns || ' fns)'
        FROM (SELECT coalesce(b.module, c.module) AS module, CASE WHEN b.module IS NULL THEN 'added' ELSE 'removed' END AS change, coalesce(c.fns, b.fns) AS fns FROM o_mn b FULL JOIN mn c ON b.module = c.module WHERE b.module IS NULL OR c.module IS NULL)
      UNION ALL SELECT 'sizes', row_number() OVER (ORDER BY delta DESC, module), CASE WHEN now > was THEN '▲ ' ELSE '▼ ' END || {short} || ' ' || was || ' → ' || now || ' fns' || CASE WHEN now_god THEN '  ⚠ now a god-module (>80)' ELSE '' END FROM ({sized})
      UNION ALL SELECT change || ' dependencies', row_number() OVER (PARTITION BY change ORDER BY src, dst) AS r, CASE WHEN change = 'new' THEN '+ ' ELSE '- ' END || {_sm('src')} || ' → ' || {_sm('dst')} FROM ({deps}) QUALIFY row_number() OVER (PARTITION BY change ORDER BY src, dst) <= 30""", before=old)
    put("diff_totals", "SELECT what, was, now, CASE WHEN now >= was THEN '+' ELSE '' END || (now - was) AS delta FROM (" + " UNION ALL ".join(f"SELECT '{w}' AS what, (SELECT count(*) FROM o_{t}) AS was, (SELECT count(*) FROM {t}) AS now" for w, t in (("functions", "nodes"), ("edges", "edges"), ("modules", "mn"))) + ")", before=old)
    put("union_edges", "SELECT src, dst, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT src, dst, cnt FROM edges UNION ALL SELECT src, dst, cnt FROM s_edges) GROUP BY 1, 2", before=_graph(sparse, None, "s_") + ",")
    put("union_nodes", """SELECT id, CASE WHEN node_ord % 3 = 0 THEN short || '_b' ELSE short END AS short, CASE WHEN node_ord % 3 = 0 THEN loc * 10 ELSE loc END AS loc, 0::BIGINT AS source FROM nodes
      UNION ALL SELECT id || '/rs', short, loc, 2 FROM nodes WHERE node_ord % 7 = 0""")
    put("names", _names())
    out["names"] = out["names"].replace(" , w0 AS", ", w0 AS")
    paths = "pg AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, html FROM pages)"
    out["page_links"] = f"""WITH {paths}, files AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS base, page_id AS target FROM pg),
      sites AS (SELECT * FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/?([^"]*)"', 1)) AS link FROM pg UNION ALL SELECT page_id, regexp_extract(path, '([^/]*)$', 1) FROM pg) WHERE link <> ''),
      hits AS (SELECT s.page_id, s.link, f.target, min(CASE WHEN f.base = s.link THEN 1 ELSE 2 END) AS tier, count(*) AS n FROM sites s JOIN files f ON f.base = s.link OR f.base = s.link || '.html' GROUP BY 1, 2, 3)
      SELECT page_id AS src, target AS dst, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT *, min(tier) OVER (PARTITION BY page_id, link) AS best FROM hits) WHERE tier = best AND page_id <> target GROUP BY 1, 2"""
    out["scan_svelte"] = r"SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1), chr(10)) AS script FROM pages"
    unit, script, conf = names.UNIT_FILE, names.SCRIPT_FILE, names.CONFIG_FILE
    known = "s AS (SELECT a.s_suppkey AS k, a.s_nationkey AS n, a.s_suppkey * 7 % 25 AS m, b.s_suppkey AS after FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)"
    out["extract_declarations"] = f"""WITH {known}, d(name, kind, cls, exported, line, loc, numeric_ops) AS (VALUES ('twice{{}}', 'function', false, true, 4, 1, 1), ('own{{}}', 'function', false, true, 5, 3, 3), ('Box{{}}.get v', 'accessor', true, false, 10, 1, 1),
        ('Box{{}}.set v', 'accessor', true, false, 11, 1, 0), ('Box{{}}.run', 'method', true, false, 12, 1, 0), ('Box{{}}.step', 'method', true, false, 13, 1, 2), ('table{{}}.b', 'function', false, false, 15, 1, 0), ('pick{{}}', 'function', false, true, 16, 5, 1), ('held{{}}', 'store', false, true, 21, 1, 1), ('bump{{}}', 'function', false, true, 22, 1, 1))
      SELECT replace(name, '{{}}', CAST(k AS VARCHAR)) AS name, 'services/s' || k AS module, 'services' AS grp, kind, CASE WHEN cls THEN 'Box' || k END AS class_name, exported, CAST(line AS BIGINT) AS line, CAST(loc AS BIGINT) AS loc, CAST(numeric_ops AS BIGINT) AS numeric_ops, name = 'own{{}}' AS module_used FROM s, d
      UNION ALL SELECT 'hub' || n_nationkey, 'core/n' || n_nationkey, 'core', 'function', NULL, true, 1, 3, 0, false FROM nation"""
    out["extract_edges"] = f"""WITH {known}, e(caller, callee) AS (VALUES ('twice{{}}', 'hub<n>'), ('own{{}}', 'twice{{}}'), ('own{{}}', 'hub<m>'), ('Box{{}}.set v', 'own{{}}'), ('Box{{}}.run', 'Box{{}}.step'), ('Box{{}}.step', 'own<after>'), ('table{{}}.b', 'own{{}}'), ('pick{{}}', 'twice{{}}'), ('pick{{}}', 'table{{}}.b'), ('bump{{}}', 'held{{}}'))
      SELECT replace(caller, '{{}}', CAST(k AS VARCHAR)) AS caller, replace(replace(replace(replace(callee, '{{}}', CAST(k AS VARCHAR)), '<n>', CAST(n AS VARCHAR)), '<m>', CAST(m AS VARCHAR)), '<after>', coalesce(CAST(after AS VARCHAR), '')) AS callee, CAST(1 AS BIGINT) AS cnt
      FROM s, e WHERE callee <> 'own<after>' OR after IS NOT NULL"""
    out["page_files"] = f"""WITH {paths}, f AS (SELECT page_id, html, regexp_extract(path, '^([^/]*)', 1) AS dir0, ['/.docs/', '/scripts/', '/node_modules/', '/x/'][page_id % 4 + 1] AS folder, ['.md', '.service', '.json', '.sh', '.bin', '.mdx', ''][page_id % 7 + 1] AS ext FROM pg),
      g AS (SELECT *, dir0 || folder || 'f' || page_id || ext AS path, 'f' || page_id || ext AS base, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM f)
      SELECT page_id, path, CASE WHEN regexp_matches(base, '{unit}') THEN 'systemd' WHEN ext IN ('.md', '.mdx') THEN CASE WHEN folder = '/.docs/' THEN 'docs' ELSE 'notes' END
        WHEN regexp_matches(base, '{script}') OR folder = '/scripts/' THEN 'scripts' WHEN regexp_matches(base, '{conf}') THEN 'config' ELSE 'other' END AS category,
        folder = '/node_modules/' OR regexp_matches(path, '(^|/).*/f1[^/]\\.[^/]*($|/)') AS ignored, ext IN ('.md', '.json') OR regexp_matches(base, '{unit}') OR regexp_matches(base, '(^|/)f2[^/]*($|/)') AS kept,
        dir0 || rtrim(folder, '/') AS dir, base, {_fmt_size('n')} AS size FROM g"""
    stale = f"SELECT user_id, CAST(floor((epoch_ms(TIMESTAMP '{now}') - epoch_ms(max(ts))) / 86400000) AS BIGINT) AS days FROM events GROUP BY 1"
    out["stale_days"] = f"SELECT *, days >= 17 AS stale FROM ({stale})"
    out["stale_count"] = f"SELECT count(*) FILTER (days >= 17) AS n_stale, count(*) AS n FROM ({stale})"
    out["is_stale"] = """WITH c AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN max(ts) END AS mtime, 'src/u' || user_id || CASE WHEN user_id % 2 = 0 THEN '.ts' ELSE '.md' END AS path FROM events GROUP BY user_id)
      SELECT path, mtime FROM c WHERE (path LIKE '%.ts' OR path IN (SELECT 'src/u' || user_id || '.md' FROM events WHERE user_id % 3 = 0)) AND (mtime IS NULL OR mtime > TIMESTAMP '2024-01-30 12:00:00')"""
    meta = """SELECT n_name, n_nationkey % 7 = 6 AS fs, n_nationkey % 5 <> 4 AS has_git, n_nationkey % 11 <> 10 AS has_graph, n_nationkey % 6 <> 5 AS stamped, n_nationkey % 4 = 3 AS moved, n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 AS cleaned, files FROM nation, (VALUES (true), (false)) AS f(files)"""
    out["stale_decision"] = f"""SELECT n_name, files, reason, reason IN ('commit', 'cleaned', 'files') AS stale FROM (SELECT n_name, files, CASE WHEN fs THEN 'filesystem' WHEN NOT has_git THEN 'no git' WHEN NOT has_graph THEN 'no graph' WHEN NOT stamped THEN 'no stamp'
      WHEN moved THEN 'commit' WHEN cleaned THEN 'cleaned' WHEN files AND (SELECT count(*) FROM ({out["is_stale"]})) > 0 THEN 'files' ELSE 'fresh' END AS reason FROM ({meta}))"""
    out["porcelain_paths"] = """SELECT CASE user_id % 4 WHEN 0 THEN 'src/u' || user_id || '.ts' WHEN 1 THEN 'src/u' || user_id || 'b.ts' ELSE 'src/u' || user_id || ' x.md' END AS path FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 < 3"""
    label = "WITH g AS (SELECT 'g' || c_custkey AS name, 'host' || c_nationkey AS host, c_custkey AS k, c_nationkey AS n, c_custkey % 15 = 0 AS fs FROM customer), reg AS (SELECT DISTINCT 'm' || n AS machine, CASE WHEN n % 2 = 0 THEN host END AS ts_host FROM g WHERE fs), names AS (SELECT host, min(machine) AS label FROM (SELECT ts_host AS host, machine FROM reg WHERE ts_host IS NOT NULL UNION SELECT machine, machine FROM reg) GROUP BY 1)"
    machines = f"""{label}, placed AS (SELECT g.*, CASE WHEN fs THEN 'm' || n ELSE coalesce(label, g.host) END AS machine FROM g LEFT JOIN names USING (host)),
      m AS (SELECT machine, max(name) FILTER (fs) AS all_graph, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT fs), '') AS projects, max(CASE WHEN fs AND n % 2 = 0 THEN host END) AS ts_host, max('day ' || k) FILTER (fs) AS indexed_at FROM placed GROUP BY 1),
      up AS (SELECT 'host' || n_nationkey AS host FROM nation WHERE n_regionkey < 2),
      shown AS (SELECT *, CASE WHEN machine = (SELECT coalesce(max(label), 'host3') FROM names WHERE host = 'host3') THEN 'online' WHEN ts_host IS NOT NULL THEN CASE WHEN ts_host IN (SELECT host FROM up) THEN 'online' ELSE 'cached' END WHEN all_graph IS NOT NULL THEN 'cached' ELSE 'offline' END AS status FROM m)"""
    out["machines"] = f"{machines} SELECT * FROM shown"
    out["machine_of"] = f"{machines} SELECT coalesce((SELECT machine FROM placed WHERE name = 'g7'), (SELECT min(machine) FROM shown)) AS machine"
    out["machine_of_none"] = f"{machines} SELECT min(machine) AS machine FROM shown"
    out["online_ratio"] = f"{machines} SELECT count(*) FILTER (status = 'online') AS online, count(*) AS total FROM shown"
    note = "'## ADR-' || k || ' (kept): Keep f' || k || chr(10) || '# ADR-9: no' || chr(10) || 'see [[f' || (k + 7) || ']] and [[f' || (k + 5) || '|that one]] [[f' || (k + 1) || '.service#a]] [x](../x/f' || (k + 84) || '.md#top) [y](./f' || (k + 12) || '.mdx)' || chr(10) || '  $: a = 1;' || chr(10) || '$: b' || chr(10)"
    units = "'[Unit]' || chr(10) || 'After=f' || (k + 7) || '.service  f' || (k + 14) || '.service,f' || (k + 1) || '.json' || chr(10) || 'wants = f' || (k + 7) || '.service' || chr(10) || 'Description=f' || (k + 2) || '.service' || chr(10)"
    tree = f"""WITH t0 AS (SELECT page_id AS k, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages),
      tree AS (SELECT k, size, 'h' || k % 3 || ['/.docs/', '/scripts/', '/node_modules/', '/x/'][k % 4 + 1] AS folder, ['.md', '.service', '.json', '.sh', '.bin', '.mdx', ''][k % 7 + 1] AS ext, make_timestamp((1704067200 + (k % 60) * 86400 - 3600) * 1000000) AS mtime,
        CASE WHEN k % 7 IN (0, 5) THEN {note} WHEN k % 7 = 1 THEN {units} ELSE '' END AS text FROM t0),
      files AS (SELECT *, folder || 'f' || k || ext AS path, 'f' || k || ext AS base, CASE WHEN ext = '.service' THEN 'systemd' WHEN ext IN ('.md', '.mdx') THEN CASE WHEN k % 4 = 0 THEN 'docs' ELSE 'notes' END WHEN ext = '.sh' OR k % 4 = 1 THEN 'scripts' WHEN ext = '.json' THEN 'config' ELSE 'other' END AS kind,
        regexp_extract_all(text, '{names.WIKI_LINK}', 1) AS wikis, regexp_extract_all(text, '{names.MD_LINK}', 1) AS mds, list_filter(flatten(list_transform(regexp_extract_all(text, '{names.UNIT_LINK}', 1), lambda x: regexp_split_to_array(x, '[\\s,]+'))), lambda u: u <> '') AS units FROM tree),
      w0 AS (SELECT path, unnest(wikis) AS name, generate_subscripts(wikis, 1) AS pos FROM files WHERE kind IN ('docs', 'notes')),
      w1 AS (SELECT w.path, w.pos, f.path AS dst, CASE WHEN f.base = trim(name) THEN 0 WHEN f.base = trim(name) || '.md' THEN 1 ELSE 2 END AS tier FROM w0 w JOIN files f ON f.base IN (trim(name), trim(name) || '.md', trim(name) || '.mdx')),
      wiki AS (SELECT path, dst FROM w1 QUALIFY tier = min(tier) OVER (PARTITION BY path, pos)),
      md AS (SELECT m.path, f.path AS dst FROM (SELECT path, k, unnest(mds) AS href FROM files WHERE kind IN ('docs', 'notes')) m JOIN files f ON f.path = CASE WHEN starts_with(href, '../x/') THEN 'h' || m.k % 3 || '/x/' || substr(href, 6) ELSE regexp_replace(m.path, '[^/]*$', '') || substr(href, 3) END),
      unit AS (SELECT u.path, f.path AS dst FROM (SELECT path, unnest(units) AS name FROM files WHERE kind = 'systemd') u JOIN files f ON f.base = u.name),
      linked AS (SELECT path AS src, dst, count(*) AS cnt FROM (SELECT * FROM wiki UNION ALL SELECT * FROM md UNION ALL SELECT * FROM unit) WHERE path <> dst GROUP BY 1, 2)"""
    out["wikilink_join"], out["mdlink_join"], out["unit_dep_join"] = (f"{tree} SELECT path, dst FROM {x}" for x in ("wiki", "md", "unit"))
    out["extract_links"] = f"{tree} SELECT path, array_to_string(wikis, '|') AS wiki, array_to_string(mds, '|') AS md, array_to_string(units, '|') AS units FROM files"
    out["fs_edges"] = f"{tree} SELECT src, dst, cnt FROM linked"
    age = f"CAST(floor((epoch_ms(TIMESTAMP '{now}') - epoch_ms(mtime)) / 86400000) AS BIGINT)"
    out["fs_nodes"] = f"""{tree} SELECT path AS id, rtrim(folder, '/') AS module, kind AS grp, {_fmt_size('size')} || ' · ' || {age} || 'd since edit' AS descr, size AS loc, {age} AS stale_days, {age} >= 40 AS stale,
      coalesce((SELECT CAST(sum(cnt) AS BIGINT) FROM linked WHERE dst = path), 0) AS in_degree, coalesce((SELECT CAST(sum(cnt) AS BIGINT) FROM linked WHERE src = path), 0) AS out_degree, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS node_ord FROM files"""
    out["fs_walk"] = f"{tree} SELECT path FROM files WHERE k % 4 <> 2 AND NOT regexp_matches(base, '^f1[^/]\\..*$') AND (ext IN ('.md', '.service') OR ext = '.json' OR starts_with(base, 'f2'))"
    out["adr_scan"] = f"{tree} SELECT path, 'ADR-' || k AS id, 'Keep f' || k AS title FROM files WHERE kind IN ('docs', 'notes')"
    out["legacy_reactive"] = f"{tree} SELECT path, len(regexp_extract_all(text, '(?m)^\\s*\\$:')) AS n FROM files"
    out["debounce_sessions"] = """SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM
      (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst"""
    return out
