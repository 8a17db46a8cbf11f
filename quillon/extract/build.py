"""From files to a graph: scanners run per file on the executors, names are resolved by joins.

Resolution is syntactic. It follows imports, scopes and names, not types: a call of a method resolves to the method of
that name that is imported, local or, failing these, unique.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Config, Project, tsconfig
from ..functions import names
from ..graph import Graph, with_degrees
from ..operators import paths, rollups
from ..shared import global_index, local_part, reach_workers
from . import scan


def read_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".ts", ".svelte", ".rs"), most_bytes: int | None = None) -> DataFrame:
    """path (relative to ``root``), text of all files with the suffixes; larger ones are left unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if most_bytes is not None:
        files = files.filter(F.col("length") <= most_bytes)
    base = local_part(root)
    path = F.substring_index("path", base, -1)
    files = files.filter(F.col("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return files.filter(~F.col("path").rlike(r"/(node_modules|target|\.[^/]+)/")).select(path.alias("path"), F.decode("content", "UTF-8").alias("text"))


def crates(spark: SparkSession, root: str) -> DataFrame:
    """Folders below ``root`` with a Cargo.toml and Rust sources."""
    base = local_part(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring_index("path", base, -1).alias("path"))
    found = found.filter("NOT path RLIKE '(^|/)(node_modules|target)(/|$)'")
    with_manifest = found.filter("path RLIKE '^[^/.][^/]*/Cargo[.]toml$'").select(F.split("path", "/")[0].alias("crate"))
    with_sources = found.filter("path RLIKE '^[^/]+/src/.*[.]rs$'").select(F.split("path", "/")[0].alias("crate")).distinct()
    return with_manifest.join(with_sources, "crate", "left_semi")


def crate_warnings(present: DataFrame, configured: list[str]) -> DataFrame:
    """crate, problem: configured ones that are missing, present ones that aren't listed."""
    listed = present.sparkSession.createDataFrame([(c,) for c in configured], "crate string")
    missing = listed.join(present, "crate", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(present.join(listed, "crate", "left_anti").withColumn("problem", F.lit("unlisted")))


def _facts(files: DataFrame, config: Config, aliases: Mapping[str, str], rust_crates: tuple[str, ...]) -> dict[str, DataFrame]:
    """Everything the scanners find in one pass over the texts, a table a kind."""
    known, prefix = dict(aliases), config.namespace_prefix
    kinds = [f.name for f in StructType.fromDDL(scan.FACTS)]
    schema = to_arrow_schema(StructType.fromDDL(scan.FACTS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in scan.facts(p, t or "", known, rust_crates, prefix)]
            yield pa.record_batch([pa.array([row if kind == k else None for kind, row in found], schema.field(k).type) for k in kinds], schema=schema)

    reach_workers(files.sparkSession)
    # dealt out in the scan's own stage: how a reader packs small files into tasks doesn't matter then
    texts = files.select("path", "text").repartition(3 * files.sparkSession.sparkContext.defaultParallelism, "path")
    found = paths.checkpointed(texts.mapInArrow(rows, scan.FACTS))
    return {k: found.filter(F.col(k).isNotNull()).select(f"{k}.*") for k in kinds}


def module_places(files: DataFrame) -> DataFrame:
    """place, m: the module that each path without suffix means; of a file and a folder's index the file."""
    bare = F.regexp_replace("path", r"\.ts$", "")
    found = files.filter(F.col("path").rlike(r"\.(ts|svelte)$")).select(
        names.module_of(F.col("path")).alias("m"),
        F.explode(F.array(F.struct(bare.alias("place"), F.lit(0).alias("rank")), F.struct(F.regexp_replace(bare, r"(/index|\.svelte)$", "").alias("place"), F.lit(1).alias("rank")))).alias("p"),
    )
    return found.groupBy("p.place").agg(F.min_by("m", F.struct("p.rank", "m")).alias("m"))


def exported_names(wanted: DataFrame, gives: DataFrame, brings: DataFrame) -> DataFrame:
    """What names of modules stand for: wanted (module, name) with d_module, d_name, where the name is declared ('*': a whole module).

    ``gives``: module, name, source (null: own), original. ``brings``: module, local, source, name. Names are followed
    through lists of exports, renamings, imports that are exported again, and ``export *`` (which a module's own exports
    shadow, and which has no default), level by level until nothing new comes; cycles end because no step is taken twice.
    """
    explicit = gives.filter("name <> '*'").select(F.col("module").alias("e_m"), F.col("name").alias("e_n"), "source", "original")
    star = gives.filter("name = '*'").select(F.col("module").alias("s_m"), F.col("source").alias("s_source")).distinct()
    passed = brings.select(F.col("module").alias("b_m"), F.col("local").alias("b_local"), F.col("source").alias("b_source"), F.col("name").alias("b_name"))
    front = wanted.select("module", "name", F.col("module").alias("m"), F.col("name").alias("n")).distinct()
    seen, done = front, None
    while True:
        met = front.join(explicit, (F.col("m") == F.col("e_m")) & (F.col("n") == F.col("e_n")), "left")
        met = met.join(passed, F.col("source").isNull() & (F.col("e_m") == F.col("b_m")) & (F.col("original") == F.col("b_local")), "left")
        met = met.join(star, F.col("e_m").isNull() & (F.col("n") != "default") & (F.col("m") == F.col("s_m")), "left")
        further = F.when(F.col("source").isNotNull(), F.struct(F.col("source").alias("m"), F.col("original").alias("n"))).when(F.col("b_source").isNotNull(), F.struct(F.col("b_source").alias("m"), F.col("b_name").alias("n")))
        further = further.when(F.col("s_source").isNotNull(), F.struct(F.col("s_source").alias("m"), F.col("n").alias("n")))
        met = paths.checkpointed(met.select("module", "name", "m", "n", "original", further.alias("to")))
        ends = met.filter("to IS NULL OR (to.n = '*')").select("module", "name", F.coalesce("to.m", "m").alias("d_module"), F.when(F.col("to").isNotNull(), F.lit("*")).otherwise(F.coalesce("original", "n")).alias("d_name"))
        done = ends if done is None else done.unionByName(ends)
        front = paths.checkpointed(met.filter("to IS NOT NULL AND to.n <> '*'").select("module", "name", "to.m", "to.n").distinct().join(seen, ["module", "name", "m", "n"], "left_anti"))
        if front.isEmpty():
            return done.distinct()
        seen = seen.unionByName(front)


def registry_bases(keyed: DataFrame, holders: DataFrame, most: int = 6) -> DataFrame:
    """``keyed`` (module, receiver, steps) with ``base``: every name that its receiver's value may come from, itself included.

    A value that is an access of another (``const h = this.handlers[key]``) leads to that one's name; an access and a
    value each count as a step, and what lies more than ``most`` steps away isn't reached.
    """
    columns = keyed.columns
    link = holders.select(F.col("module").alias("h_m"), F.col("name").alias("h_n"), F.col("base").alias("h_base"), (F.col("steps") + 1).alias("h_steps")).distinct()
    front, done = keyed.withColumn("base", F.col("receiver")), None
    for _ in range(most + 1):
        done = front if done is None else done.unionByName(front)
        nearer = front.join(link, (F.col("module") == F.col("h_m")) & (F.col("base") == F.col("h_n")))
        nearer = nearer.withColumns({"base": F.col("h_base"), "steps": F.col("steps") + F.col("h_steps")}).filter(F.col("steps") <= most).select(*columns, "base").distinct()
        front = paths.checkpointed(nearer)
        if front.isEmpty():
            break
    return done


def innermost(points: DataFrame, spans: DataFrame, at: str, key: str = "file") -> DataFrame:
    """``points`` with the id of the innermost span (id, start, stop) of the same key that holds ``at`` (null: none).

    Starts, ends and points of a key are put in one order; the span that holds a point is the one opened last and not yet
    closed. A running pass over a key's rows keeps the open ones, so no pairs of points and spans are formed.
    """
    columns = points.columns
    kind = points.schema[key].dataType.simpleString()
    # a span holds what lies behind its start, up to and with its end: ends come after points there, starts too
    at_point = points.select(F.col(key).alias("k"), F.col(at).cast("long").alias("at"), F.lit(0).alias("what"), F.lit(None).cast("string").alias("id"), F.struct(*columns).alias("row"))
    none = F.lit(None).cast(at_point.schema["row"].dataType)
    opens = spans.select(F.col(key).alias("k"), F.col("start").cast("long").alias("at"), F.lit(2).alias("what"), "id", none.alias("row"))
    closes = spans.select(F.col(key).alias("k"), F.col("stop").cast("long").alias("at"), F.lit(1).alias("what"), "id", none.alias("row"))
    events = at_point.unionByName(opens).unionByName(closes).repartition("k").sortWithinPartitions("k", "at", "what")
    schema = f"k {kind}, at long, what int, id string, row {at_point.schema['row'].dataType.simpleString()}, owner string"

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened = None, []
        for batch in batches:
            keys, whats, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "what", "id"))
            owners: list[str | None] = []
            for k, what, i in zip(keys, whats, ids, strict=True):
                if k != last:
                    last, opened = k, []
                if what == 2:
                    opened.append(i)
                elif what == 1 and i in opened:
                    opened.remove(i)
                owners.append(opened[-1] if what == 0 and opened else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owners, pa.string())], names=["k", "at", "what", "id", "row", "owner"]).filter(pa.array([w == 0 for w in whats], pa.bool_()))

    return events.mapInArrow(pass_over, schema).select("row.*", "owner")


def extract(files: DataFrame, config: Config, aliases: Mapping[str, str] | None = None, rust_crates: tuple[str, ...] = (), wasm_package: str | None = None) -> Graph:
    """The graph of a source tree (path, text): functions, methods, stores and components, and the calls between them.

    Beside plain calls: a function handed over as an argument (or held by an object literal that is) counts as called by
    who hands it over; a call through a registry's key counts for every function that the registry holds under the called
    name; ``wasm_package`` is a pattern of package names: in files whose text has it, a call of a member that a crate
    exports is a call of that function.
    """
    files = paths.checkpointed(files)
    found = _facts(files, config, aliases or {}, rust_crates)
    own = found["decl"].filter("NOT in_test").drop("in_test")
    number = F.row_number().over(Window.partitionBy("lang", "module").orderBy("start", "short")) - 1
    rust_id = F.concat(F.lit("rust:"), "module", F.lit("::"), "short", F.lit("@"), F.col("line").cast("string"))
    nodes = own.withColumn("id", F.when(F.col("lang") == "rust", rust_id).otherwise(names.make_id(F.col("module"), F.col("short"), F.col("line"), number)))
    spans = nodes.filter("kind NOT IN ('component', 'store')").select("file", "id", F.col("start").alias("start"), F.col("stop").alias("stop"))
    parents = innermost(spans.select("file", F.col("id").alias("child"), F.col("start").alias("begins")), spans, "begins").filter("owner IS NOT NULL")
    nodes = nodes.join(parents.select(F.col("child").alias("id"), F.col("owner").alias("parent")), "id", "left")
    nodes = paths.checkpointed(nodes.withColumn("last", F.regexp_extract("short", r"([^.]*)$", 1)))

    # a body holds its first character, which is all of a call in `() => f()`; what stands before it, among the parameters,
    # is called by nobody
    bodies = nodes.filter("kind NOT IN ('component', 'store')").select("file", "id", "start", (F.col("body") - 1).alias("body"), "stop")
    heads = bodies.filter("body > start").select("file", F.concat(F.lit("#"), "id").alias("id"), "start", F.col("body").alias("stop"))
    spread = innermost(found["call"].distinct(), bodies.select("file", "id", F.col("body").alias("start"), "stop").unionByName(heads), "at")
    spread = spread.filter("owner IS NULL OR NOT startswith(owner, '#')")
    component = nodes.filter("kind = 'component'").select(F.col("file").alias("c_file"), F.col("id").alias("component"))
    sites = paths.checkpointed(spread.join(component, F.col("file") == F.col("c_file"), "left").withColumn("owner", F.coalesce("owner", "component")).drop("c_file", "component"))

    target = nodes.select(F.col("id").alias("target"), F.col("module").alias("t_module"), F.col("short").alias("t_short"), "last", F.col("kind").alias("t_kind"), F.col("class_name").alias("t_class"), F.col("lang").alias("t_lang"), (F.col("stop") > F.col("body")).alias("has_body"))
    # a function inside a class is called by its own name
    target = paths.checkpointed(target.withColumn("t_call", F.when(F.col("t_class").isNotNull() & (F.col("t_kind") == "function"), F.col("last")).otherwise(F.col("t_short"))))
    places = module_places(files)
    brings = paths.checkpointed(found["brings"].join(places, "place").withColumn("source", F.col("m")).select("file", "module", "local", "name", "source"))
    gives = found["gives"].join(places, "place", "left").filter("place IS NULL OR m IS NOT NULL").select("module", "name", F.col("m").alias("source"), "original")
    gives = paths.checkpointed(gives)
    named = exported_names(brings.filter("name <> '*'").select(F.col("source").alias("module"), "name"), gives, brings)
    plainly = brings.join(named.withColumnsRenamed({"module": "n_module", "name": "n_name"}), (F.col("source") == F.col("n_module")) & (F.col("name") == F.col("n_name")))
    brought = plainly.select(F.col("file").alias("i_file"), "local", F.col("d_module").alias("i_module"), F.col("d_name").alias("original"))
    whole = brings.filter("name = '*'").select(F.col("file").alias("i_file"), "local", F.col("source").alias("i_module")).unionByName(brought.filter("original = '*'").select("i_file", "local", "i_module"))
    brought, whole = paths.checkpointed(brought.filter("original <> '*'")), paths.checkpointed(whole)
    site = sites.withColumn("lang", F.when(F.col("file").endswith(".rs"), "rust").otherwise("ts"))
    ts = site.filter("lang = 'ts' AND how <> 'dispatch'")
    plain = ts.filter("receiver IS NULL")
    here = plain.join(target, (F.col("module") == F.col("t_module")) & (F.col("name") == F.col("t_call"))).withColumn("tier", F.lit(1))
    from_import = plain.join(brought, (F.col("file") == F.col("i_file")) & (F.col("name") == F.col("local"))).join(target, (F.col("i_module") == F.col("t_module")) & (F.col("original") == F.col("t_short"))).withColumn("tier", F.lit(2))
    full = F.concat("receiver", F.lit("."), "name")
    dotted = ts.filter("receiver IS NOT NULL AND receiver <> '$'")
    own_dotted = dotted.join(target, (F.col("module") == F.col("t_module")) & (full == F.col("t_short"))).withColumn("tier", F.lit(1))
    far_dotted = dotted.join(brought, (F.col("file") == F.col("i_file")) & (F.col("receiver") == F.col("local"))).join(target, (F.col("i_module") == F.col("t_module")) & (F.concat("original", F.lit("."), "name") == F.col("t_short"))).withColumn("tier", F.lit(2))
    asked = dotted.join(whole, (F.col("file") == F.col("i_file")) & (F.col("receiver") == F.col("local")))
    member = exported_names(asked.select(F.col("i_module").alias("module"), "name"), gives, brings).withColumnsRenamed({"module": "n_module", "name": "n_name"})
    of_module = asked.join(member, (F.col("i_module") == F.col("n_module")) & (F.col("name") == F.col("n_name"))).join(target, (F.col("d_module") == F.col("t_module")) & (F.col("d_name") == F.col("t_short"))).withColumn("tier", F.lit(2))
    methods = target.filter("t_kind IN ('method', 'accessor') AND t_lang = 'ts' AND has_body")
    methods = methods.join(methods.groupBy("last").agg(F.count("*").alias("same")).filter("same = 1").select("last"), "last", "left_semi")  # counted, not gathered: a name may be in every file
    by_name = dotted.join(methods, F.col("name") == F.col("last")).withColumn("tier", F.lit(3))
    reads = ts.filter("receiver = '$'").join(brought, (F.col("file") == F.col("i_file")) & (F.col("name") == F.col("local"))).join(target.filter("t_kind = 'store'"), (F.col("i_module") == F.col("t_module")) & (F.col("original") == F.col("t_short"))).withColumn("tier", F.lit(1))
    rust = site.filter("lang = 'rust'").join(target.filter("t_lang = 'rust'"), (F.col("module") == F.col("t_module")) & (F.col("name") == F.col("last"))).withColumn("tier", F.lit(1))
    handed = F.col("how") != "pass"  # only functions and methods are handed over
    callable_ = F.col("t_kind").isin("function", "method")
    store_use = ts.filter("receiver IS NOT NULL AND receiver NOT IN ('$', '') AND how = 'call'").join(brought, (F.col("file") == F.col("i_file")) & (F.col("receiver") == F.col("local")))
    store_use = store_use.join(target.filter("t_kind = 'store'"), (F.col("i_module") == F.col("t_module")) & (F.col("original") == F.col("t_short")))
    own_store = ts.filter("receiver IS NOT NULL AND receiver NOT IN ('$', '') AND how = 'call'").join(target.filter("t_kind = 'store'"), (F.col("module") == F.col("t_module")) & (F.col("receiver") == F.col("t_short")))
    dispatched = _dispatched(site, found["entry"], found["holder"], brought, target)
    columns = ["file", "at", "how", "owner", "in_test", "target", "tier"]
    here, from_import, own_dotted, far_dotted, of_module, by_name = (df.filter(handed | callable_) for df in (here, from_import, own_dotted, far_dotted, of_module, by_name))
    hits = here.select(columns)
    for part in (from_import, own_dotted, far_dotted, of_module, by_name, reads, rust):
        hits = hits.unionByName(part.select(columns))
    best = hits.withColumn("best", F.min("tier").over(Window.partitionBy("file", "at", "how"))).filter("tier = best").drop("best")
    best = paths.checkpointed(best)
    # what no name resolves: members that a crate exports, and values under keys of registries; uses of stores come on top
    resolved = best.filter("how = 'call'").select("file", "at").distinct()
    extra = dispatched
    if wasm_package:
        bridged = files.filter(F.col("text").rlike(wasm_package)).select(F.col("path").alias("file"))
        exported = nodes.filter("wasm").groupBy("last").agg(F.max_by("id", "start").alias("target"))
        over = ts.filter("receiver IS NOT NULL AND receiver <> '$' AND how = 'call'").join(bridged, "file", "left_semi").join(exported, F.col("name") == F.col("last")).withColumn("tier", F.lit(4))
        extra = extra.unionByName(over.select(columns))
    extra = extra.join(resolved, ["file", "at"], "left_anti")
    for part in (store_use, own_store):
        extra = extra.unionByName(part.withColumn("tier", F.lit(1)).select(columns))
    best = paths.checkpointed(best.unionByName(extra))

    calls = rollups.edge_counts(best.filter("NOT in_test AND owner IS NOT NULL").select(F.col("owner").alias("src"), F.col("target").alias("dst")))
    tested = best.filter("in_test").select(F.col("target").alias("id")).distinct().withColumn("tested", F.lit(True))
    used = best.filter("owner IS NULL AND NOT in_test").select(F.col("target").alias("id")).distinct().withColumn("module_used", F.lit(True))
    plane = F.when(F.col("lang") == "rust", 2).when(F.col("file").endswith(".svelte"), 1).otherwise(0)
    auto = F.when(F.col("doc") != "", F.col("doc")).otherwise(names.auto_describe(F.col("last")))
    nodes = nodes.join(tested, "id", "left").join(used, "id", "left").select(
        "id", F.col("short").alias("name"), F.when(F.col("class_name").isNotNull() & (F.col("lang") == "ts"), F.concat("class_name", F.lit("."), "last")).otherwise(F.col("short")).alias("short"), "file", "module", "grp", "line", "end_line", "kind", "class_name", "exported", "signature", "doc",
        names.humanize(F.col("last")).alias("humanized"), auto.alias("descr"), F.greatest(F.lit(1), F.col("end_line") - F.col("line") + 1).alias("loc"), (F.col("stop") - F.col("start") + 1).alias("chars"), "numeric_ops",
        F.coalesce("tested", F.lit(False)).alias("tested"), "legacy_reactive", "module_used", F.col("parent").isNotNull().alias("nested"), "parent", "lang", plane.alias("plane"), "start",
    )
    nodes = global_index(nodes, ["plane", "file", "start", "short"], "nodes", "node_ord").drop("plane", "start")
    at = nodes.select("id", "node_ord")
    edges = calls.join(at.select(F.col("id").alias("src"), F.col("node_ord").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("node_ord").alias("b")), "dst")
    edges = global_index(edges, ["a", "b"], "edges", "edge_ord").select("edge_ord", "src", "dst", "cnt")
    listed = files.filter(names.is_source_file(F.concat(F.lit("/"), "path"), f"/{config.src_dir.strip('/')}/") | F.col("path").endswith(".svelte")).select(F.col("path").alias("file"))
    g = Graph(paths.checkpointed(with_degrees(nodes, edges)), edges, config)
    g = g.having(given_files=paths.checkpointed(_all_files(g, listed)))
    return g.having(nodes=paths.checkpointed(paths.with_test_depth(g)))


def extract_project(spark: SparkSession, root: str, project: Project) -> tuple[Graph, DataFrame]:
    """The graph of a project's tree with its decisions and curated descriptions, and warnings (what, subject)."""
    aliases, told = tsconfig(project.tsconfig, project.paths)
    files = read_files(spark, root)
    present = crate_warnings(crates(spark, root), list(project.crates)).select(F.concat(F.lit("crate "), "problem").alias("what"), F.col("crate").alias("subject"))
    warnings = present.unionByName(spark.createDataFrame([("tsconfig", t) for t in told], "what string, subject string"))
    g = extract(files, project.config, aliases, project.crates, project.wasm_package)
    if project.decisions and os.path.exists(project.decisions):
        text = spark.read.text(project.decisions, wholetext=True)
        g = g.having(adrs=text.select(F.explode(names.declared_rules(F.col("value"))).alias("d")).select("d.id", F.trim("d.title").alias("title")))
    if project.descriptions and os.path.exists(project.descriptions):
        scopes = ", ".join(f"{s}s map<string, string>" for s in ("group", "module", "function"))
        raw = spark.read.schema(scopes).option("multiLine", True).json(project.descriptions)
        parts = [raw.select(F.lit(s).alias("scope"), F.explode(f"{s}s").alias("key", "text")) for s in ("group", "module", "function")]
        g = g.having(descriptions=parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return g, warnings


def _dispatched(site: DataFrame, e: DataFrame, holders: DataFrame, brought: DataFrame, target: DataFrame) -> DataFrame:
    """Calls through keys, and through values that come from registries: every function that the registry, own or imported, holds under the called name."""
    own = e.filter("receiver IS NULL").join(target, (F.col("module") == F.col("t_module")) & ((F.col("name") == F.col("t_short")) | (F.col("name") == F.col("t_call"))))
    far = e.filter("receiver IS NULL").join(brought, (F.col("file") == F.col("i_file")) & (F.col("name") == F.col("local"))).join(target, (F.col("i_module") == F.col("t_module")) & (F.col("original") == F.col("t_short")))
    member = e.filter("receiver IS NOT NULL").join(target, (F.col("module") == F.col("t_module")) & (F.col("name") == F.col("last")))
    held = None
    for part in (own, far, member):
        part = part.filter("t_kind IN ('function', 'method')").select(F.col("module").alias("r_module"), "registry", "key", "target")
        held = part if held is None else held.unionByName(part)
    held = paths.checkpointed(held.distinct())
    keyed = site.filter("how = 'dispatch'").select("file", "at", "how", "owner", "in_test", F.col("module"), "receiver", "name", "steps")
    # only what may come to a registry: values that hold accesses, registries, and what is imported
    first = held.select(F.col("r_module").alias("module"), F.col("registry").alias("receiver")).unionByName(holders.select("module", F.col("name").alias("receiver"))).distinct()
    bases = registry_bases(keyed.join(first, ["module", "receiver"], "left_semi").unionByName(keyed.join(brought.select(F.col("i_file").alias("file"), F.col("local").alias("receiver")).distinct(), ["file", "receiver"], "left_semi")).distinct(), holders)
    bases = bases.filter("name IS NOT NULL OR steps > 0")  # a literal itself can't be called
    under = F.col("name").isNull() | (F.col("name") == F.col("key"))
    near = bases.join(held, (F.col("module") == F.col("r_module")) & (F.col("base") == F.col("registry")) & under)
    away = bases.join(brought, (F.col("file") == F.col("i_file")) & (F.col("base") == F.col("local"))).join(held, (F.col("i_module") == F.col("r_module")) & (F.col("original") == F.col("registry")) & under)
    columns = ["file", "at", "how", "owner", "in_test", "target"]
    return near.select(columns).unionByName(away.select(columns)).distinct().withColumn("tier", F.lit(4))


def _all_files(g: Graph, listed: DataFrame) -> DataFrame:
    """Files with their number of nodes, those without any included."""
    prefix = g.config.namespace_prefix
    own = listed.select("file", names.module_of(F.col("file")).alias("m")).select("file", F.col("m").alias("l_module"), names.group_of(F.col("m"), prefix).alias("l_grp"))
    both = g.files.join(own, "file", "full_outer").select("file", F.coalesce("module", "l_module").alias("module"), F.coalesce("grp", "l_grp").alias("grp"), F.coalesce("fns", F.lit(0)).alias("fns"))
    return global_index(both, [F.when(F.col("file").endswith(".rs"), 2).when(F.col("file").endswith(".svelte"), 1).otherwise(0), "file"], "files", "file_ord")
