"""A source tree as a property graph: facts, then joins that resolve names, imports, types, routes and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.storage import settled
from loomgraph.operators import graph as G
from loomgraph.operators import resolve as R
from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.scan import scan
from loomgraph.plans import bindings as B
from loomgraph.plans import imports as I
from loomgraph.plans.routes import routes
from loomgraph.plans.types import type_edges
from loomgraph.sources import docs as D
from loomgraph.sources import files as S
from loomgraph.sources import manifests as M
from loomgraph.sources import workspace as W
from loomgraph.sources.languages import GROUPS, NOISE

MAX_TARGETS = 5


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, r"::|[./\\]"), -1)


def _owner(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)(?:::|\.|\\|/)[^.:\\/]+$", 1)


def _group(language: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv))[language], language)


def ancestors(types: DataFrame) -> DataFrame:
    """short, ancestor: transitive bases by short name, without cycles."""
    pairs = types.select(_last(F.col("source")).alias("src"), _last(F.col("target")).alias("dst")).distinct()
    return G.closure(pairs).select(F.col("src").alias("short"), F.col("dst").alias("ancestor"))


def calls(functions: DataFrame, relations: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CALLS edges (src, dst, call_lines, call_count, resolution, candidates, import_backed) and counters (outcome, n).

    Equal names in one function are one site, since the outcome depends on nothing else. A name that one function has is settled
    before windows run over the ambiguous rest."""
    noise = F.lit(False)
    for language, names in NOISE.items():
        noise = noise | ((F.col("language") == language) & F.col("method").isin(*names))
    sites = functions.select(F.col("id").alias("src"), "language", F.col("file_path").alias("src_file"), F.col("owner").alias("src_owner"), F.explode("calls").alias("c")).groupBy("src", "language", "src_file", "src_owner", F.col("c.name").alias("name")).agg(F.array_sort(F.collect_set("c.line")).alias("lines"))
    sites = sites.withColumn("method", _last(F.col("name"))).withColumn("hint", F.nullif(_last(_owner(F.col("name"))), F.lit("")))
    open_ = sites.where(~noise)
    defs = functions.select(F.col("id").alias("dst"), "qualified_name", F.col("title").alias("method"), F.col("owner").alias("dst_owner"), F.col("file_path").alias("dst_file"), F.col("language").alias("dst_language"), F.col("module_path").alias("dst_module"), "nesting_depth")
    exact = open_.join(defs.select("dst", "dst_file", F.col("qualified_name").alias("name")), "name")
    exact = exact.withColumn("candidates", F.count("*").over(Window.partitionBy("src", "name"))).withColumn("tier", F.lit("exact_qualified"))
    rest = open_.join(defs.select(F.col("qualified_name").alias("name")).distinct(), "name", "left_anti")
    pairs = rest.join(defs, "method").where((F.col("nesting_depth") == 0) | (F.col("src_file") == F.col("dst_file")))
    bases = ancestors(relations).groupBy("short").agg(F.collect_set("ancestor").alias("bases"))
    pairs = pairs.withColumn("short", _last("src_owner")).join(bases, "short", "left").join(imports.select(F.col("src").alias("src_file"), F.col("dst").alias("dst_file"), F.lit(True).alias("imported")), ["src_file", "dst_file"], "left")
    owner = _last(F.col("dst_owner"))
    tiers = [
        ("receiver", owner == F.coalesce("hint", "short")), ("inherited", F.col("hint").isNull() & F.array_contains("bases", owner)), ("owner_prefix", _owner(F.col("dst_owner")) == _owner(F.col("src_owner"))),
        ("import", F.col("imported")), ("same_file", F.col("src_file") == F.col("dst_file")), ("language_group", _group(F.col("language")) == _group(F.col("dst_language"))),
    ]
    narrowed = R.tiered_narrow(pairs, ["src", "name"], tiers, None)
    kept = narrowed.where(F.col("candidates") <= MAX_TARGETS)
    every = exact.select("src", "name", "lines", "dst", "src_file", "dst_file", "candidates", "tier").unionByName(kept.select("src", "name", "lines", "dst", "src_file", "dst_file", "candidates", "tier"))
    every = settled(every)
    rank = F.array_position(F.array(*(F.lit(t) for t in ("exact_qualified", "unique_name", *(t for t, _ in tiers)))), F.col("tier"))
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines"))))
    edges = every.where("src <> dst").groupBy("src", "dst").agg(lines.alias("l"), F.min_by("tier", rank).alias("resolution"), F.min("candidates").alias("candidates"), F.first("src_file").alias("src_file"), F.first("dst_file").alias("dst_file"))
    edges = edges.join(imports.select(F.col("src").alias("src_file"), F.col("dst").alias("dst_file"), F.lit(True).alias("imported")), ["src_file", "dst_file"], "left")
    edges = edges.select("src", "dst", F.array_join(F.col("l").cast("array<string>"), ",").alias("call_lines"), F.size("l").cast("long").alias("call_count"), "resolution", "candidates", ((F.col("src_file") == F.col("dst_file")) | F.coalesce("imported", F.lit(False))).alias("import_backed"))
    n = F.sum(F.size("lines")).alias("n")
    hit = every.groupBy("src", "name").agg(F.first("lines").alias("lines"))
    stats = G.union_all([
        sites.agg(n).select(F.lit("total").alias("outcome"), "n"), sites.where(noise).agg(n).select(F.lit("excluded").alias("outcome"), "n"), hit.agg(n).select(F.lit("resolved").alias("outcome"), "n"),
        rest.join(narrowed.select("src", "name").distinct(), ["src", "name"], "left_anti").agg(n).select(F.lit("no_candidate").alias("outcome"), "n"), narrowed.where(F.col("candidates") > MAX_TARGETS).groupBy("src", "name").agg(F.first("lines").alias("lines")).agg(n).select(F.lit("ambiguous").alias("outcome"), "n"),
    ])
    return edges, stats.select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def service_calls(sources: DataFrame, functions: DataFrame, route: DataFrame) -> DataFrame:
    """CALLS_SERVICE: client requests in a function's lines whose path fits a route's segments."""
    lines = sources.select(F.col("path").alias("file_path"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("i", "s")).where(F.col("s").rlike(r"(?:fetch|axios(?:\.\w+)?|requests\.\w+|httpx\.\w+|\$http\.\w+|HttpClient\.\w+)\(") & ~F.col("s").rlike(r"^\s*(?://|#|\*)"))
    asked = lines.select("file_path", (F.col("i") + 1).alias("line"), F.regexp_replace(F.regexp_extract("s", r"(?:fetch|axios(?:\.\w+)?|requests\.\w+|httpx\.\w+|\$http\.\w+|HttpClient\.\w+)\(\s*f?['\"`]([^'\"`]+)['\"`]", 1), r"^https?://[^/]+", "").alias("url")).where("url <> ''")
    inside = asked.join(functions.select(F.col("id").alias("src"), F.col("file_path"), "line_number", "end_line"), "file_path").where("line BETWEEN line_number AND end_line")
    return R.segment_match(inside.select("src", "url"), "url", route.select(F.col("id").alias("dst"), F.col("title").alias("template")), "template").select("src", "dst", F.lit("inferred").alias("confidence")).distinct()


def named_calls(transfers: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CALLS edges of assembly (src, dst, call_lines, call_count): a call names its routine in full, so no tiers are needed. And counters (outcome, n)."""
    known = functions.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    asked = transfers.where("kind IN ('call', 'indirect_call')").join(known, "target", "left").withColumn("known", F.coalesce("known", F.lit(False)) & (F.col("kind") == "call"))
    found = asked.where("known AND caller <> target").select(F.col("caller").alias("src"), F.col("target").alias("dst"), "line")
    edges = G.one_edge_per_pair(found, "line").withColumnsRenamed({"sites": "call_lines", "site_count": "call_count"})
    outcome = F.explode(F.array(F.lit("total"), F.when(F.col("known"), "resolved").otherwise("no_candidate")))
    return edges, asked.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def named_references(sites: DataFrame, functions: DataFrame, constants: DataFrame) -> DataFrame:
    """REFERENCES edges of assembly: src, dst, line (the first), reference_lines, reference_count, opcodes, accesses, has_read, has_write, has_address."""
    at = sites.join(functions.select(F.col("id").alias("caller")), "caller", "left_semi").join(constants.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    is_any = lambda *names: F.bool_or(F.col("access").isin(*names))
    lines, opcodes = F.array_sort(F.collect_set("line")), F.array_sort(F.collect_set("opcode"))
    flags = at.groupBy(F.col("caller").alias("src"), F.col("target").alias("dst")).agg(
        F.min("line").alias("line"), F.array_join(lines.cast("array<string>"), ",").alias("reference_lines"), F.size(lines).cast("long").alias("reference_count"), F.array_join(opcodes, ",").alias("opcodes"),
        is_any("read", "read_write").alias("has_read"), is_any("write", "read_write").alias("has_write"), is_any("address").alias("has_address"), is_any("read_write").alias("_both"), is_any("unknown").alias("_unknown"),
    )
    order = (("has_address", "address"), ("has_read", "read"), ("_both", "read_write"), ("_unknown", "unknown"), ("has_write", "write"))
    return flags.withColumn("accesses", F.array_join(F.array_compact(F.array(*(F.when(F.col(c), name) for c, name in order))), ",")).drop("_both", "_unknown")


def symbol_links(constants: DataFrame, functions: DataFrame) -> DataFrame:
    """src, dst, type (ALIAS_OF or POINTS_TO), label (of dst), line: data of assembly that are defined by another symbol, a datum before a routine."""
    relation = F.when(F.col("kind").isin("EQUALS", "="), "ALIAS_OF").when(F.col("kind").isin("ADRES", "CADR", "ECADR", "GENADR", "BBCON"), "POINTS_TO")
    asked = constants.select(F.col("id").alias("src"), relation.alias("type"), F.split("value_preview", " ")[0].alias("dst"), F.col("line_number").alias("line")).where("type IS NOT NULL AND dst <> ''")
    known = constants.select(F.col("id").alias("dst"), F.lit("Constant").alias("label")).unionByName(functions.select(F.col("id").alias("dst"), F.lit("Function").alias("label")))
    return asked.join(known.groupBy("dst").agg(F.min("label").alias("label")), "dst").select("src", "dst", "type", "label", "line").distinct()


def build(spark: SparkSession, root: str, include_tests: bool = True, max_loc: int | None = None, docs: bool = True, known: DataFrame | None = None) -> PropertyGraph:
    """The graph of a tree. Facts are parsed once and written; all else is joins over them.

    root: a folder, or a manifest in it. Where the manifest at the top tells folders of sources (`manifests.roots`), only files below them are read, those of tests with
    include_tests alone; documents come from the whole tree.
    known: the facts of an earlier graph of this tree (`graph.facts`), made with the same arguments: only files that have changed since are parsed."""
    manifest = root.rstrip("/").rsplit("/", 1)[-1] if root.endswith(M.NAMES) else None
    root = root.rstrip("/")[: -len(manifest) - 1] if manifest else root
    project = M.read(spark, root, manifest)
    scope = M.scope(spark, root, project, include_tests)
    facts = settled(S.facts(spark, root, max_loc, include_tests, known, scope))
    files = facts.select(F.col("path").alias("id"), F.col("filename").alias("title"), "language", "loc", "module_path", "is_test", F.col("path").rlike("(?:^|/)(?:asv_bench|benchmarks?|bench)/").alias("is_benchmark"), "skip_reason", F.size("annotations").alias("annotation_count"))
    f = facts.select(F.col("path").alias("file_path"), "language", "module_path", "is_test", F.explode("functions").alias("f")).select("file_path", "language", "module_path", "is_test", "f.*")
    f = B.promoted(f, B.FUNCTION_FLAGS, B.FUNCTION_TEXTS)
    f = R.nested_twins(f, ["file_path", "qualified_name"], "line_number", "qualified_name", F.col("nesting_depth") > 0)
    f = R.keep_last(f, ["qualified_name", "signature", "file_path"], ["line_number"])
    functions = settled(R.overload_ids(f, "qualified_name", "signature", "id").withColumnRenamed("name", "title"))
    classes = B.promoted(facts.select(F.col("path").alias("file_path"), F.explode("classes").alias("c")).select("file_path", "c.*"), B.TYPE_FLAGS, B.TYPE_TEXTS)
    classes = R.keep_last(classes, ["qualified_name"], ["file_path", "line_number"]).withColumnsRenamed({"qualified_name": "id", "name": "title"})
    label = F.when(F.col("kind").isin("struct",), "Struct").when(F.col("kind").isin("interface",), "Interface").when(F.col("kind") == "trait", "Trait").when(F.col("kind") == "protocol", "Protocol").when(F.col("kind") == "enum", "Enum").when(F.col("kind") == "mixin", "Mixin").otherwise("Class")
    classes = settled(classes.withColumn("_label", label).join(type_fields(facts), "id", "left"))
    constants = R.keep_last(facts.select(F.col("path").alias("file_path"), F.explode("constants").alias("c")).select("file_path", "c.*"), ["qualified_name"], ["file_path", "line_number"]).withColumnsRenamed({"qualified_name": "id", "name": "title"})
    relations = facts.select(F.explode("relations").alias("r")).select("r.*").distinct()
    modules = facts.select(F.explode(R.prefixes(F.col("module_path"), ".")).alias("id")).where(~_last(F.col("id")).rlike(r"^\d+$")).distinct()
    imports, module_imports = (settled(x) for x in I.resolved(facts, modules, settled(W.configurations(spark, root))))
    call_edges, stats = calls(functions, relations, imports)
    route, handles = (settled(x) for x in routes(functions, facts, constants))
    nodes: dict[str, DataFrame] = {"File": files, "Function": functions.drop("calls", "function_refs", "references"), "Constant": constants, "Route": route, "Module": modules.select("id", _last(F.col("id")).alias("title")), "Project": M.node(spark, project, files)}
    for x in ("Class", "Struct", "Interface", "Trait", "Protocol", "Enum", "Mixin"):
        nodes[x] = classes.where(F.col("_label") == x).drop("_label")
    nodes["Element"] = facts.select(F.col("path").alias("file_path"), F.explode("elements").alias("e")).select(F.col("e.qualified_name").alias("id"), F.col("e.text").alias("title"), "file_path", "e.tag", "e.line_number", "e.parent")
    nodes["Selector"] = facts.select(F.col("path").alias("file_path"), F.explode("selectors").alias("e")).select(F.col("e.qualified_name").alias("id"), F.col("e.name").alias("title"), "file_path", "e.line_number")
    procedures = functions.select(F.col("id").alias("dst"), F.explode("procedure_names").alias("src")).distinct()
    nodes["Procedure"] = procedures.select(F.col("src").alias("id"), F.col("src").alias("title")).distinct()
    nodes["Dependency"] = M.dependencies(spark, project)
    edges: dict[G.EdgeKey, DataFrame] = {
        ("IMPORTS", "File", "File"): imports, ("IMPORTS", "File", "Module"): module_imports, ("CALLS", "Function", "Function"): call_edges, ("HANDLES", "Route", "Function"): handles, ("IMPLEMENTED_BY", "Procedure", "Function"): procedures,
        ("HAS_FILE", "Module", "File"): files.select(F.col("module_path").alias("src"), F.col("id").alias("dst")), ("HAS_SUBMODULE", "Module", "Module"): I.submodules(facts, modules),
        ("DEPENDS_ON", "Project", "Dependency"): nodes["Dependency"].select(F.lit(project.name).alias("src"), F.col("id").alias("dst")), ("HAS_SOURCE", "Project", "File"): files.select(F.lit(project.name).alias("src"), F.col("id").alias("dst")),
        ("HAS_CHILD", "Element", "Element"): nodes["Element"].where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst")), ("CALLS_SERVICE", "Function", "Route"): service_calls(S.sources(spark, root, scope), functions, route),
    }
    for x in ("Function", "Constant", "Class", "Struct", "Interface", "Trait", "Protocol", "Enum", "Mixin", "Element", "Selector"):
        edges["DEFINES", "File", x] = nodes[x].select(F.col("file_path").alias("src"), F.col("id").alias("dst")).distinct()
    typed = G.union_all([nodes[x].select("id", "title", F.lit(x).alias("label"), "file_path") for x in ("Class", "Struct", "Interface", "Trait", "Protocol", "Enum", "Mixin")])
    named = facts.select(F.col("path").alias("file_path"), F.explode("imports").alias("i")).select("file_path", F.trim("i.name").alias("scope"))
    named = named.unionByName(module_imports.select(F.col("src").alias("file_path"), F.col("dst").alias("scope")))
    stubs = _types(edges, typed, relations, functions, named)
    for x in ("Class", "Trait"):
        outside = stubs.where(F.col("label") == x).select("id", "title", F.lit(True).alias("is_external"))
        nodes[x] = nodes[x].withColumn("is_external", F.lit(False)).unionByName(outside, allowMissingColumns=True)
    edges["BINDS", "Function", "Function"] = B.binds(functions)
    seen = settled(B.exposes(functions, classes))
    for x in ("Function", "Struct", "Enum"):
        edges["EXPOSES", "Function", x] = seen.where(F.col("label") == x).select("src", "dst", "py_name")
    refs = lambda c: functions.select(F.col("id").alias("src"), "file_path", F.explode(c).alias("r")).select("src", "file_path", F.col("r.name").alias("name"), F.col("r.line").alias("line"))
    by_name = refs("references").join(constants.select(F.col("title").alias("name"), F.col("id").alias("dst")), "name").groupBy("src", "dst").agg(F.min("line").alias("line"))
    sites = facts.select(F.explode("sites").alias("s")).select("s.*")
    edges["REFERENCES", "Function", "Constant"] = G.union_all([by_name, named_references(sites, functions, constants)])
    named = functions.where("nesting_depth = 0").select(F.col("title").alias("name"), F.col("id").alias("dst"))
    passed = R.unique_match(refs("function_refs").withColumn("name", _last(F.col("name"))), named, "name", "dst")
    edges["REFERENCES_FN", "Function", "Function"] = passed.where("src <> dst").groupBy("src", "dst").agg(F.min("line").alias("line"))
    decorated = functions.select(F.col("id").alias("dst_fn"), F.explode("decorators").alias("decorator_name")).withColumn("name", _last(F.regexp_replace("decorator_name", r"\(.*$", "")))
    edges["DECORATES", "Function", "Function"] = R.unique_match(decorated, named, "name", "dst").where("dst <> dst_fn").groupBy(F.col("dst").alias("src"), F.col("dst_fn").alias("dst")).agg(F.min("decorator_name").alias("decorator_name"))
    transfers = facts.select(F.explode("transfers").alias("t")).select("t.*")
    told_calls, told = named_calls(transfers, functions)
    edges["CALLS", "Function", "Function"] = G.union_all([call_edges, told_calls])
    stats = stats.unionByName(told).groupBy("outcome").agg(F.sum("n").alias("n"))
    moves = transfers.join(functions.select(F.col("id").alias("target")), "target", "left_semi")
    for kind, name in (("jump", "JUMPS_TO"), ("branch", "BRANCHES_TO")):
        edges[name, "Function", "Function"] = G.one_edge_per_pair(moves.where(F.col("kind") == kind).select(F.col("caller").alias("src"), F.col("target").alias("dst"), "line"), "line").withColumnsRenamed({"sites": "transfer_lines", "site_count": "transfer_count"})
    symbols = symbol_links(constants, functions)
    for name in ("ALIAS_OF", "POINTS_TO"):
        for x in ("Constant", "Function"):
            edges[name, "Constant", x] = symbols.where((F.col("type") == name) & (F.col("label") == x)).select("src", "dst", "line")
    if docs:
        d = settled(D.documents(spark, root))
        nodes["Doc"] = settled(D.nodes(d))
        symbols = G.union_all([functions.select("id", "title", F.lit("Function").alias("label")), typed.drop("file_path"), constants.select("id", "title", F.lit("Constant").alias("label"))])
        told = settled(D.resolve_mentions(D.mentions(d), symbols))
        for x in D.SYMBOL_LABELS:
            edges["MENTIONS", "Doc", x] = told.where(F.col("dst_label") == x).select("src", "dst", "strategy")
        edges["DOCUMENTS", "Doc", "Doc"], edges["DOCUMENTS", "Doc", "File"] = D.linked(d, files)
        edges["HAS_DOC", "Project", "Doc"] = d.select(F.lit(project.name).alias("src"), F.col("id").alias("dst"))
    g = PropertyGraph(nodes, edges)
    g.call_stats, g.facts = stats, facts
    return g


def type_fields(facts: DataFrame) -> DataFrame:
    """id (of a type), fields: a JSON list of name, type, visibility and default, in the order of the files and of their texts. What isn't told is null there."""
    told = facts.select("path", F.explode("fields").alias("f")).select("path", "f.*")
    shown = F.struct("name", "type", "visibility", "default")
    listed = F.array_sort(F.collect_list(F.struct("path", "place", shown.alias("shown"))))
    return told.groupBy(F.col("owner").alias("id")).agg(F.to_json(F.transform(listed, lambda x: x["shown"]), {"ignoreNullFields": "false"}).alias("fields"))


#: Labels of types, those later on win where types of several kinds have one name.
TYPE_RANK = {"Class": 0, "Struct": 0, "Mixin": 0, "Enum": 1, "Interface": 2, "Trait": 2, "Protocol": 2}


def uses_type(functions: DataFrame, typed: DataFrame) -> DataFrame:
    """src, dst, label, position: the types that a function's annotations name.

    Annotations are scanned for all type names of two characters or more, leftmost and longest first, so `Foo::Bar` wins over `Foo`. Of several types of
    one name an interface wins over an enum, and that over a class; of equals the last id. The signature counts only where no parameter is
    annotated. position: receiver, parameter or return, both for more than one of them, signature for none."""
    rank = F.create_map(*(F.lit(x) for kv in TYPE_RANK.items() for x in kv))[F.col("label")]
    names = R.keep_last(typed.where(F.length("title") > 1), ["title"], [rank, "id"]).select("title", F.col("id").alias("dst"), "label")
    bit = lambda c: F.when(c, 8).otherwise(1)
    annotated = functions.select(F.col("id").alias("src"), F.explode("parameters").alias("p")).select("src", F.col("p.type_annotation").alias("text"), bit(F.col("p.kind") == "receiver").alias("bit"))
    returned = functions.select(F.col("id").alias("src"), F.col("return_type").alias("text"), F.lit(2).alias("bit"))
    bare = ~F.exists("parameters", lambda p: p["type_annotation"].isNotNull())
    signed = functions.where(bare).select(F.col("id").alias("src"), F.col("signature").alias("text"), F.lit(4).alias("bit"))
    places = settled(G.union_all([annotated, returned, signed]).where("text <> ''").distinct())
    texts = settled(places.select("text").distinct().withColumn("key", F.monotonically_increasing_id()))
    found = scan(texts, "key", "text", names, "title").select("key", "title").distinct().join(texts, "key")
    bits = places.join(found, "text").join(names, "title").groupBy("src", "dst", "label").agg(F.bit_or("bit").alias("bits"))
    has = lambda b: (F.col("bits").bitwiseAND(b) != 0).cast("int")
    position = F.when(has(1) + has(2) + has(8) > 1, "both").when(has(8) == 1, "receiver").when(has(1) == 1, "parameter").when(has(2) == 1, "return").otherwise("signature")
    return bits.select("src", "dst", "label", position.alias("position"))


def _types(edges: dict[G.EdgeKey, DataFrame], typed: DataFrame, relations: DataFrame, functions: DataFrame, named: DataFrame) -> DataFrame:
    """EXTENDS, IMPLEMENTS, HAS_METHOD and USES_TYPE, by the ends' labels. Returns the types outside the tree."""
    best, stubs = (settled(x) for x in type_edges(relations, typed, named))
    for r in best.select("type", "src_label", "dst_label").distinct().collect():  # a few label pairs
        edges[r.type, r.src_label, r.dst_label] = best.where((F.col("type") == r.type) & (F.col("src_label") == r.src_label) & (F.col("dst_label") == r.dst_label)).select("src", "dst")
    methods = functions.where("owner IS NOT NULL").select(F.col("owner").alias("src"), F.col("id").alias("dst")).join(typed.select(F.col("id").alias("src"), "label"), "src")
    used = uses_type(functions, typed)
    for x in ("Class", "Struct", "Interface", "Trait", "Protocol", "Enum", "Mixin"):
        edges["HAS_METHOD", x, "Function"] = methods.where(F.col("label") == x).select("src", "dst")
        edges["USES_TYPE", "Function", x] = used.where(F.col("label") == x).select("src", "dst", "position")
    return stubs
