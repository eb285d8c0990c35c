"""Graph procedures: functions of a graph that give DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import revisions
from loomgraph.operators.graph import PropertyGraph

#: Edge types whose target is in use.
USES = ("CALLS", "REFERENCES_FN", "HANDLES", "IMPLEMENTED_BY")


def _any(g: PropertyGraph, column: str, types: tuple[str, ...], dst: str | None = None) -> DataFrame | None:
    keys = [k for k in g.keys(types) if dst is None or k[2] == dst]
    return G.union_all([g.edge_tables[k].select(F.col(column).alias("id")) for k in keys]) if keys else None


def dead_code(g: PropertyGraph, exclude_public: bool = False) -> DataFrame:
    """Functions that nothing calls, passes on, routes to or implements; decorated ones, tests, `main` and dunder names are in use."""
    f = g.nodes("Function")
    for used in (_any(g, "dst", USES, "Function"), _any(g, "src", ("DECORATES",)), _any(g, "dst", ("DECORATES",))):
        if used is not None:
            f = f.join(used, "id", "left_anti")
    f = f.where("title <> 'main' AND NOT (startswith(title, '__') AND endswith(title, '__'))")
    if "is_test" in f.columns:
        f = f.where("NOT coalesce(is_test, false)")
    if "decorators" in f.columns:
        f = f.where("coalesce(size(decorators), 0) <= 0")
    if exclude_public and "visibility" in f.columns:
        f = f.where("NOT visibility <=> 'public'")
    return f


def affected_tests(g: PropertyGraph, files: list[str], max_hops: int | None = None) -> DataFrame:
    """test_file: test files that import one of the files, directly or through any number of others (or max_hops). A file is given by a suffix of its path."""
    nodes = g.nodes("File")
    hit = F.lit(False)
    for x in files:
        hit = hit | (F.col("id") == x) | F.col("id").endswith("/" + x)
    imports = g.edge_tables[("IMPORTS", "File", "File")].select("src", "dst")
    found = G.reach(imports, nodes.where(hit).select("id"), max_hops, reverse=True, include_seeds=True)
    return found.join(nodes.where("is_test").select("id"), "id").select(F.col("id").alias("test_file"))


def rev_diff(g: PropertyGraph, **args) -> DataFrame:
    """bucket and the node's columns between two revisions, of one node type or all."""
    merged = g.nodes(args.get("node_type"))
    return revisions.rev_diff(merged, args["from"], args["to"]).withColumn("type", F.col("label"))


def function_metrics(g: PropertyGraph) -> DataFrame:
    wanted = [c for c in ("file_path", "id", "title", "line_number", "end_line", "branch_count", "param_count", "max_nesting", "is_recursive") if c in g.nodes("Function").columns]
    return g.nodes("Function").select(*wanted).orderBy(*(c for c in ("file_path", "id", "line_number") if c in wanted))


def dump_calls(g: PropertyGraph, names: list[str]) -> DataFrame:
    """CALLS whose callee has one of the short names."""
    calls, f = g.edge_tables[("CALLS", "Function", "Function")], g.nodes("Function").select(F.col("id").alias("dst"), "title")
    return calls.join(f.where(F.col("title").isin(list(names))), "dst")


def find(g: PropertyGraph, name: str) -> DataFrame:
    """Nodes of any label by id or title."""
    return G.union_all([t.select(F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title"), F.lit(x).alias("label")) for x, t in sorted(g.node_tables.items()) if "title" in t.columns]).where((F.col("title") == name) | (F.col("id") == name))


def explore(g: PropertyGraph, name: str, max_entities: int = 10, max_depth: int = 1) -> str:
    """A report on the nodes of a name and what is near them, in Markdown. HTML elements are no entry points."""
    starts = find(g, name).where("label NOT IN ('Element', 'Selector')").orderBy("label", "id").limit(max_entities).collect()
    edges = G.union_all([t.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(k[0]).alias("type")) for k, t in sorted(g.edge_tables.items())])
    lines = [f"# {name}"]
    for s in starts:
        lines.append(f"## {s.label} {s.id}")
        seeds = g.node_tables[s.label].sparkSession.createDataFrame([(s.id,)], "id string")
        for title, back in (("leads to", False), ("comes from", True)):
            near = G.reach(edges.select("src", "dst"), seeds, max_depth, reverse=back).orderBy("hops", "id").limit(max_entities).collect()
            lines += [f"- {title} `{r.id}` ({r.hops})" for r in near]
    return "\n".join(lines)


def accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall of found (src, dst) against labelled edges of sources that have labels."""
    found = found.select("src", "dst").distinct().join(truth.select("src").distinct(), "src")
    truth = truth.select("src", "dst").distinct()
    hit = found.join(truth, ["src", "dst"]).agg(F.count("*").alias("hit"))
    n, m = found.agg(F.count("*").alias("n")), truth.agg(F.count("*").alias("m"))
    return hit.crossJoin(n).crossJoin(m).select((F.col("hit") / F.nullif("n", F.lit(0))).alias("precision"), (F.col("hit") / F.nullif("m", F.lit(0))).alias("recall"))  # three rows of one number


def call(g: PropertyGraph, name: str, args: dict) -> DataFrame:
    if name in ("refresh_stats", "label_pair_counts"):
        return g.label_pair_counts()
    if name == "db.schema.relTypeProperties":
        rows = [(t, c, k) for (t, _, _), table in sorted(g.edge_tables.items()) for c, k in table.dtypes if c not in ("src", "dst")]
        spark = next(iter(g.edge_tables.values())).sparkSession
        return spark.createDataFrame(sorted(set(rows)), "relType string, propertyName string, propertyTypes string")
    known = {"dead_code": dead_code, "affected_tests": affected_tests, "rev_diff": rev_diff, "function_metrics": function_metrics, "dump_calls": dump_calls}
    if name not in known:
        raise ValueError(f"no procedure {name}; there are {sorted([*known, 'refresh_stats', 'db.schema.relTypeProperties'])}")
    return known[name](g, **args)
