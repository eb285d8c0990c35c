"""Graphs of several git revisions in one."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import revisions as V
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans import codegraph
from loomgraph.sources import files as S

#: Fields whose change counts, by label. Line numbers alone don't; the number of lines does.
FIELDS = {"Function": ["signature", "loc_span", "branch_count", "max_nesting", "docstring"], "Class": ["kind", "loc_span"], "Constant": ["value_preview"], "File": ["loc"]}


def build_revisions(spark: SparkSession, repo: str, revs: list[str], into: str | None = None) -> PropertyGraph:
    """One graph of the revisions, oldest first; each node and edge has `revs`, nodes also `rev_fp`. Repeated revisions count once."""
    into = into or tempfile.mkdtemp(prefix="loomgraph-revs-")
    revs = list(dict.fromkeys(revs))
    built = [(r, codegraph.build(spark, S.snapshot(repo, r, into))) for r in revs]
    nodes, edges = {}, {}
    for label in sorted({x for _, g in built for x in g.node_tables}):
        tables = [(r, g.node_tables[label]) for r, g in built if label in g.node_tables]
        if label in ("Function", "Class"):
            tables = [(r, t.withColumn("loc_span", F.col("end_line") - F.col("line_number"))) for r, t in tables]
        nodes[label] = V.merge_nodes(tables, ["id"], FIELDS.get(label, []))
    for key in sorted({k for _, g in built for k in g.edge_tables}):
        tables = [(r, g.edge_tables[key].withColumn("type", F.lit(key[0]))) for r, g in built if key in g.edge_tables]
        edges[key] = V.merge_edges(tables).drop("type")
    return PropertyGraph(nodes, edges)
