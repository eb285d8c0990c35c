"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, spread_join, written

#: Edges are written anew each round; twice the logarithm of the longest chain is enough rounds, so this is never reached.
ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's larger (or all its) neighbours to the least of its neighbours and itself. No list of neighbours is built, and those of one node are spread."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = spread_join(both, least, "a")
    if small:  # here a > b: a and each of its smaller neighbours go to the least one
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in any direction, of any type that has an order -> node, root: the least node of each component, for all nodes but the roots.

    Loops and edges with a null end say nothing. No edges: no rows."""
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign or now[0] == 0:
            break
        sign, last = now, edges
        edges = written(_star(_star(edges, False), True), "edges")
        forget(last)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
