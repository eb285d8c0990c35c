"""The property-graph view over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.graph import Lazy, PropertyGraph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, orders and parts; lazily read, so a query scans only what it uses."""
    def node(name: str, key: str, title: str):
        def make() -> DataFrame:
            t = table(spark, sf_dir, name)
            return t.select(F.col(key).cast("long").alias("id"), F.col(title).alias("title"), *[c for c in t.columns if c not in (key, title)])

        return make

    def edge(name: str, src: str, dst: str, distinct: bool = False):
        def make() -> DataFrame:
            e = table(spark, sf_dir, name).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
            return e.distinct() if distinct else e

        return make

    nodes = Lazy(
        Region=node("region", "r_regionkey", "r_name"), Nation=node("nation", "n_nationkey", "n_name"), Customer=node("customer", "c_custkey", "c_name"),
        Supplier=node("supplier", "s_suppkey", "s_name"), Part=node("part", "p_partkey", "p_name"), Order=node("orders", "o_orderkey", "o_orderstatus"),
    )
    edges = Lazy({
        ("IN_REGION", "Nation", "Region"): edge("nation", "n_nationkey", "n_regionkey"), ("IN_NATION", "Customer", "Nation"): edge("customer", "c_custkey", "c_nationkey"),
        ("IN_NATION", "Supplier", "Nation"): edge("supplier", "s_suppkey", "s_nationkey"), ("PLACED", "Customer", "Order"): edge("orders", "o_custkey", "o_orderkey"),
        ("CONTAINS_PART", "Order", "Part"): edge("lineitem", "l_orderkey", "l_partkey", True), ("SUPPLIES", "Supplier", "Part"): edge("lineitem", "l_suppkey", "l_partkey", True),
    })
    return PropertyGraph(nodes, edges)


def purchase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a user's purchase above 100 follows another user's directly, in the order of (ts, event_id). Distinct, no loops.

    The neighbour in a global order is found day by day, with each day's last purchase carried over, so no task sorts all purchases."""
    buys = table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 100").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    inner = buys.withColumn("next", F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id")))
    ends = buys.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    across = ends.withColumn("next", F.lead("first").over(Window.orderBy("day")))  # one row per day
    pairs = inner.select(F.col("user_id").alias("src"), F.col("next").alias("dst")).unionByName(across.select(F.col("last").alias("src"), F.col("next").alias("dst")))
    return pairs.where("dst IS NOT NULL AND src <> dst").distinct()
