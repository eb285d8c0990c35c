"""Tiers told by counts against tiers told by all candidates."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resolve as R
from loomgraph.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(4))
def test_counts_and_candidates_agree(spark, seed):
    r = random.Random(seed)
    some = lambda n: r.choice([None, *range(n)])
    sites = spark.createDataFrame([(r.randrange(60), some(9), some(3), some(4), some(2)) for _ in range(80)], "site long, name long, a int, b int, c int")
    definitions = spark.createDataFrame([(i % 55, some(9), some(3), some(4), some(2)) for i in range(60)], "target long, name long, a int, b int, c int")
    pairs = sites.join(definitions.withColumnsRenamed({x: f"{x}2" for x in "abc"}), "name")
    want = R.tiered_narrow(pairs, ["site"], [(f"same_{x}", F.col(x) == F.col(f"{x}2")) for x in "abc"], 4)
    got = R.tiered_match(sites, definitions, ["site"], "name", [(f"same_{x}", x) for x in "abc"], 4)
    columns = ["site", "name", "a", "b", "c", "target", "tier", "candidates"]
    rows = sorted(map(repr, got.select(columns).collect()))
    assert rows == sorted(map(repr, want.select(columns).collect())) and len(rows) > 10


def join_rows(df):
    """Rows that each join of the plan made when df ran."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
        made = [plan.metrics().apply("numOutputRows").value()] if "Join" in name and plan.metrics().contains("numOutputRows") else []
        return made + [n for x in inner for n in walk(x)]

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_not_every_candidate_is_joined(spark, tmp_path):
    """Sites and definitions grow together, so there are as many candidates as the product of both by 50."""
    spark.range(3000).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1000).selectExpr("id AS s_suppkey", "CAST(id % 7 AS INT) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    os.symlink(f"{DIR}/nation.parquet", tmp_path / "nation.parquet")
    df = catalog.queries()["tiered_resolution"](spark, str(tmp_path))
    made = join_rows(df)
    assert made and max(made) <= 5 * 3000 < 3000 * 1000 // 50 and df.count() > 0
