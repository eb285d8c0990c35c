"""Every registered query of the engine against its SQL, over the smallest tables; results don't depend on the number of partitions."""

import os

import duckdb
import pytest

from loomgraph.operators import graph as G
from loomgraph.plans import catalog
from loomgraph.plans.tables import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([str(r[i]) if not isinstance(r[i], float) else repr(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    got = catalog.queries()[name](spark, DIR)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", ["tiered_resolution", "keep_last_dedup", "first_candidate", "rev_diff_buckets"])
def test_partitions_dont_matter(spark, name):
    seen = set()
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.add(tuple(G.digest(catalog.queries()[name](spark, DIR)).first()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_all_queries_have_rows_or_sql():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 45
