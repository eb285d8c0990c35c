"""Kernels against plain Python, the store, freshness and the watch stream."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import store
from loomgraph.operators import graph as G
from loomgraph.operators import resolve as R
from loomgraph.operators import revisions as V
from loomgraph.operators.graph import PropertyGraph
from loomgraph.streaming import watch


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def trails_of(pairs, start, most):
    out, now = [], [((), start)]
    for _ in range(most):
        now = [((*used, e), e[1]) for used, at in now for e in pairs if e[0] == at and e not in used]
        out += [(len(used), at) for used, at in now]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_and_trails(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(7), r.randrange(7)) for _ in range(14)})
    e = edges_of(spark, pairs)
    seeds = spark.createDataFrame([(0,)], "id long")
    want = trails_of(pairs, 0, 4)
    least = {}
    for n, at in want:
        least[at] = min(n, least.get(at, n))
    assert {x.id: x.hops for x in G.reach(e, seeds, 4).collect()} == least
    assert sorted((x.hops, x.id) for x in G.trails(e, seeds, 1, 4).collect()) == sorted(want)


def test_closure(spark):
    got = {tuple(r) for r in G.closure(edges_of(spark, [(1, 2), (2, 3), (3, 1), (4, 5)])).collect()}
    assert got == {p for p in itertools.permutations((1, 2, 3), 2)} | {(4, 5)}


def test_tiers(spark):
    rows = [(1, "a", True, True), (1, "b", False, True), (2, "c", False, False), (3, "d", False, False), (3, "e", False, True), (3, "f", False, True), *((4, f"x{i}", False, False) for i in range(6))]
    df = spark.createDataFrame(rows, "site long, target string, near boolean, same boolean")
    got = sorted(tuple(r) for r in R.tiered_narrow(df, ["site"], [("near", F.col("near")), ("same", F.col("same"))], 5).select("site", "target", "tier", "candidates").collect())
    assert got == [(1, "a", "near", 1), (2, "c", "unique_name", 1), (3, "e", "same", 2), (3, "f", "same", 2)]


def test_segments(spark):
    paths = spark.createDataFrame([("/a/1/b",), ("/a",), ("/",), ("/x/y?q=1",)], "p string")
    templates = spark.createDataFrame([("/a/{id}/b",), ("/:k",), ("/<x>/<y>",), ("/a/{id}",)], "t string")
    assert {tuple(r) for r in R.segment_match(paths, "p", templates, "t").select("p", "t").collect()} == {("/a/1/b", "/a/{id}/b"), ("/a", "/:k"), ("/x/y?q=1", "/<x>/<y>")}


def test_revisions(spark):
    one = lambda rows: spark.createDataFrame(rows, "id string, body string")
    m = V.merge_nodes([("v1", one([("foo", "1"), ("gone", "g")])), ("v2", one([("foo", "1"), ("bar", "b")])), ("v3", one([("foo", "2"), ("bar", "b")]))], ["id"], ["body"])
    got = {r.id: r for r in m.collect()}
    assert got["foo"].revs == ["v1", "v2", "v3"] and got["foo"].body == "2" and got["foo"].rev_fp[0] == got["foo"].rev_fp[1] != got["foo"].rev_fp[2]
    assert {(r.id, r.bucket) for r in V.rev_diff(m, "v1", "v3").collect()} == {("foo", "changed"), ("gone", "removed"), ("bar", "added")}
    with pytest.raises(ValueError, match="v1.*v2.*v3"):
        V.rev_diff(m, "v1", "v9", check=True)
    with pytest.raises(ValueError):
        V.rev_diff(one([]), "v1", "v2")


def test_store_and_watch(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    g = PropertyGraph({"File": spark.createDataFrame([("a.py", 'q"\t')], "id string, title string")}, {("IMPORTS", "File", "File"): spark.createDataFrame([], "src string, dst string")})
    at = str(tmp_path / "graph")
    assert watch.status(spark, at)["verdict"] == "missing"
    store.save(spark, g, at, {"source": str(root), "fingerprint": watch.fingerprint(spark, str(root))})
    assert watch.status(spark, at)["verdict"] == "fresh" and store.load(spark, at).nodes("File").count() == 1
    (root / "a.py").write_text("x = 2\n")
    assert watch.status(spark, at)["verdict"] == "stale"
    with pytest.raises(RuntimeError):
        watch.require_fresh(spark, at)
    store.save(spark, g, at, {"source": str(root), "fingerprint": watch.fingerprint(spark, str(root))})
    watch.require_fresh(spark, at)
    with pytest.raises(ValueError):
        store.save(spark, PropertyGraph({"File": g.nodes("File").limit(0)}), str(tmp_path / "empty"))
    assert list(store.as_tsv(g.node_tables["File"])) == ["id\ttitle", 'a.py\tq"\\t'] and list(store.as_csv(g.node_tables["File"]))[1] == 'a.py,"q""\t"'
    seen = []
    for _ in range(2):
        watch.watch(spark, str(root), str(tmp_path / "checkpoint"), lambda b: seen.extend(r.path for r in b.collect())).awaitTermination()
    assert len(seen) == 1 and seen[0].endswith("a.py")
