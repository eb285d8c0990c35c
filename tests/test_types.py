"""Bases of types by scope and kind, and edges between Python and Rust."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import codegraph
from loomgraph.plans import types as T

LABELS = ("Class", "Struct", "Interface", "Trait", "Enum")


def plain(source, target, prefers, typed, scope):
    """The best of all types of a name, one by one."""
    best = None
    for i, (q, title, label) in enumerate(sorted(typed, key=lambda t: (t[2] in T.INTERFACES, t[0]))):
        if title == target.split(".")[-1]:
            near = max((len(s) for a, s in scope if a == source and q.startswith(s + ".")), default=0)
            best = max(best or (-1,), (100 * ((label in T.INTERFACES) == prefers) + near, i, q))
    return best and (best[0], best[2])


def test_nearest_types_against_all_candidates(spark):
    r = random.Random(3)
    names = ["a", "b", "core", "a" * 60, "web"]
    path = lambda n: ".".join(r.choice(names) for _ in range(n))
    typed = {f"{path(r.randint(0, 4))}.{t}".lstrip("."): (t, r.choice(LABELS)) for t in ("Base", "Item", "Node") for _ in range(60)}
    typed = [(q, t, label) for q, (t, label) in typed.items()]
    scope = sorted({(f"s{i}", path(r.randint(1, 4))) for i in range(30) for _ in range(6)})
    sites = [(f"s{i}", t, p) for i in range(40) for t in ("Base", "x.Item", "Node", "Missing") for p in (True, False)]
    got = T.nearest_types(spark.createDataFrame(sites, "source string, target string, prefers_interface boolean"), spark.createDataFrame(typed, "id string, title string, label string"), spark.createDataFrame(scope, "source string, scope string"))
    got = {(x.source, x.target, x.prefers_interface): (x.score, x.dst) for x in got.collect()}
    assert got == {s: w for s in sites if (w := plain(*s, typed, scope))} and len(got) == 240


TREE = {
    "one/base.py": "class Base:\n    pass\n", "two/base.py": "class Base:\n    pass\n",
    "two/use.py": "from one.base import Base\n\n\nclass Child(Base):\n    pass\n\n\nclass Odd(Exception):\n    pass\n", "two/near.py": "class Base:\n    pass\n\n\nclass Near(Base):\n    pass\n",
    "A.cs": "namespace Shop { interface IThing { } class Thing : IThing { } interface IMore : IThing { } }\n",
    "ext/src/lib.rs": '#[pyclass(name = "Bag", frozen)]\npub struct PyBag { n: i32 }\n#[pymethods]\nimpl PyBag {\n    #[new]\n    fn new() -> Self { PyBag { n: 0 } }\n    fn add(&self, n: i32) -> i32 { n }\n}\nimpl PyBag { fn hidden(&self) -> i32 { 1 } }\n'
    '#[pyclass]\npub struct Set { n: i32 }\n#[pymethods]\nimpl Set { fn add(&self) -> i32 { 2 } fn twice(&self) -> i32 { 2 } }\n#[pyfunction(name = "run_it")]\nfn run() -> i32 { 1 }\n#[no_mangle]\npub extern "C" fn plain_c() -> i32 { 1 }\n#[pymodule]\nfn native(m: i32) -> i32 { m }\nimpl Display for Set { fn fmt(&self) -> i32 { 1 } }\n',
    "ext/src/more.rs": "#[pyclass]\npub struct Dup { n: i32 }\n#[pymethods]\nimpl Dup { fn same(&self) -> i32 { 1 } }\n", "ext/src/again.rs": "#[pyclass]\npub struct Dup { n: i32 }\n#[pymethods]\nimpl Dup { fn same(&self) -> i32 { 1 } }\n",
    "other/src/lib.rs": "#[pymodule]\nfn lonely(m: i32) -> i32 { m }\n",
    "ext/python/native.py": "class Set:\n    def add(self):\n        ...\n\n    def missing(self):\n        ...\n\n\nclass Dup:\n    def same(self):\n        ...\n\n\nclass PyBag:\n    def hidden(self):\n        ...\n\n\ndef add():\n    ...\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("types") / "proj"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return codegraph.build(spark, str(root))


def tails(graph, kind):
    return {(r.src.replace("::", ".").split(".", 1)[1], r.dst.replace("::", ".").removeprefix("proj.")) for r in graph.pairs(kind).collect()}


def test_bases(graph):
    assert tails(graph, "EXTENDS") >= {("two.use.Child", "one.base.Base"), ("two.near.Near", "two.near.Base"), ("two.use.Odd", "Exception")}
    assert {b.split(".")[-1] for a, b in tails(graph, "IMPLEMENTS") if a.endswith("Thing")} == {"IThing"} and any(a.endswith("IMore") for a, _ in tails(graph, "EXTENDS"))
    assert {r.id for r in graph.nodes("Class").where("is_external").collect()} == {"Exception"} and {r.id for r in graph.nodes("Trait").where("is_external").collect()} == {"Display"}


def test_metadata(graph):
    f = {r.title: r for r in graph.nodes("Function").where("language = 'rust'").collect()}
    assert [(f[n].is_pymethod, f[n].is_ffi, f[n].ffi_kind, f[n].py_name, f[n].is_pymodule) for n in ("new", "hidden", "run", "plain_c", "native")] == [
        (True, True, "pyo3", None, False), (False, False, None, None, False), (True, True, "pyo3", "run_it", False), (False, True, "extern_c", None, False), (False, True, "pyo3", None, True)]
    assert f["twice"].visibility == "pub(py)" and f["hidden"].visibility == "private"
    assert {(r.title, r.is_pyclass, r.py_name) for r in graph.nodes("Struct").where(F.col("title").isin("PyBag", "Set")).collect()} == {("PyBag", True, "Bag"), ("Set", True, None)}


def test_binds_and_exposes(graph):
    assert tails(graph, "BINDS") == {("ext.python.native.Set.add", "ext.src.Set.add")}
    rows = graph.edges(("EXPOSES",)).collect()
    assert {(r.src.split("::")[-1], r.dst.split("::")[-1], r.py_name) for r in rows} == {("native", "PyBag", "Bag"), ("native", "Set", "Set"), ("native", "Dup", "Dup"), ("native", "run", "run_it")}
