"""A tree that changes: the graph from kept facts is the graph of a full build, and only changed files are parsed."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import storage
from loomgraph.operators import graph as G
from loomgraph.plans import codegraph
from loomgraph.streaming import watch


def same(a, b):
    tables = lambda g: {("node", k): v for k, v in g.node_tables.items()} | {("edge", *k): v for k, v in g.edge_tables.items()}
    one, two = tables(a), tables(b)
    assert set(one) == set(two)
    for key in one:
        if key[:2] in (("node", "File"), ("node", "Function"), ("node", "Class")) or key[0] == "edge" and key[1] in ("CALLS", "IMPORTS", "EXTENDS", "DEFINES"):
            assert one[key].columns == two[key].columns and G.digest(one[key]).first() == G.digest(two[key]).first(), key


def test_refresh(spark, tmp_path):
    root, kept = tmp_path / "proj", str(tmp_path / "facts")
    root.mkdir()
    write = lambda name, text: (root / name).write_text(text)
    write("a.py", "from b import help_me\n\n\ndef go():\n    return help_me()\n\n\ndef outer(x):\n    if x:\n        def step():\n            return 1\n    else:\n        def step():\n            return 2\n    return step()\n")
    write("b.py", "def help_me():\n    return 1\n")
    write("c.py", "class Old:\n    pass\n")
    write("d.h", "int low(int x) { return x; }\n")
    first = watch.refresh(spark, str(root), None, kept + "1")
    assert {r.title for r in first.nodes("Function").collect()} >= {"go", "help_me", "step"} and first.nodes("Function").where("title = 'step'").count() == 2  # twins in two branches
    write("b.py", "def help_me():\n    return other()\n\n\ndef other():\n    return 2\n")
    write("e.py", "from c2 import New\n\n\nclass More(New):\n    def go(self):\n        return self.stay()\n")
    write("c2.py", "class New:\n    def stay(self):\n        return 1\n")
    (root / "c.py").unlink()
    second = watch.refresh(spark, str(root), kept + "1", kept + "2")
    same(second, codegraph.build(spark, str(root)))
    calls = {(r.src, r.dst) for r in second.pairs("CALLS").collect()}
    assert ("proj.b.help_me", "proj.b.other") in calls and ("proj.a.go", "proj.b.help_me") in calls and not second.nodes("Class").where("title = 'Old'").count()
    # facts that are kept aren't parsed again: what was written into them stays, but for files that changed
    marked = spark.read.parquet(kept + "2").withColumn("loc", F.lit(777).cast("long"))
    marked.write.parquet(kept + "3")
    write("a.py", "def go():\n    return 5\n")
    write("x.cpp", "int up() { return 1; }\n")  # turns d.h into C++
    third = watch.refresh(spark, str(root), kept + "3", kept + "4")
    assert {r.id: r.loc for r in third.nodes("File").collect()} == {"a.py": 2, "b.py": 777, "c2.py": 777, "e.py": 777, "d.h": 1, "x.cpp": 1}
    assert spark.read.parquet(kept + "4").where("path = 'd.h'").first().language == "cpp"


def test_no_scratch_on_one_machine_of_a_cluster():
    session = lambda warehouse: SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, *d: warehouse if k == "spark.sql.warehouse.dir" else None),
        sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)),
    )
    for own in ("file:/home/x", "/home/x"):
        with pytest.raises(ValueError):
            storage.shared_dir(session(own))
    assert storage.shared_dir(session("hdfs://h/w/")) == "hdfs://h/w/.loomgraph-scratch"
