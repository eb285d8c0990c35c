"""A small tree of our own, with hand-labelled edges."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import procedures
from loomgraph.plans import codegraph, cypher

TREE = {
    "shop/__init__.py": "",
    "shop/_hidden/__init__.py": "def inner():\n    return 1\n",
    "shop/util.py": "RATE = 3\n\n\ndef helper(x):\n    # TODO: round\n    return x * RATE\n\n\ndef orphan():\n    return helper(1)\n",
    "shop/base.py": "class Base:\n    def save(self):\n        return self.check()\n\n    def check(self):\n        return True\n\n\nclass Other:\n    def save(self):\n        return 1\n",
    "shop/item.py": "from .base import Base\nfrom shop.util import helper\n\n\nclass Item(Base):\n    def price(self, owner: Base) -> Base:\n        if owner:\n            for _ in range(3):\n                helper(2)\n        self.save()\n        return run(helper)\n\n\ndef run(f):\n    return f(run)\n",
    "shop/web.py": "from flask import Flask\n\napp = Flask('x')\n\n\n@app.route('/items/<id>', methods=['GET', 'POST'])\ndef show(id):\n    '''@procedure: SHOW'''\n    return run(id)\n",
    "tests/test_item.py": "from shop.item import Item\n\n\ndef test_price():\n    assert Item().price(1)\n",
    "web/client.ts": "import { fmt } from './lib/fmt';\nexport function load(id) {\n  if (id) { return fetch('/items/' ); }\n  return fmt(id);\n}\nexport function send() {\n  return fetch('/items/7');\n}\n",
    "web/lib/fmt.ts": "export interface Shape {}\nexport class Box implements Shape {\n  area() { return fmt(1); }\n}\nexport function fmt(x) { return x; }\n",
    "web/index.html": "<html><head><link href='style.css'><script>function go() { return fmt(2); }</script></head><body><h1>Hello you</h1><form action='/x'><input id='q'></form></body></html>",
    "web/style.css": ":root { --main: red; }\n.a, .b { color: var(--main); }\n",
    "web/big.min.js": "x" * 3000,
    "asm/main.agc": "START  CA  COUNT\n       TC  SUB\n       XCH COUNT\n       TCF START\nSUB    BZF START\n       TC  Q\nCOUNT  ERASE\nALIAS  EQUALS COUNT\nWHERE  CADR SUB\nLOST   CADR NOWHERE\n",
    "node_modules/skip.js": "function skipped() {}",
    "README.md": "# Shop\n\nSee `helper` and `shop.item.Item`, [guide](docs/guide.md), [util](shop/util.py).\n\n```\n# no heading\n```\n## Use\n",
    "docs/guide.md": "# Guide\nBack to [home](../README.md).\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "proj"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return codegraph.build(spark, str(root))


def pairs(graph, *types):
    return {(r.src, r.dst) for r in graph.pairs(*types).collect()}


def test_files(graph):
    files = {r.id: r for r in graph.nodes("File").collect()}
    assert "node_modules/skip.js" not in files and files["web/big.min.js"].skip_reason == "generated"
    assert {"shop/__init__.py", "shop/_hidden/__init__.py"} <= set(files) and graph.nodes("Function").where("id = 'proj.shop._hidden.inner'").count() == 1
    assert files["tests/test_item.py"].is_test and files["shop/util.py"].loc == 10 and files["shop/util.py"].annotation_count == 1


def test_calls(graph):
    found = {(a.rsplit(".", 2)[-2] + "." + a.rsplit(".", 1)[-1] if "." in a else a, b.rsplit(".", 1)[-1]) for a, b in pairs(graph, "CALLS")}
    assert {("util.orphan", "helper"), ("Item.price", "helper"), ("Item.price", "run"), ("Base.save", "check"), ("web.show", "run")} <= found
    p = "proj.shop."
    rows = {(r.src, r.dst): r for r in graph.edges(("CALLS",)).collect()}
    assert rows[p + "item.Item.price", p + "base.Base.save"].resolution == "inherited" and (p + "item.Item.price", p + "base.Other.save") not in rows
    assert rows[p + "item.Item.price", p + "util.helper"].import_backed and rows[p + "item.Item.price", p + "util.helper"].call_lines == "9"
    assert not any(a == b for a, b in rows)
    recursive = {r.id for r in graph.nodes("Function").where("is_recursive").collect()}
    assert recursive <= {"START"} | {r for r in recursive if r.endswith("run")}
    stats = {r.outcome: r.n for r in graph.call_stats.collect()}
    assert stats["total"] == sum(stats[k] for k in ("excluded", "resolved", "no_candidate", "ambiguous"))


def test_imports_and_types(graph):
    assert {("shop/item.py", "shop/base.py"), ("shop/item.py", "shop/util.py"), ("tests/test_item.py", "shop/item.py"), ("web/client.ts", "web/lib/fmt.ts"), ("web/index.html", "web/style.css")} == {(r.src, r.dst) for r in graph.edge_tables["IMPORTS", "File", "File"].collect()}
    assert {("shop/item.py", "proj.shop.base"), ("shop/item.py", "proj.shop.util"), ("tests/test_item.py", "proj.shop.item"), ("web/client.ts", "proj.web.lib.fmt"), ("web/index.html", "proj.web.style")} == {(r.src, r.dst) for r in graph.edge_tables["IMPORTS", "File", "Module"].collect()}
    assert ("proj.shop.item.Item", "proj.shop.base.Base") in pairs(graph, "EXTENDS") and ("proj.web.lib.fmt.Box", "proj.web.lib.fmt.Shape") in pairs(graph, "IMPLEMENTS")
    assert ("proj.shop.base.Base", "proj.shop.base.Base.save") in pairs(graph, "HAS_METHOD")
    assert [r.position for r in graph.edges(("USES_TYPE",)).where("src LIKE '%price'").collect()] == ["both"]
    assert ("proj.shop.util.helper", "proj.shop.util.RATE") in pairs(graph, "REFERENCES") and ("proj.shop.item.Item.price", "proj.shop.util.helper") in pairs(graph, "REFERENCES_FN")


def test_routes_docs_and_markup(graph):
    assert {r.id for r in graph.nodes("Route").collect()} == {f"flask::{m}::/items/<id>::shop/web.py" for m in ("GET", "POST")}
    assert {a for a, _ in pairs(graph, "CALLS_SERVICE")} == {"proj.web.client.send"}
    assert pairs(graph, "IMPLEMENTED_BY") == {("SHOW", "proj.shop.web.show")}
    assert {("README", "proj.shop.util.helper"), ("README", "proj.shop.item.Item")} & pairs(graph, "MENTIONS") and pairs(graph, "DOCUMENTS") == {("README", "docs/guide"), ("README", "shop/util.py"), ("docs/guide", "README")}
    assert {r.tag for r in graph.nodes("Element").collect()} == {"h1", "form", "input"} and graph.nodes("Selector").count() == 2
    assert pairs(graph, "JUMPS_TO") == {("START", "START")} and pairs(graph, "BRANCHES_TO") == {("SUB", "START")}


def test_assembly(graph):
    """Calls by full name, typed references, aliases and pointers; a return through a register is no call."""
    edge, = graph.edges(("CALLS",)).where("src = 'START'").collect()
    assert (edge.dst, edge.call_lines, edge.call_count, edge.resolution) == ("SUB", "2", 1, None)
    use, = graph.edges(("REFERENCES",)).where("dst = 'COUNT'").collect()
    assert (use.src, use.line, use.reference_lines, use.reference_count, use.opcodes) == ("START", 1, "1,3", 2, "CA,XCH")
    assert (use.accesses, use.has_read, use.has_write, use.has_address) == ("read,read_write,write", True, True, False)
    assert pairs(graph, "ALIAS_OF") == {("ALIAS", "COUNT")} and pairs(graph, "POINTS_TO") == {("WHERE", "SUB")}


def test_procedures_and_cypher(graph):
    dead = {r.id.rsplit(".", 1)[-1] for r in procedures.dead_code(graph).collect()}
    assert "orphan" in dead and not {"helper", "show", "test_price"} & dead
    assert {r.test_file for r in procedures.affected_tests(graph, ["util.py"]).collect()} == {"tests/test_item.py"}
    rows = cypher.run(graph, "MATCH (f:Function)<-[r:CALLS]-(c:Function) WHERE f.title = $name AND r.import_backed RETURN c.title AS caller ORDER BY caller", {"name": "helper"}).collect()
    assert [r.caller for r in rows] == ["orphan", "price"]
    rows = cypher.run(graph, "MATCH (file:File)-[:DEFINES]->(f:Function) WHERE NOT EXISTS { (f)<-[:CALLS]-(:Function) } RETURN file.id AS path, count(f) AS c ORDER BY c DESC, path LIMIT 3").collect()
    assert rows and rows[0].c >= 1
    rows = cypher.run(graph, "MATCH (f:Function {title: 'helper'})<-[:CALLS*1..3]-(g:Function) RETURN count(DISTINCT g) AS n").collect()
    assert rows[0].n == 3  # orphan, price, test_price
    p = cypher.run(graph, "MATCH p = (a:Function {title: 'show'})-[:CALLS*1..2]->(b:Function) RETURN length(p) AS n, nodes(p) AS ns").collect()
    assert {r.n for r in p} == {1} and p[0].ns[0]["id"].endswith("show")
    with pytest.raises(cypher.CypherError):
        cypher.run(graph, "MATCH (n:Function) DELETE n")
    with pytest.raises(cypher.CypherError):
        cypher.run(graph, "MATCH (n:Function) WHERE n.title = $missing RETURN n.id")
    assert "proj.shop.util.helper" in procedures.explore(graph, "helper")
    assert cypher.run(graph, "CALL refresh_stats() YIELD edge_type, count").where(F.col("edge_type") == "IMPORTS").first()["count"] == 5
