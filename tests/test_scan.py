"""The scan for many names against a plain search, and the types that annotations use."""

import random
import re

from loomgraph.operators.scan import Automaton, scan
from loomgraph.plans import codegraph


def plain(text, names, bounded=True):
    out, at = [], 0
    while at < len(text):
        hit = max((n for n in names if n and text.startswith(n, at)), key=len, default=None)
        if hit is None:
            at += 1
            continue
        end = at + len(hit)
        word = lambda c: re.fullmatch("[A-Za-z0-9_]", c)
        if not bounded or not (at and word(text[at - 1]) or end < len(text) and word(text[end])):
            out.append((at, end, hit))
        at = end
    return out


def test_automaton():
    r = random.Random(2)
    for _ in range(300):
        names = list({"".join(r.choice("ab_ ") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 9))})
        text = "".join(r.choice("ab_ ") for _ in range(60))
        want = [(i, i + max(len(n) for n in names if text.startswith(n, i))) for i in range(60) if any(text.startswith(n, i) for n in names)]
        assert Automaton(names).longest(text) == want


def test_scan(spark):
    r = random.Random(3)
    names = ["Foo", "Foo::Bar", "Bar", "Bar Baz", "Baz", "o", "List<Int>", "Int", "Größe", "a_b", None, "", "Foo"]
    parts = ["Foo", "::", "Bar", " ", "Baz", "o", "List<", "Int", ">", "Größe", "a_b", "x", "_", "9", "é"]
    texts = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 14)))) for i in range(300)] + [(300, None), (301, "Foo " * 20_000), (-1, "xFoo::Bar Baz")]
    df, known = spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([(n,) for n in names], "title string")
    for bounded, block in ((True, 50_000), (True, 2), (False, 3)):
        got = {}
        for row in scan(df, "id", "body", known, "title", bounded, block).collect():
            got.setdefault(row.id, []).append((row.start, row.end, row.title))
        for i, text in texts:
            assert sorted(got.get(i, [])) == plain(text or "", [n for n in names if n], bounded), (i, text)
    assert scan(df.limit(0), "id", "body", known, "title").count() == 0 and scan(df, "id", "body", known.limit(0), "title").count() == 0


def test_uses_type(spark):
    """Receiver, parameter, return, both, and the signature where no parameter is annotated; the longest name wins, and of equal names an interface."""
    parameter = lambda t, kind="positional": (kind, t)
    rows = [
        ("f1", [parameter("*Call", "receiver")], None, "func (c *Call) lock()"),
        ("f2", [parameter("Map<Call, Wide::Call>")], "Shape", "s"),
        ("f3", [parameter("Call", "receiver"), parameter(None)], "Call", "s"),
        ("f4", [parameter(None)], None, "fn f4(c: Call, s: MyShape) -> X"),
        ("f5", [parameter("Recall"), parameter("T")], "Call_", "Call"),
        ("f6", [], "", ""),
    ]
    functions = spark.createDataFrame([(a, [(k, t) for k, t in p], r, s) for a, p, r, s in rows], "id string, parameters array<struct<kind:string,type_annotation:string>>, return_type string, signature string")
    typed = spark.createDataFrame([("a.Call", "Call", "Class"), ("b.Call", "Call", "Struct"), ("a.Wide", "Wide::Call", "Class"), ("z.Shape", "Shape", "Class"), ("b.Shape", "Shape", "Trait"), ("a.T", "T", "Class")], "id string, title string, label string")
    got = {tuple(r) for r in codegraph.uses_type(functions, typed).collect()}
    assert got == {("f1", "b.Call", "Struct", "receiver"), ("f2", "b.Call", "Struct", "parameter"), ("f2", "a.Wide", "Class", "parameter"), ("f2", "b.Shape", "Trait", "return"), ("f3", "b.Call", "Struct", "both"), ("f4", "b.Call", "Struct", "signature")}
