"""Documents: heads, outlines, each strategy of mentions, links by unique file names."""

import json

import pytest

from loomgraph.plans import codegraph
from loomgraph.sources import docs as D

RST = "=====\nWhole\n=====\n\nPart\n----\n\nOver\n~~~~\nDeep\n~~\n\nNext\n----\n\n Indented\n--------\nShort\n---\nWhole2\n=======\n\n:py:meth:`~pkg.core.Set.mean`, :func:`text <free_one>`, :ref:`Set`, ``Set.total`` and :doc:`/docs/guide`, :doc:`home <guide>`.\n"
MD = "---\ntitle: Named\ntags: [a, 'b, c']\nnested:\n  deep: 1\n  list:\n    - x\n    - true\nempty:\nkind: howto\n---\n# One\r\n```\n# fenced `lone_helper` [x](a/only.py)\n```\n## Two ##\n#three\n#\n ~~~\n# no\n ~~~\n  ### In\n`pkg.core.Set.mean` [a](only.py) [b](../x/twin.py) ![i](only.py) [m](Guide2.MD#part) [h](https://x.org/only.py) [self](guide.md) [top](/README.md \"t\")\n"


def docs_of(spark, **texts):
    return spark.createDataFrame([(n, f"docs/{n}.{n.split('_')[0]}", n.split("_")[0], "doc", n, t) for n, t in texts.items()], "id string, path string, ext string, kind string, title string, text string")


def test_outline(spark):
    found = {}
    for r in D.outline(docs_of(spark, md_a=MD, rst_a=RST, md_long="# h\n" * 100, md_none="", rst_none="x")).collect():
        found.setdefault(r.id, []).append((r.position, r.level, r.heading))
    assert sorted(found["md_a"]) == [(1, 1, "One"), (2, 2, "Two ##"), (3, 1, "three"), (4, 3, "In")]
    # a title ruled on both sides is a style of its own; "Short" has a rule that is too short, an indented line is no title
    assert sorted(found["rst_a"]) == [(1, 1, "Whole"), (2, 2, "Part"), (3, 3, "Over"), (4, 2, "Next"), (5, 4, "Whole2")]
    assert len(found["md_long"]) == 64 and set(found) == {"md_a", "rst_a", "md_long"}


def test_heads(spark):
    assert D.frontmatter("a: 'x: y'\nb: [1, two, {k: null}]\nc: 1.5 # note\nd:\n  e: f\ng: |\n  one\n  two\nh: ~\n# no\ni: true\nj:\n- p\n- q\nk: 3") == {
        "a": "x: y", "b": '[1,"two",{"k":null}]', "c": "1.5", "d": '{"e":"f"}', "g": "one\ntwo", "i": "true", "j": '["p","q"]', "k": "3"}
    assert D.frontmatter("") == {} and D.frontmatter("- a\n- b") == {} and D.frontmatter("just text") == {}
    rows = {r.id: r for r in D.nodes(docs_of(spark, md_a=MD, rst_a=RST, md_b="no head\n---\nx: 1\n---\n")).collect()}
    a = rows["md_a"]
    assert (a.title, a.tags, a.meta_kind, a.kind, json.loads(a.nested)) == ("Named", '["a","b, c"]', "howto", "doc", {"deep": 1, "list": ["x", True]})
    assert json.loads(a.headings) == ["One", "Two ##", "three", "In"] and rows["md_b"].headings is None and rows["md_b"].tags is None
    assert rows["rst_a"].title == "Whole" and "empty" not in a.asDict()


def test_too_many_keys(spark):
    spark.conf.set("spark.sql.pivotMaxValues", 2)
    try:
        with pytest.raises(ValueError):
            D.nodes(docs_of(spark, md_a="---\na: 1\nb: 2\nc: 3\n---\n"))
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


SYMBOLS = [
    ("pkg.core.Set", "Set", "Class"), ("pkg.core.Set.mean", "mean", "Function"), ("pkg.other.Bag.mean", "mean", "Function"), ("pkg.other.Bag", "Bag", "Class"),
    ("pkg.top.mean", "mean", "Function"), ("pkg.core.Set.total", "total", "Function"), ("crate::net::Conn::open_all", "open_all", "Function"), ("crate::net::Conn", "Conn", "Struct"),
    ("a.twice", "twice", "Function"), ("b.twice", "twice", "Function"), ("pkg.free_one", "free_one", "Function"), ("pkg.core._private", "_private", "Function"), ("pkg.config", "config", "Constant"),
    ("pkg.x.Proto", "Proto", "Protocol"), ("pkg.core.Set.lone", "lone", "Function"),
]


def plain(token, strong):
    """The strategies one after the other, over all symbols."""
    import re

    labels = D.SYMBOL_LABELS
    known = [s for s in SYMBOLS if s[2] in labels]
    cut = lambda q: re.split(r"::|\.", q)
    for s in sorted(known, key=lambda s: labels.index(s[2])):
        if s[0] == token:
            return s[0], "exact"
    segs = cut(token)
    last = segs[-1]
    if not strong or len(last) < 3 or last[0] == "_" or last.lower() in D.STOP_WORDS:
        return None
    same = [s for s in known if s[1] == last]
    if len(segs) > 1:
        hits = [s for s in same if cut(s[0])[-len(segs) :] == segs]
        if len(hits) == 1:
            return hits[0][0], "suffix"
        if len(same) == 1:
            return same[0][0], "name"
    types = {s[0] for s in known if s[2] in D.CONTAINER_LABELS}
    free = [s for s in same if re.sub(r"(?:::|\.)[^.:]*$", "", s[0]) not in types]
    return (free[0][0], "module_level") if len(free) == 1 else None


def test_mentions_against_the_rules_one_by_one(spark):
    tokens = ["pkg.core.Set.mean", "Set.mean", "core.Set.mean", "Bag::mean", "mean", "x.mean", "Nope.total", "total", "Conn::open_all", "net.Conn.open_all", "open_all", "twice", "a.twice", "z.twice", "free_one", "q.free_one",
              "_private", "core._private", "pkg.core._private", "config", "x.config", "pkg.config", "Proto", "Set", "lone", "Set.lone", "ab", "missing", "mean.Set"]
    rows = [(f"{t}|{s}", t, s) for t in tokens for s in (True, False)]
    found = spark.createDataFrame(rows, "id string, token string, strong boolean")
    got = {}
    for strong in (True, False):
        told = D.resolve_mentions(found.where(found.strong == strong), spark.createDataFrame(SYMBOLS * 2, "id string, title string, label string"))
        got |= {r.src: (r.dst, r.strategy) for r in told.collect()}
    assert got == {i: w for i, t, s in rows if (w := plain(t, s))}
    assert {w[1] for w in got.values()} == {"exact", "suffix", "name", "module_level"}


def test_candidates(spark):
    text = MD + "`Set.mean()` ``two`` `3x` net::Conn in prose, plain.name not\n"
    got = {(r.id, r.token, r.strong) for r in D.mentions(docs_of(spark, md_a=text, rst_a=RST)).collect()}
    assert got == {("md_a", "pkg.core.Set.mean", True), ("md_a", "Set.mean", True), ("md_a", "two", True), ("md_a", "net::Conn", False),
                   ("rst_a", "pkg.core.Set.mean", True), ("rst_a", "free_one", True), ("rst_a", "Set.total", True)}


def test_links(spark, tmp_path):
    root = tmp_path / "proj"
    for name, text in {"docs/guide.mdx": MD, "docs/Guide2.md": "x", "docs/deep/in.rst": RST, "README.md": "# Top\n", "x/only.py": "A = 1\n", "x/twin.py": "", "y/twin.py": "",
                       "pkg/core.py": "class Set:\n    def mean(self):\n        return 1\n\n    def total(self):\n        return 1\n", "pkg/free.py": "def free_one():\n    return 1\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    g = codegraph.build(spark, str(root))
    assert {(r.src, r.dst) for r in g.edge_tables["DOCUMENTS", "Doc", "Doc"].collect()} == {("docs/guide", "docs/Guide2"), ("docs/guide", "README"), ("docs/deep/in", "docs/guide")}
    assert {(r.src, r.dst) for r in g.edge_tables["DOCUMENTS", "Doc", "File"].collect()} == {("docs/guide", "x/only.py")}
    told = {(r.src, r.dst, r.strategy) for r in g.edge_tables["MENTIONS", "Doc", "Function"].collect()}
    assert ("docs/deep/in", "proj.pkg.free.free_one", "module_level") in told and ("docs/deep/in", "proj.pkg.core.Set.total", "suffix") in told
    assert g.nodes("Doc").where("id = 'docs/guide'").first().title == "Named"
