"""Fields of types by language, and as JSON on the types of a graph."""

import json

import pytest

from loomgraph.plans import codegraph
from loomgraph.sources import extract as X
from loomgraph.sources.braced import braces

PYTHON = '''class A(B):
    LIMIT = 3
    x: "list[int]" = [1,  2]
    y = z = 1
    only: int
    _own = "é" * 200
    a, b = 1, 2

    def __init__(self, n):
        self.n = n
        if n:
            self.late: int = 5
            self.p = self.q = "r"
        self.x = 0
        self.deep.er = 1
        other.k = 1

    def set(self):
        self.never = 1

    class Inner:
        __slots__ = ()
'''
BRACES = {
    "rust": ("pub struct P<'a> { #[serde(default)] pub x: &'a str, pub(crate) m: HashMap<String, Vec<u8>>, n: [u8; 4] }\nstruct U;\nstruct T(u8, u8);\nenum E { A { x: u8 }, B }\nimpl P { fn f() { let q: u8 = 1; } }", {
        "m::P": [("x", "&'a str", "pub", None), ("m", "HashMap<String, Vec<u8>>", "pub(crate)", None), ("n", "[u8; 4]", "private", None)]}),
    "go": ("package m\ntype A struct {\n\tX, y int `json:\"x\"`\n\t*pkg.T\n\tBase\n\tM map[string]int // c\n\tf func(a int) error\n}\ntype I interface {\n\tGo() int\n}\n", {
        "m.A": [("X", "int", "exported", None), ("y", "int", "unexported", None), ("pkg.T", "*pkg.T", "unexported", None), ("Base", "Base", "exported", None), ("M", "map[string]int", "exported", None), ("f", "func(a int) error", "unexported", None)]}),
    "java": ("public class A {\n  public static final int MAX = 3;\n  @Inject private Map<String, Integer> m = new HashMap<>();\n  int a = 1, b;\n  abstract void none();\n  int go() { int local = 1; return local; }\n  enum K { ONE, TWO; int v; }\n}\n", {
        "m.A": [("m", "Map<String, Integer>", "private", "new HashMap<>()"), ("a", "int", "package-private", "1"), ("b", "int", "package-private", None)]}),
    "csharp": ("class A {\n  const int C = 1;\n  static readonly int D = 2;\n  [Attr] private readonly List<int> xs = new List<int>();\n  public string Name { get; set; }\n  int Twice => 2;\n  void Go() { int x = 1; }\n}\n", {
        "m.A": [("xs", "List<int>", "private", "new List<int>()"), ("Name", "string", "public", None), ("Twice", "int", "private", None)]}),
    "cpp": ("class A : public B {\n  int hidden;\npublic:\n  int x = 3, y;\n  std::vector<int> v;\n  const char *p;\n  int arr[3];\n  void f();\n  int g() { int local; return 1; }\nprotected:\n  unsigned bits : 3;\n};\nstruct S { double d; };\n", {
        "m::A": [("hidden", "int", "private", None), ("x", "int", "public", None), ("y", "int", "public", None), ("v", "std::vector<int>", "public", None), ("p", "char", "public", None), ("arr", "int", "public", None), ("bits", "unsigned", "protected", None)],
        "m::S": [("d", "double", "public", None)]}),
    "typescript": ("export class Box {\n  private n?: number = 1\n  static x = 'a'\n  protected readonly z: Map<string, number>;\n  @In() q: string\n  run = async (a) => { return { b: 1 } }\n  area(w: number): number { const k = 1; return k }\n  abstract none(): void;\n  constructor(private w: number) {}\n}\ninterface I { a: string }\n", {
        "m.Box": [("n", "number", "private", "1"), ("x", None, "private", "'a'"), ("z", "Map<string, number>", "protected", None), ("q", "string", "private", None), ("run", None, "private", "async (a) => { return { b: 1 } }")]}),
    "dart": ("class A {\n  final int n;\n  String? _s = 'x';\n  static const limit = 3;\n  late Map<String, int> m;\n  A(this.n);\n  int go() { var q = 1; return q; }\n}\n", {
        "m.A": [("n", "int", "public", None), ("_s", "String?", "private", "'x'"), ("limit", None, "public", "3"), ("m", "Map<String, int>", "public", None)]}),
}


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        out.setdefault(r["owner"], []).append((r["name"], r["type"], r["visibility"], r["default"]))
    return out


def test_python():
    rows = X.python("a.py", PYTHON, "p")["fields"]
    assert told(rows) == {
        "p.a.A": [
            ("x", '"list[int]"', "public", "[1,  2]"), ("y", None, "public", "z = 1"), ("only", "int", "public", None), ("_own", None, "private", '"é" * 200'),
            ("n", None, "public", "n"), ("late", None, "public", "5"), ("p", None, "public", 'self.q = "r"'), ("q", None, "public", '"r"'),
        ],
        "p.a.A.Inner": [("__slots__", None, "public", "()")],
    }
    assert {r["name"]: r["line"] for r in rows}["p"] == 13


@pytest.mark.parametrize("language", BRACES)
def test_braces(language):
    text, expected = BRACES[language]
    assert told(braces("m", text, "m", language)["fields"]) == expected


def test_long_default_is_cut():
    rows = X.python("a.py", "class A:\n    x = '" + "é" * 300 + "'\n", "p")["fields"]
    assert len(rows[0]["default"]) == 100


def test_graph(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text(PYTHON)
    (root / "b.go").write_text(BRACES["go"][0])
    (root / "c.py").write_text("class None_:\n    pass\n")
    g = codegraph.build(spark, str(root), docs=False)
    fields = {r.title: r.fields for x in ("Class", "Struct") for r in g.nodes(x).where("NOT coalesce(is_external, false)" if x == "Class" else "true").collect()}
    assert [(f["name"], f["type"], f["visibility"], f["default"]) for f in json.loads(fields["A"])][:2] in ([("x", '"list[int]"', "public", "[1,  2]"), ("y", None, "public", "z = 1")], [("X", "int", "exported", None), ("y", "int", "unexported", None)])
    assert fields["None_"] is None and json.loads(fields["Inner"]) == [{"name": "__slots__", "type": None, "visibility": "public", "default": "()"}]
