"""One file in each brace language: names, owners, parameters, calls, nesting and complexity, with strings and comments full of brackets."""

import pytest

from loomgraph.sources.braced import braces
from loomgraph.sources.lexer import blanked

SOURCES = {}
SOURCES["typescript"] = '''import { a } from './x';
export class Box<T> extends Base<T> implements Shape, Other {
  private n: number = 1
  constructor(private x: number, y?: string) { super(x); this.y = `a ${f(x)} } {` }
  @dec('a') async area(w: number, h: Map<string, number>): Promise<number> {
    if (w > 1) { for (const i of h) { g(i) } } else if (w) { k() }
    return w ? h() : 2
  }
  get size() { return this.n }
}
export const add = (a: number, b: number): number => a + inner(b)
const cb = async x => { switch (x) { case 1: one(); break; default: two() } }
function outer(a) {
  function nested(b) { if (b) return 1; return call2("} {") }
  return [1].map(v => { if (v) { hidden() } return v })
}
interface Shape { area(): number; }
var re = /[{}"]/g; // } comment
'''
SOURCES["rust"] = '''use crate::a::b;
mod sub;
pub struct P<'a> { x: &'a str }
impl<'a, T: Into<String>> Shape for P<'a> where T: Clone {
    /// doc {
    pub fn new(x: &'a str, n: usize) -> Result<Self, Err> {
        let s = r#"} " {"#; let c = '{';
        let v = foo::<u8>(n)?;
        match v { 1 => one(), 2 | 3 => { if n > 1 { two() } } _ => println!("x {}", n) }
        for i in 0..n { while i < 2 { x.go(i); } }
        Ok(v)
    }
    fn me(&mut self, q: Q) { self.me(q) }
}
mod inner { pub fn deep() { /* nested /* comment } */ } */ } }
trait Shape { fn area(&self) -> f64; fn dflt(&self) -> f64 { 1.0 } }
'''
SOURCES["java"] = '''package com.x;
import java.util.List;
public class A<T> extends B<T> implements C, D<T> {
  @Override @Ann(value = "}{") public <U extends T> List<U> go(final Map<String, List<U>> m, int... k) throws X, Y {
    if (m != null && k.length > 0) { for (int i = 0; i < 3; i++) { call(i); } } else if (k == null) { try { a.b(); } catch (E e) { new Foo(1); } }
    switch (k[0]) { case 1: x(); default: y(); }
    String s = """
      } { """;
    do { z(); } while (q());
    return k.length > 1 ? null : list(() -> { if (a) { lam(); } });
  }
  A() { super(); }
  abstract void none();
  enum Kind { ONE, TWO; int v() { return 1; } }
}
'''
SOURCES["go"] = '''package main
import "fmt"
type Server struct { a int }
func (s *Server) Run(ctx context.Context, n, m int) (int, error) {
	if n > 1 { for i := range m { s.step(i) } }
	switch x := n.(type) { case int: fmt.Println(`}`); case string: a() ; default: b() }
	go func() { if true { hidden() } }()
	return 1, nil
}
func add[T any](a T, b ...T) T { return a }
type I interface { Foo() }
'''
SOURCES["cpp"] = '''#include "a.h"
#define X(a) { a
namespace ns {
template <typename T> class Foo : public Base<T>, private Other {
 public:
  Foo(int a) : x_(a), y_{2} { init(a); }
  virtual ~Foo() {}
  std::vector<int> get(const std::string& s, int n = 3) const override { if (n) { return go(s); } return a->b::c(n) ? x : y; }
  int decl(int);
};
}
static inline int helper(struct P *p, void (*cb)(int)) { for (;;) { while (1) { do { p->f(); } while (0); } } switch (a) { case 1: default: break; } auto l = [&](int q) { if (q) { hid(); } }; return R"x(} " {)x"[0]; }
void ns::Foo::out(int z) { helper(0, 0); }
'''
SOURCES["csharp"] = '''using System.Text;
namespace Shop.Core {
  [Attr("}")] public sealed class A<T> : Base, IShape where T : class {
    public int N { get; set; } = 3;
    public A(int x) : base(x) { Init(); }
    public async Task<int> Go(string s, int? k = null) { foreach (var q in s) { if (q > 1 && q < 3) { await X.Y(q); } } var z = @"a ""} {"; return k > 1 ? 1 : 2; }
    int Short(int a) => Calc(a);
  }
  struct P { }
}
'''
SOURCES["swift"] = '''import Foundation
public class A: B, C {
  init(x: Int) { super.init() }
  func go(_ a: Int, with b: [String: Int] = [:]) async throws -> Bool { guard a > 1 else { return false }
    if a > 2 { run(b) }
    return true }
}
extension A { func more() {} }
'''
SOURCES["php"] = '''<?php
namespace Shop\\App;
use Shop\\Core\\Item;
# comment }
abstract class A extends B implements C { 
  public function go(int $a, ?Item $b = null): ?string { if ($a) { foreach ($x as $y) { $this->run($y); Item::make("}"); } } elseif ($b) { f(); } return null; }
}
function top() { return 1; }
'''
SOURCES["dart"] = '''import 'a.dart';
class A<T> extends B<T> with M implements C {
  A(this.x);
  Future<int> go(String s, {int? n}) async { if (n == null) { call(s); } return n ?? 1; }
  int short(int a) => calc(a);
}
void main() { print('}'); }
'''


def facts(language):
    got = braces("p/f", SOURCES[language], "M", language)
    return got, {f["qualified_name"]: f for f in got["functions"]}


def types(f):
    return [(p["name"], p["type_annotation"]) for p in f["parameters"]]


def names(f):
    return [c["name"] for c in f["calls"]]


def test_typescript():
    got, f = facts("typescript")
    assert set(f) == {"M.Box.constructor", "M.Box.area", "M.Box.size", "M.add", "M.cb", "M.outer", "M.outer.nested"}
    area = f["M.Box.area"]
    assert types(area) == [("w", "number"), ("h", "Map<string, number>")] and area["return_type"] == "Promise<number>" and area["is_async"] and area["owner"] == "M.Box"
    assert (area["branch_count"], area["max_nesting"], names(area), area["decorators"], area["line_number"], area["end_line"]) == (4, 2, ["g", "k", "h"], ["dec('a')"], 5, 8)
    assert names(f["M.Box.constructor"]) == ["super", "f"]  # the second one in a template
    assert names(f["M.add"]) == ["inner"] and f["M.add"]["return_type"] == "number" and f["M.cb"]["is_async"] and f["M.cb"]["branch_count"] == 1
    assert names(f["M.outer"]) == ["map"] and f["M.outer"]["branch_count"] == 0 and f["M.outer.nested"]["nesting_depth"] == 1 and f["M.outer.nested"]["branch_count"] == 1
    assert [(c["kind"], c["name"]) for c in got["classes"]] == [("class", "Box"), ("interface", "Shape")]
    assert [(r["relation"], r["target"]) for r in got["relations"]] == [("extends", "Base"), ("implements", "Shape"), ("implements", "Other")]


def test_rust():
    got, f = facts("rust")
    assert set(f) == {"M::P::new", "M::P::me", "M::inner::deep", "M::Shape::dflt"} and got["submodules"] == ["sub"]
    new = f["M::P::new"]
    assert types(new) == [("x", "&'a str"), ("n", "usize")] and new["return_type"] == "Result<Self, Err>" and new["visibility"] == "public"
    assert (new["branch_count"], new["max_nesting"], names(new)) == (7, 2, ["foo", "one", "two", "println!", "x.go", "Ok"])  # ?, three arms, if, for, while
    assert f["M::P::me"]["is_recursive"] and f["M::P::me"]["parameters"][0]["kind"] == "receiver" and f["M::P::me"]["visibility"] == "private"
    assert [(r["source"], r["relation"], r["target"]) for r in got["relations"]] == [("M::P", "implements", "Shape")]


def test_java():
    got, f = facts("java")
    assert set(f) == {"M.A.go", "M.A.A", "M.A.Kind.v"}
    go = f["M.A.go"]
    assert types(go) == [("m", "Map<String, List<U>>"), ("k", "int...")] and go["parameters"][1]["kind"] == "variadic" and go["decorators"] == ["Override", 'Ann(value = "}{")']
    assert (go["branch_count"], go["max_nesting"]) == (8, 3) and names(go) == ["call", "a.b", "Foo", "x", "y", "z", "q", "list"]  # the lambda's own are its own
    assert [(r["relation"], r["target"]) for r in got["relations"]] == [("extends", "B"), ("implements", "C"), ("implements", "D")] and got["imports"][0]["name"] == "java.util.List"


def test_go():
    got, f = facts("go")
    run = f["M.Server.Run"]
    assert types(run) == [("s", "*Server"), ("ctx", "context.Context"), ("n", "int"), ("m", "int")] and run["parameters"][0]["kind"] == "receiver" and run["return_type"] == "(int, error)"
    assert (run["branch_count"], run["max_nesting"], names(run)) == (4, 2, ["s.step", "fmt.Println", "a", "b"]) and run["visibility"] == "public"
    assert types(f["M.add"]) == [("a", "T"), ("b", "...T")] and f["M.add"]["visibility"] == "private" and [(c["kind"], c["name"]) for c in got["classes"]] == [("struct", "Server"), ("interface", "I")]


def test_cpp():
    got, f = facts("cpp")
    assert set(f) == {"M::ns::Foo::Foo", "M::ns::Foo::~Foo", "M::ns::Foo::get", "M::helper", "M::Foo::out"}
    get, helper = f["M::ns::Foo::get"], f["M::helper"]
    assert types(get) == [("s", "const std::string&"), ("n", "int")] and get["return_type"] == "std::vector<int>" and (get["branch_count"], names(get)) == (2, ["go", "a.b::c"])
    assert types(helper) == [("p", "struct P *"), ("cb", "void (*)(int)")] and (helper["branch_count"], helper["max_nesting"], names(helper)) == (5, 3, ["p.f"])
    assert names(f["M::ns::Foo::Foo"]) == ["init"] and f["M::ns::Foo::Foo"]["return_type"] is None and [r["target"] for r in got["relations"]] == ["Base", "Other"]


def test_csharp():
    got, f = facts("csharp")
    go = f["M.A.Go"]
    assert types(go) == [("s", "string"), ("k", "int?")] and go["return_type"] == "Task<int>" and go["is_async"] and (go["branch_count"], go["max_nesting"], names(go)) == (3, 2, ["X.Y"])
    assert set(f) == {"M.A.A", "M.A.Go", "M.A.Short"} and names(f["M.A.Short"]) == ["Calc"] and [(c["kind"], c["name"]) for c in got["classes"]] == [("class", "A"), ("struct", "P")]
    assert [(r["relation"], r["target"]) for r in got["relations"]] == [("extends", "Base"), ("implements", "IShape")]


def test_swift_php_dart():
    _, f = facts("swift")
    assert set(f) == {"M.A.init", "M.A.go", "M.A.more"} and f["M.A.go"]["return_type"] == "Bool" and (f["M.A.go"]["branch_count"], names(f["M.A.go"])) == (2, ["run"])
    got, f = facts("php")
    assert types(f["M\\A\\go"]) == [("$a", "int"), ("$b", "?Item")] and (f["M\\A\\go"]["branch_count"], names(f["M\\A\\go"])) == (3, ["run", "Item::make", "f"])
    assert [(r["relation"], r["target"]) for r in got["relations"]] == [("extends", "B"), ("implements", "C")]
    _, f = facts("dart")
    assert types(f["M.A.go"]) == [("s", "String"), ("n", "int?")] and f["M.A.go"]["is_async"] and names(f["M.A.short"]) == ["calc"] and "M.main" in f


@pytest.mark.parametrize("language", SOURCES)
def test_blanking_keeps_places(language):
    """Whatever is cut off from a file, blanking keeps each line and place, and the parser ends."""
    text = SOURCES[language]
    for n in range(0, len(text), 7):
        code = blanked(text[:n], language)
        assert len(code) == n and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text[:n]) if c == "\n"]
        braces("p/f", text[:n], "M", language)
        braces("p/f", text[n:], "M", language)


def test_awkward_files():
    for language in SOURCES:
        for text in ("", "{", "}", "(" * 500, "{" * 3000 + "}" * 3000, "a" * 5000, "if (a) " * 300, "x ? " * 500, '"', "/*", "é(ü) { }", "<" * 300):
            braces("p/f", text, "M", language)
