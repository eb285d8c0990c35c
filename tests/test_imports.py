"""Each generator of import candidates by a small tree of its own language."""

import json

import pytest

from loomgraph.operators import resolve as R
from loomgraph.plans import imports as I
from loomgraph.sources import files as S
from loomgraph.sources import workspace as W
from pyspark.sql import functions as F

TREE = {
    # relative and rooted Python, a `src` layout, a package that stands for itself
    "py/pkg/__init__.py": "from . import low\nfrom .low import thing\n",
    "py/pkg/low.py": "from .. import nothing\nfrom ...deep import x\nimport os.path\n",
    "py/pkg/sub/__init__.py": "",
    "py/pkg/sub/leaf.py": "from ..low import thing\nfrom . import helper\nimport pkg.low\nimport inner.mod\nfrom .....far import y\n",
    "py/src/inner/mod.py": "",
    "py/tests/test_it.py": "import inner.mod\nimport pkg.low\nfrom pkg.low import thing\n",
    # Rust: crate, super, self, bare, another crate; the walk stops at the crate's root
    "rs/src/lib.rs": "mod api;\npub mod net;\nuse api::Item;\nuse serde::Serialize;\n",
    "rs/src/api.rs": "use crate::net::http::Get;\nuse crate::Missing;\nuse self::inner;\n",
    "rs/src/net/mod.rs": "mod http;\nuse super::api::Item;\n",
    "rs/src/net/http.rs": "use super::super::api;\nuse super::Conn;\nuse rs::src::api;\n",
    # C: beside the file alone; system headers never
    "c/main.c": '#include "util.h"\n#include "sub/deep.h"\n#include "../top.h"\n#include <util.h>\n#include "config.h"\n',
    "c/util.h": "", "c/sub/deep.h": '#include "util.h"\n', "top.h": "", "config.h": "",
    # pages and style sheets
    "site/dist/index.html": "<link href='/css/app.css'><script src='js/run.js?v=1'></script><link href='https://x.org/a.css'>",
    "site/dist/css/app.css": "@import 'base';\n", "site/dist/css/base.css": "", "site/dist/js/run.js": "", "css/app.css": "",
    # namespaces trim one segment at most, and name no file
    "j/a/Main.java": "package com.shop.app;\nimport com.shop.core.Item;\nimport com.shop.core.deep.down.Thing;\nimport org.other.X;\nclass Main {}\n",
    "j/b/Item.java": "package com.shop.core;\nclass Item {}\n",
    "cs/A.cs": "using Shop.Core;\nnamespace Shop.App { class A {} }\n", "cs/B.cs": "namespace Shop.Core { class B {} }\n",
    "php/A.php": "<?php\nnamespace Shop\\App;\nuse Shop\\Core\\Item;\n", "php/B.php": "<?php\nnamespace Shop\\Core;\nclass Item {}\n",
    "go.mod": "module example.com/app\n\ngo 1.22\n", "gosrc/main.go": 'package main\nimport "example.com/app/gosrc/util"\nimport "fmt"\n', "gosrc/util/u.go": "package util\n",
    # scripts: relative with extension, index, aliases with a comment and a trailing comma, packages
    "web/tsconfig.json": '{ // aliases\n "compilerOptions": { "baseUrl": "./src", "paths": { "@/*": ["*"], "@lib/*": ["lib/*", "other/*",], "exact": ["lib/one.ts"], } } }',
    "web/src/app.ts": "import a from './lib/one.js';\nimport b from '@/lib/one';\nimport c from '@lib/two';\nimport d from 'exact';\nimport e from '@org/tool';\nimport f from '@org/tool/part';\nimport g from './lib';\nimport h from 'react';\nimport i from '../../../outside';\n",
    "web/src/lib/one.ts": "", "web/src/other/two.ts": "", "web/src/lib/index.ts": "",
    "packages/tool/package.json": '{"name": "@org/tool"}', "packages/tool/src/index.ts": "", "packages/tool/src/part.ts": "",
    "packages/old/tool/package.json": '{"name": "@org/tool"}', "packages/old/tool/index.ts": "", "broken/package.json": "{", "list/package.json": "[1]",
    # Dart packages and relative parts, assembly by its whole name
    "lib/model.dart": "import 'part/x.dart';\nimport 'package:app/part/x.dart';\nimport 'dart:io';\n", "lib/part/x.dart": "",
    "agc/main.agc": "$SUB.agc\n$SUB\n", "agc/SUB.agc": "L  CA  X\n",
    "jl/a.jl": 'include("b.jl")\nusing .Geometry\n', "jl/b.jl": "",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("imports") / "proj"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    facts = S.facts(spark, str(root)).cache()
    modules = facts.select(F.explode(R.prefixes(F.col("module_path"), ".")).alias("id")).distinct()
    files, mods = I.resolved(facts, modules, W.configurations(spark, str(root)))
    return {(r.src, r.dst): r.import_count for r in files.collect()}, {(r.src, r.dst): r.import_count for r in mods.collect()}, {(r.src, r.dst) for r in I.submodules(facts, modules).collect()}


def of(table, start):
    return {(a.removeprefix(start), b.removeprefix(start)): n for (a, b), n in table.items() if a.startswith(start)}


def test_python(found):
    files, modules, subs = found
    assert of(files, "py/") == {("pkg/__init__.py", "pkg/low.py"): 2, ("pkg/sub/leaf.py", "pkg/low.py"): 2, ("pkg/sub/leaf.py", "pkg/sub/__init__.py"): 1, ("pkg/sub/leaf.py", "src/inner/mod.py"): 1, ("tests/test_it.py", "src/inner/mod.py"): 1, ("tests/test_it.py", "pkg/low.py"): 2}
    assert modules["py/pkg/low.py", "proj.py"] == 1 and modules["py/pkg/low.py", "proj"] == 1 and modules["py/pkg/sub/leaf.py", "proj.py.pkg.low"] == 2
    assert {("proj.py.pkg", "proj.py.pkg.low"), ("proj.py.pkg", "proj.py.pkg.sub"), ("proj.py.pkg.sub", "proj.py.pkg.sub.leaf")} == {x for x in subs if x[0].startswith("proj.py")}


def test_rust(found):
    files, modules, subs = found
    assert of(files, "rs/src/") == {("lib.rs", "api.rs"): 1, ("api.rs", "net/http.rs"): 1, ("api.rs", "lib.rs"): 1, ("net/mod.rs", "api.rs"): 1, ("net/http.rs", "api.rs"): 1, ("net/http.rs", "net/mod.rs"): 1, ("net/http.rs", "lib.rs"): 1}
    assert ("rs/src/api.rs", "proj.rs.src.api") not in modules and modules["rs/src/api.rs", "proj.rs.src.net.http"] == 1
    assert {x for x in subs if x[0].startswith("proj.rs")} == {("proj.rs.src", "proj.rs.src.api"), ("proj.rs.src", "proj.rs.src.net"), ("proj.rs.src.net", "proj.rs.src.net.http")}


def test_paths(found):
    files, _, subs = found
    assert of(files, "c/") == {("main.c", "util.h"): 1, ("main.c", "sub/deep.h"): 1, ("main.c", "top.h"): 1}
    assert of(files, "site/dist/") == {("index.html", "css/app.css"): 1, ("index.html", "js/run.js"): 1, ("css/app.css", "css/base.css"): 1} or files["site/dist/index.html", "css/app.css"] == 1
    assert files["lib/model.dart", "lib/part/x.dart"] == 2 and files["jl/a.jl", "jl/b.jl"] == 1 and files["agc/main.agc", "agc/SUB.agc"] == 1
    assert ("proj.c", "proj.c.sub") in subs and ("proj", "proj.c") in subs


def test_served_root(found):
    """A page's absolute path: the project's root comes first, the page's own folder next."""
    files, _, _ = found
    assert ("site/dist/index.html", "css/app.css") in files and ("site/dist/index.html", "site/dist/css/app.css") not in files


def test_namespaces(found):
    files, modules, _ = found
    assert not [x for x in files if x[0].startswith(("j/", "cs/", "php/", "gosrc/"))]
    assert {k: n for k, n in modules.items() if k[0].startswith("j/")} == {("j/a/Main.java", "com.shop.core"): 1}
    assert modules["cs/A.cs", "Shop.Core"] == 1 and modules["php/A.php", "Shop.Core"] == 1 and modules["gosrc/main.go", "proj.gosrc.util"] == 1


def test_scripts(found):
    files, modules, _ = found
    assert {b.removeprefix("web/src/"): n for (a, b), n in files.items() if a == "web/src/app.ts"} == {"lib/one.ts": 3, "other/two.ts": 1, "lib/index.ts": 1, "packages/tool/src/index.ts": 1, "packages/tool/src/part.ts": 1}
    assert modules["web/src/app.ts", "proj.web.src.lib"] == 1


def test_configuration():
    assert json.loads(W.plain_json('{"a": "// no /* */ ,}", /* x */ "b": [1, 2, // y\n ], "c": "\\",]", }')) == {"a": "// no /* */ ,}", "b": [1, 2], "c": '",]'}
    assert W.folded("a/./b/../c//d") == "a/c/d" and W.folded("a/../..") is None and W.folded("") == ""
    assert W.entries("x", "tsconfig.json", '{"compilerOptions": {"paths": {"a": "no list", "b": [1], "c": ["../../out"], "d": ["y"]}}}') == [("alias", "x", "d", ["x/y"])]
    assert W.entries("", "package.json", '{"name": " "}') == [] and W.entries("", "go.mod", "// none") == []
