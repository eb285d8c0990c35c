"""Manifests: what they tell, and which folders count as sources."""

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import codegraph
from loomgraph.sources import manifests as M


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def found(spark, project, *names):
    return {(r.path, r.language, r.is_test, r.label) for r in M.roots(paths(spark, *names), project).collect()}


@pytest.mark.parametrize(
    ("told", "names", "expected"),
    [
        ('[tool.poetry]\nname="x"\npackages=[{include="a", from="lib"}, {include="*.py"}, {include="gone"}, {include="../out"}]', ["lib/a/m.py"], {("lib/a", "poetry-packages")}),
        ('[project]\nname="x"\n[tool.setuptools]\npackages=["p", "p.q"]\n[tool.setuptools.package_dir]\n""="src"', ["src/p/m.py", "src/p/q/m.py"], {("src/p", "setuptools-packages"), ("src/p/q", "setuptools-packages")}),
        ('[project]\nname="x"\n[tool.setuptools.packages.find]\nwhere=["src", "none"]', ["src/a.py"], {("src", "setuptools-find")}),
        ('[project]\nname="x"\n[tool.setuptools.packages.find]\ninclude=["a*"]', ["a.py"], {("", "setuptools-find")}),
        ('[project]\nname="x"\n[tool.hatch.build.targets.wheel]\npackages=["src/y"]', ["src/y/a.py", "src/z/a.py"], {("src/y", "hatch-packages")}),
        ('[project]\nname="my-pkg"', ["my_pkg/__init__.py", "src/my_pkg/__init__.py"], {("my_pkg", "python-package")}),
        ('[project]\nname="my-pkg"', ["my_pkg/a.py", "src/my_pkg/__init__.py"], {("src/my_pkg", "python-package")}),
        ('[project]\nname="p"\n[tool.hatch.build.targets.wheel]\npackages=["p"]', ["p/__init__.py"], {("p", "hatch-packages")}),  # the first label of a folder stays
        ('[project]\nname="p"', ["other/a.py"], set()),
    ],
)
def test_python_roots(spark, told, names, expected):
    project = M.pyproject(told, "folder")
    assert found(spark, project, *names) == {(p, "python", False, label) for p, label in expected}


def test_test_roots(spark):
    told = '[project]\nname="p"\n[tool.pytest.ini_options]\ntestpaths=["checks", "none"]'
    all_names = ["p/__init__.py", "checks/a.py", "tests/a.py", "test/a.py"]
    label = lambda text, *names: {r[3] for r in found(spark, M.pyproject(text, "f"), *names) if r[2]}
    assert label(told, *all_names) == {"pytest"} and label(told, *all_names[2:]) == {"test-dir"}
    tests = {r for r in found(spark, M.pyproject('[project]\nname="p"', "f"), *all_names) if r[2]}
    assert tests == {("tests", None, True, "test-dir")}


def test_other_languages(spark):
    """Folders with a language that the manifest doesn't tell count beside a package, others don't; without a source they don't either."""
    project = M.pyproject('[project]\nname="p"', "f")
    names = ["src/a.c", "scratch/a.py", "docs/x.md", "tests/t.c", "top.c"]
    assert {r[3] for r in found(spark, project, "p/__init__.py", *names)} == {"python-package", "auto:src", "test-dir"}
    assert {r[3] for r in found(spark, project, *names)} == {"test-dir"}


def test_crates(spark):
    told = '[workspace]\nmembers=["crates/*", "tool", "./*"]\n[package]\nname="top"\nversion="1"\n[lib]\ncrate-type=["cdylib", "rlib"]\n[dependencies]\na="1"\nb={version="2"}\nc={path="../c"}\n[dev-dependencies]\na="1"\nd="3"'
    project = M.cargo(told, "f")
    names = ["src/lib.rs", "crates/x/src/lib.rs", "crates/y/main.rs", "crates/z/deep/src/a.rs", "tool/src/a.rs", "tests/t.rs"]
    assert found(spark, project, *names) == {("src", "rust", False, "rust-crate"), ("crates/x/src", "rust", False, "workspace:x"), ("tool/src", "rust", False, "workspace:tool"), ("tests", "rust", True, "rust-integration-tests")}
    rows = {r.id: (r.version, r.is_dev, r.is_optional, r.group) for r in M.dependencies(spark, project).collect()}
    assert rows == {"a": ("1", False, False, None), "b": ("2", False, False, None), "c": (None, False, False, None), "d": ("3", True, False, None)}
    assert project.crate_type == "cdylib,rlib" and project.build_system == "cargo"


def test_collapsed(spark):
    rows = [("src",), ("src/a",), ("src2",), ("lib/x",), ("lib/x/y/z",)]
    left = lambda given: {r.path for r in M.collapsed(spark.createDataFrame(given, "path string")).collect()}
    assert left(rows) == {"src", "src2", "lib/x"} and left([*rows, ("",)]) == {""} and left([]) == set()


def test_told(spark):
    told = """
[project]
name = "p"
dynamic = ["version"]
authors = ["A", {name = "B", email = "b@x"}, {name = "C"}]
license = {text = "MIT"}
urls = {Homepage = "h", Source = "s"}
dependencies = ["req[x] >= 1", "plain"]
[project.optional-dependencies]
df = ["pandas>=3; python_version >= '3.11'", "pandas>=2,<3; python_version < '3.11'"]
[build-system]
build-backend = "maturin"
"""
    p = M.pyproject(told, "f", '[package]\nname="c"\nversion="9"\n[dependencies]\nplain="2"')
    assert (p.name, p.version, p.authors, p.license, p.repository, p.languages, p.build_system) == ("p", "dynamic", ("A", "B <b@x>", "C"), "MIT", "s", ("python", "rust"), "maturin")
    rows = {r.id: (r.version, r.is_optional) for r in M.dependencies(spark, p).collect()}
    assert rows == {"req[x]": (">= 1", False), "plain": ("2", False), "pandas::df": (">=2,<3; python_version < '3.11' || >=3; python_version >= '3.11'", True)}
    assert "rust-crate" in {c[-1] for c in p.candidates}
    assert M.pyproject("", "folder").name == "folder" and M.pyproject('[tool.poetry]\nname="q"\nversion="3"', "f").version == "3"


def tree(top, files):
    for name, text in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return str(top)


def test_build(spark, tmp_path):
    files = {
        "pyproject.toml": '[project]\nname="pkg"\ndependencies=["a>=1"]\n[tool.hatch.build.targets.wheel]\npackages=["pkg", "pkg/inner"]', "pkg/__init__.py": "", "pkg/inner/m.py": "def f():\n    return 1\n",
        "scratch/x.py": "def lost():\n    return 1\n", "native/lib.go": "package lib\n\nfunc Up() int { return 1 }\n", "tests/test_m.py": "def test_f():\n    return 1\n", "setup.py": "", "pkg/inner/Cargo.toml": "[package]\nname='no'\n",
    }
    root = tree(tmp_path / "proj", files)
    g = codegraph.build(spark, root, docs=False)
    assert {r.id for r in g.nodes("File").collect()} == {"pkg/__init__.py", "pkg/inner/m.py", "native/lib.go", "tests/test_m.py"}
    assert {r.title for r in g.nodes("Function").collect()} == {"f", "Up", "test_f"} and g.nodes("File").count() == g.nodes("File").distinct().count()
    p = g.nodes("Project").first()
    assert (p.id, p.manifest, p.languages) == ("pkg", "pyproject.toml", "python, go") and g.pairs("DEPENDS_ON").first()[:] == ("pkg", "a")
    fewer = codegraph.build(spark, root + "/pyproject.toml", include_tests=False, docs=False)
    assert {r.id for r in fewer.nodes("File").where(F.col("id").startswith("tests/") | F.col("id").startswith("pkg/")).collect()} == {"pkg/__init__.py", "pkg/inner/m.py"}


def test_whole_tree(spark, tmp_path):
    """No manifest, or one that tells no sources: every file counts."""
    for name, text, manifest in (("bare", None, "(inferred)"), ("tools", "[tool.ruff]\n", "pyproject.toml")):
        files = {"a/x.py": "", "tests/t.py": ""} | ({"pyproject.toml": text} if text else {})
        root = tree(tmp_path / name, files)
        project = M.read(spark, root)
        assert (project.name, project.manifest) == (name, manifest) and M.scope(spark, root, project) is None


def test_unreadable(spark, tmp_path):
    with pytest.raises(ValueError, match="pyproject.toml"):
        M.read(spark, tree(tmp_path / "bad", {"pyproject.toml": "[project\nname = broken"}))
    with pytest.raises(ValueError, match="Cargo.toml"):
        M.read(spark, tree(tmp_path / "none", {"a.py": ""}), "Cargo.toml")


def test_packages():
    told = M.package('{"name": "n", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2",}} // end', "f")
    assert (told.name, told.manifest, told.dependencies) == ("n", "package.json", (("a", "^1", False, False, None), ("b", "2", True, False, None)))
    assert M.package("{broken", "f") == M.Project("f") and M.package('[1]', "f").name == "f" and M.package('{"dependencies": ["x"]}', "f").dependencies == ()
