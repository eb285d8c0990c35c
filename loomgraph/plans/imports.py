"""What the imports of files name: other files and modules of the tree.

Each import gives an ordered list of candidates, from generators that its language has; the first that the tree knows is meant.
Some generators have the last word: what a Rust path or a dotted Python import names is found by them or not at all.

Candidates are `p:` and a file's path, `s:` and a script's path without extension and index, `m:` and a module (dotted, whatever the
language writes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import resolve as R
from loomgraph.sources.workspace import named_paths

PATH_LANGUAGES = ("c", "cpp", "html", "css", "dart", "r", "julia", "agc")
SCRIPTS = ("typescript", "javascript")
#: Languages in which a module is many files: a name may be one segment longer than its module, and says nothing about files.
NAMESPACED = ("java", "csharp", "php", "swift", "go")
#: Languages in which one module is one file.
FILE_ANCHORED = ("python", "agc", "dart")
_SCRIPT_ENDS = r"\.(?:tsx|ts|jsx|mjs|cjs|mts|cts|js)$"


def _none() -> Column:
    return F.array().cast("array<string>")


def folded(path: Column) -> Column:
    """A path without empty, `.` and `..` segments; null if it leaves the root or nothing is left."""
    step = lambda a, s: F.when(s != "..", F.array_append(a, s)).when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1))
    out = F.aggregate(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), _none(), step)
    return F.when(F.size(out) > 0, F.array_join(out, "/"))


def _marked(mark: str, names: Column) -> Column:
    return F.transform(F.array_compact(names), lambda x: F.concat(F.lit(mark), x))


def _cut(parts: Column, least: Column) -> Column:
    """Dotted prefixes of the parts from all of them down to `least`, the longest first."""
    return F.transform(F.when(F.size(parts) >= least, F.sequence(F.size(parts), least, F.lit(-1))), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def path_candidates() -> Column:
    """Beside the file; from the root (not for C: its compilers don't look there); for a page's absolute path beside the file as well; a style sheet's name without extension."""
    name = F.replace(F.split(F.ltrim(F.trim("name"), F.lit('"')), "[?#]")[0], F.lit("\\"), F.lit("/"))
    name = F.when(F.col("language") == "dart", F.regexp_replace(name, "^package:[^/]*/", "/lib/")).otherwise(name)
    absolute, root = name.startswith("/"), F.ltrim(name, F.lit("/"))
    beside = folded(F.concat(F.regexp_replace("src", "[^/]*$", ""), root))
    c_like, page = F.col("language").isin("c", "cpp"), F.col("language").isin("html", "css")
    tries = F.array(F.when(~absolute, beside), F.when(~c_like, folded(root)), F.when(absolute & page, beside))
    sheets = F.when(F.col("language") == "css", F.transform(F.filter(F.array_compact(tries), lambda t: ~t.rlike(r"\.[^/]*$")), lambda t: F.concat(t, F.lit(".css")))).otherwise(_none())
    outside = F.trim("name").rlike(r"^(?:<|#|//|$)|(?i)^data:") | (F.contains("name", F.lit("://")))
    return F.when(outside, _none()).otherwise(F.array_distinct(_marked("p:", F.concat(tries, sheets))))


def script_candidates() -> Column:
    """Relative names beside the file; others where aliases and packages of the tree put them (column paths)."""
    relative = F.col("name").rlike(r"^\.\.?(?:/|$)")
    raw = F.when(relative, F.array(folded(F.concat(F.regexp_replace("src", "[^/]*$", ""), "name")))).otherwise(F.transform(F.coalesce("paths", _none()), folded))
    stems = F.transform(F.array_compact(raw), lambda p: F.regexp_replace(p, _SCRIPT_ENDS, ""))
    return F.array_distinct(_marked("s:", F.flatten(F.transform(stems, lambda s: F.array(s, F.when(s.endswith("/index"), F.regexp_replace(s, "/index$", "")))))))


def rust_candidates() -> Column:
    """`crate`, `super`, `self` and bare paths, all below the crate's root (what ends in the last `src`), never shorter than it."""
    own, name = F.split("module_path", r"\."), F.rtrim(F.trim("name"), F.lit(":"))
    at = F.size(own) - F.array_position(F.reverse(own), F.lit("src")).cast("int") + 1
    root = F.when(F.array_contains(own, "src"), at).otherwise(1)
    ups = F.regexp_extract(name, r"^((?:super(?:::|$))*)", 1)
    near = name.rlike(r"^(?:super|self)(?:::|$)")
    base = F.when(near, F.slice(own, 1, F.greatest(root, F.size(own) - F.size(F.split(ups, "super")) + 1))).otherwise(F.slice(own, 1, root))
    rest = F.when(near, F.regexp_replace(F.substring(name, F.length(ups) + 1, F.length(name)), "^self(?:::|$)", "")).otherwise(F.regexp_replace(name, "^crate(?:::|$)", ""))
    return _marked("m:", _cut(F.concat(base, F.filter(F.split(rest, "::"), lambda s: s != "")), root))


def relative_candidates() -> Column:
    """Python names with leading dots, from the file's package on, never shorter than the package that the dots name."""
    own, dots = F.split("module_path", r"\."), F.length(F.regexp_extract("name", r"^(\.*)", 1))
    up = dots - F.when(F.col("src").rlike(r"(?:^|/)__init__\.pyi?$"), 1).otherwise(0)
    anchor = F.slice(own, 1, F.greatest(F.lit(1), F.size(own) - up))
    rest = F.filter(F.split("name", r"\."), lambda s: s != "")
    return _marked("m:", _cut(F.concat(anchor, rest), F.size(anchor)))


def rooted_candidates() -> Column:
    """Absolute Python names: below each folder from the root to the file's own, and below a `src` in each."""
    own = F.split("module_path", r"\.")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(own) - 1)), lambda n: F.array_join(F.slice(own, 1, n), "."))
    roots = F.concat(folders, F.transform(folders, lambda r: F.concat(r, F.lit(".src"))))
    names = _cut(F.split("name", r"\."), F.lit(1))
    return _marked("m:", F.flatten(F.transform(names, lambda s: F.transform(roots, lambda r: F.concat_ws(".", r, s)))))


def walked_candidates() -> Column:
    """The name itself, and what is left when segments are cut off its end: one where modules are namespaces, none for assembly, else all but the first."""
    parts = F.filter(F.split(F.regexp_replace("name", r"::|[\\/]", "."), r"\."), lambda s: s != "")
    least = F.when(F.col("language").isin(*NAMESPACED), F.greatest(F.lit(1), F.size(parts) - 1)).when(F.col("language") == "agc", F.size(parts)).otherwise(1)
    return _marked("m:", _cut(parts, F.greatest(F.lit(1), least)))


def _package_candidates() -> Column:
    """Go: the folder that the tree's go.mod gives the name."""
    paths = F.when(F.col("language") == "go", F.coalesce("paths", _none())).otherwise(_none())
    root = F.split("module_path", r"\.")[0]
    return _marked("m:", F.transform(paths, lambda p: F.concat_ws(".", root, F.replace(p, F.lit("/"), F.lit(".")))))


def sites(facts: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """src, language, module_path, name, line of each import, and its candidates: to_file, to_module."""
    one = facts.select(F.col("path").alias("src"), "language", "module_path", F.explode("imports").alias("i")).select("src", "language", "module_path", F.trim("i.name").alias("name"), F.col("i.line").alias("line"))
    one = one.where(~F.startswith("name", F.lit("<"))).withColumn("folder", F.regexp_extract("src", "^(.*)/[^/]*$", 1))
    if config is None:
        one = one.withColumn("paths", F.lit(None).cast("array<string>"))
    else:
        asked = one.where(F.col("language").isin(*SCRIPTS, "go") & ~F.startswith("name", F.lit("."))).select("folder", "name").distinct()
        one = one.join(named_paths(asked, config), ["folder", "name"], "left")
    language, dotted = F.col("language"), F.startswith("name", F.lit("."))
    general = F.when(language.isin(*PATH_LANGUAGES), path_candidates()).when(language.isin(*SCRIPTS), script_candidates()).otherwise(_package_candidates())
    whole = F.when(language == "rust", rust_candidates()).when((language == "python") & dotted, relative_candidates())
    rooted = F.when(language == "python", rooted_candidates()).otherwise(_none())
    to_module = F.coalesce(whole, F.concat(general, walked_candidates(), rooted))
    to_file = F.coalesce(whole, F.when(language.isin(*FILE_ANCHORED), F.concat(general, walked_candidates(), rooted)).otherwise(F.when(language == "go", _none()).otherwise(general)))
    return one.select("src", "language", "module_path", "name", "line", to_file.alias("to_file"), to_module.alias("to_module"), whole.isNotNull().alias("whole"))


def resolved(facts: DataFrame, modules: DataFrame, config: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """facts (path, language, module_path, imports), modules (id) -> two tables of src, dst, import_count: files that files import, and modules that they import.

    No file imports itself, nor by a Rust or dotted Python name its own module."""
    from loomgraph.functions.storage import settled

    every = settled(sites(facts, config))
    stem = F.regexp_replace(F.regexp_replace("path", _SCRIPT_ENDS, ""), "/index$", "")
    files = facts.select(F.explode(F.array(F.concat(F.lit("p:"), "path"), F.when(F.col("language").isin(*SCRIPTS), F.concat(F.lit("s:"), stem)))).alias("key"), "path", "module_path").where("key IS NOT NULL")
    files = files.groupBy("key").agg(F.min(F.struct("path", "module_path")).alias("f")).select("key", "f.*")
    module_files = facts.where("language NOT IN ('html', 'css')").groupBy(F.concat(F.lit("m:"), "module_path").alias("key")).agg(F.min("path").alias("dst"))
    key = ["src", "name", "line"]
    to_file = R.first_candidate(every, key, "to_file", known := files.select("key", F.col("path").alias("dst")).unionByName(module_files), "key").join(known, "key").where("src <> dst")
    known = files.select("key", F.col("module_path").alias("dst")).unionByName(modules.select(F.concat(F.lit("m:"), "id").alias("key"), F.col("id").alias("dst")))
    to_module = R.first_candidate(every, [*key, "module_path", "whole"], "to_module", known, "key").join(known, "key").where("NOT (whole AND dst = module_path)")
    count = F.count("*").alias("import_count")
    return to_file.groupBy("src", "dst").agg(count), to_module.groupBy("src", "dst").agg(count)


def submodules(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """src, dst: modules and those that they declare (Rust `mod`, files of Python packages), and where the hierarchy of names is enough (C, C++, Swift, PHP) each prefix and what is one longer."""
    declared = facts.where("language = 'rust'").select(F.col("module_path").alias("src"), F.explode("submodules").alias("s")).select("src", F.concat_ws(".", "src", "s").alias("dst"))
    own = F.split("module_path", r"\.")
    named = facts.where(F.col("language").isin("c", "cpp", "swift", "php")).select(F.explode(F.filter(R.prefixes(F.col("module_path"), "."), lambda p: F.contains(p, F.lit(".")))).alias("dst"))
    packages = facts.where(F.col("path").rlike(r"(?:^|/)__init__\.pyi?$")).select(F.col("module_path").alias("src"))
    python = facts.where("language = 'python'").select(F.array_join(F.slice(own, 1, F.size(own) - 1), ".").alias("src"), F.col("module_path").alias("dst")).join(packages, "src", "left_semi")
    every = declared.unionByName(named.select(F.regexp_extract("dst", r"^(.*)\.[^.]*$", 1).alias("src"), "dst")).unionByName(python)
    return every.distinct().join(modules.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
