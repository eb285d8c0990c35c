"""Projects by their manifests: what they say of themselves, what they depend on, and the folders that hold their sources."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.storage import settled
from loomgraph.sources.files import below, folders, language_of, walk
from loomgraph.sources.languages import LANGUAGES
from loomgraph.sources.workspace import folded, plain_json

#: Manifests that count, the first that a tree has decides.
NAMES = ("pyproject.toml", "Cargo.toml", "package.json")

CANDIDATE = "place int, choice string, tier int, key string, language string, is_test boolean, label string"
DEPENDENCY = "name string, version string, is_dev boolean, is_optional boolean, grp string"


@dataclass(frozen=True)
class Project:
    """What a manifest tells. candidates: folders that may hold sources (see `roots`); dependencies: as they are declared."""

    name: str
    manifest: str = "(inferred)"
    version: str | None = None
    description: str | None = None
    languages: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    license: str | None = None
    repository: str | None = None
    build_system: str | None = None
    crate_type: str | None = None
    candidates: tuple[tuple, ...] = ()
    dependencies: tuple[tuple, ...] = ()

    @property
    def mixed(self) -> bool:
        """Whether folders in languages that the manifest doesn't tell are sources too."""
        return self.manifest == "pyproject.toml"


def _at(value: object, *keys: str):
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def _table(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _texts(value: object) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


class _Candidates:
    """Folders that a manifest points to, in the order in which they count. Of one choice only the lowest tier that is there is taken."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, path: str, language: str | None, label: str, choice: str | None = None, tier: int = 0, is_test: bool = False, kind: str = "dir") -> None:
        if (at := folded(path)) is not None:
            n = len(self.rows)
            self.rows.append((n, choice or f"{label}:{n}", tier, f"{kind}:{at}", language, is_test, label))


def _python(data: dict, name: str) -> _Candidates:
    out = _Candidates()
    tool = _at(data, "tool")
    packages = _at(tool, "poetry", "packages")
    for p in packages if isinstance(packages, list) else ():
        if (include := _text(_at(p, "include"))) and "*" not in include:
            out.add(f"{_text(_at(p, 'from')) or '.'}/{include}", "python", "poetry-packages")
    packages = _at(tool, "setuptools", "packages")
    if isinstance(packages, list):
        home = _text(_at(tool, "setuptools", "package_dir", "")) or "."
        for p in _texts(packages):
            out.add(f"{home}/{p.replace('.', '/')}", "python", "setuptools-packages")
    elif (find := _at(packages, "find")) is not None:
        where = _at(find, "where")
        for p in _texts(where) if isinstance(where, list) else ["."]:
            out.add(p, "python", "setuptools-find")
    for p in _texts(_at(tool, "hatch", "build", "targets", "wheel", "packages")):
        out.add(p, "python", "hatch-packages")
    own = name.replace("-", "_")
    for tier, p in enumerate((own, f"src/{own}")):
        out.add(p, "python", "python-package", "python-package", tier, kind="package")
    return out


def _dependency(told: str) -> tuple[str, str | None]:
    at = re.search("[><=!~]", told)
    return (told[: at.start()].strip(), told[at.start() :].strip()) if at else (told.strip(), None)


def pyproject(text: str, folder: str, cargo_text: str | None = None) -> Project:
    """A Python project; where maturin builds it, its crate's sources and dependencies belong to it."""
    data = tomllib.loads(text)
    own, poetry = _at(data, "project") or {}, _at(data, "tool", "poetry")
    name = _text(_at(own, "name")) or _text(_at(poetry, "name")) or folder
    version = _text(_at(own, "version")) or ("dynamic" if "version" in _texts(_at(own, "dynamic")) else _text(_at(poetry, "version")))
    authors = [a if isinstance(a, str) else f"{a.get('name', '')} <{a['email']}>" if a.get("email") else a.get("name", "") for a in _at(own, "authors") or () if isinstance(a, str | dict)]
    rights = _at(own, "license")
    urls = [u for k in ("Repository", "repository", "Source", "source", "Homepage") if (u := _text(_at(own, "urls", k)))]
    found = _python(data, name)
    needs = [(*_dependency(d), False, False, None) for d in _texts(_at(own, "dependencies"))]
    extras = _at(own, "optional-dependencies")
    needs += [(*_dependency(d), False, True, g) for g, ds in (extras.items() if isinstance(extras, dict) else ()) for d in _texts(ds)]
    build, languages = _text(_at(data, "build-system", "build-backend")) or "unknown", ["python"]
    if "maturin" in build and cargo_text is not None:
        crate = cargo(cargo_text, folder)
        n = len(found.rows)
        found.rows += [(n + c[0], *c[1:]) for c in crate.candidates if not c[5]]
        languages, needs, version = ["python", "rust"], [*needs, *crate.dependencies], version or crate.version
    for p in _texts(_at(data, "tool", "pytest", "ini_options", "testpaths")):
        found.add(p, None, "pytest", "tests", 0, True)
    for tier, p in enumerate(("tests", "test"), 1):
        found.add(p, None, "test-dir", "tests", tier, True)
    return Project(
        name, "pyproject.toml", version, _text(_at(own, "description")) or _text(_at(poetry, "description")), tuple(languages), tuple(authors),
        rights if isinstance(rights, str) else _text(_at(rights, "text")) or _text(_at(rights, "file")), urls[0] if urls else None, build, None, tuple(found.rows), tuple(needs),
    )


def cargo(text: str, folder: str) -> Project:
    """A crate, or a workspace of crates: `dir/*` stands for each folder in `dir`."""
    data = tomllib.loads(text)
    own, found = _at(data, "package") or {}, _Candidates()
    found.add("src", "rust", "rust-crate")
    for member in _texts(_at(data, "workspace", "members")):
        if member.endswith("/*"):
            found.add(member[:-2], "rust", "workspace:", kind="members")
        elif (at := folded(member)) is not None:
            found.add(f"{at}/src", "rust", f"workspace:{at.rsplit('/', 1)[-1]}")
    found.add("tests", "rust", "rust-integration-tests", is_test=True)
    needs = [(n, _text(v) or _text(_at(v, "version")), dev, False, None) for key, dev in (("dependencies", False), ("dev-dependencies", True)) for n, v in (_at(data, key) or {}).items()]
    kinds = _texts(_at(data, "lib", "crate-type"))
    return Project(
        _text(_at(own, "name")) or folder, "Cargo.toml", _text(_at(own, "version")), _text(_at(own, "description")), ("rust",), tuple(_texts(_at(own, "authors"))),
        _text(_at(own, "license")), _text(_at(own, "repository")), "cargo", ",".join(kinds) or None, tuple(found.rows), tuple(needs),
    )


def package(text: str, folder: str) -> Project:
    """A JavaScript package: name and dependencies; the whole tree is its source. One that can't be read tells nothing."""
    try:
        data = json.loads(plain_json(text))
    except ValueError:
        return Project(folder)
    needs = [(n, _text(v), dev, False, None) for key, dev in (("dependencies", False), ("devDependencies", True)) for n, v in _table(_at(data, key)).items()]
    return Project(_text(_at(data, "name")) or folder, "package.json", _text(_at(data, "version")), _text(_at(data, "description")), dependencies=tuple(needs))


def read(spark: SparkSession, root: str, name: str | None = None) -> Project:
    """The project of a tree by the manifest at its top: that of the given name, else the first of `NAMES` that is there, else inferred.

    A manifest that can't be read as what it is raises ValueError with its name."""
    top = root.rstrip("/")
    folder = top.rsplit("/", 1)[-1]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(NAMES) + "}").load(top)
    rows = found.select(below("path", top).alias("path"), "content").where(F.col("path").isin(*NAMES)).collect()  # three small files at most
    texts = {r.path: bytes(r.content).decode("utf-8", "replace") for r in rows}
    chosen = name or next((n for n in NAMES if n in texts), None)
    if chosen is None:
        return Project(folder)
    if chosen not in texts:
        raise ValueError(f"no manifest that is known: {chosen}")
    try:
        if chosen == "pyproject.toml":
            return pyproject(texts[chosen], folder, texts.get("Cargo.toml"))
        return (cargo if chosen == "Cargo.toml" else package)(texts[chosen], folder)
    except ValueError as e:  # of TOML and JSON alike
        raise ValueError(f"failed to read {chosen}: {e}") from e


def roots(paths: DataFrame, project: Project) -> DataFrame:
    """path, language, is_test, label of the folders that hold a project's sources, no folder inside another. paths: path of all files of the tree.

    A candidate counts if there are files below it (for a package also its `__init__.py`). A folder that two candidates name has the first one's label.
    Beside the sources of a pyproject.toml, folders at the top count that have files in a language which neither the manifest nor its sources have,
    and no source or test folder in them. Roots inside others are dropped by a join on prefixes. Without any source the result is empty: the whole tree counts."""
    spark = paths.sparkSession
    told = spark.createDataFrame(list(project.candidates), CANDIDATE)  # as long as the manifest, which the driver has read
    above = paths.select(F.explode(folders(F.col("path"))).alias("path")).distinct()
    member = F.regexp_extract("path", "^(.+)/([^/]+)/src$", 1)
    keys = F.array_compact(F.array(F.concat(F.lit("dir:"), "path"), F.when(F.col("path").rlike("^.+/[^/]+/src$"), F.concat(F.lit("members:"), member)), F.when(F.col("path").rlike("^[^/]+/src$"), F.lit("members:"))))
    there = above.select("path", F.explode(keys).alias("key"))
    packages = paths.where(F.col("path").endswith("/__init__.py")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))
    there = there.unionByName(packages.select("path", F.concat(F.lit("package:"), "path").alias("key")))
    found = there.join(told, "key")
    name = F.element_at(F.split("path", "/"), -2)
    found = found.withColumn("label", F.when(F.col("key").startswith("members:"), F.concat("label", name)).otherwise(F.col("label")))
    least = found.groupBy("choice").agg(F.min("tier").alias("tier"))
    declared = found.join(least, ["choice", "tier"], "left_semi").groupBy("path").agg(F.min_by(F.struct("language", "is_test", "label"), F.struct("place", "label")).alias("c")).select("path", "c.*")
    if project.mixed:
        top = F.split("path", "/")[0]
        spoken = declared.where("NOT is_test AND language IS NOT NULL").select("language").unionByName(spark.createDataFrame([(x,) for x in project.languages], "language string"))
        others = paths.where(F.contains("path", F.lit("/"))).select(top.alias("path"), language_of(F.col("path")).alias("language")).where("language IS NOT NULL").distinct()
        others = others.join(spoken, "language", "left_anti").select("path").distinct().join(declared.select(top.alias("path")), "path", "left_anti")
        sources = declared.where("NOT is_test").agg(F.count("*").alias("n")).where("n > 0").select(F.lit(True).alias("any"))
        others = others.crossJoin(F.broadcast(sources)).drop("any")  # one row or none
        declared = declared.unionByName(others.select("path", F.lit(None).cast("string").alias("language"), F.lit(False).alias("is_test"), F.concat(F.lit("auto:"), "path").alias("label")))
    return declared


def collapsed(found: DataFrame) -> DataFrame:
    """Roots that no other root holds."""
    inside = found.where("path <> ''").select("path", F.explode(folders(F.col("path"))).alias("above"))
    covered = inside.join(found.select(F.col("path").alias("above")), "above").select("path")
    return found.join(covered, "path", "left_anti")


def scope(spark: SparkSession, root: str, project: Project, include_tests: bool = True) -> DataFrame | None:
    """The folders to read (path, language, is_test, label), or None for the whole tree: a manifest without sources of its own says nothing of the rest."""
    if not project.candidates:
        return None
    found = settled(roots(walk(spark, root).select("path"), project))
    if found.where("NOT is_test").isEmpty():
        return None
    return settled(collapsed(found if include_tests else found.where("NOT is_test")))


def dependencies(spark: SparkSession, project: Project) -> DataFrame:
    """id, title, version, is_dev, is_optional, group: one row per name and group. Versions that differ are joined by ` || ` in their order; only what is
    for development, or optional, wherever it is declared counts as that."""
    told = spark.createDataFrame(list(project.dependencies), DEPENDENCY)
    versions = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("version", r" \|\| ")))))
    one = told.groupBy("name", "grp").agg(versions.alias("versions"), F.bool_and("is_dev").alias("is_dev"), F.bool_and("is_optional").alias("is_optional"))
    version = F.when(F.size("versions") > 0, F.array_join("versions", " || "))
    return one.select(F.concat_ws("::", "name", "grp").alias("id"), F.col("name").alias("title"), version.alias("version"), "is_dev", "is_optional", F.col("grp").alias("group"))


def node(spark: SparkSession, project: Project, files: DataFrame) -> DataFrame:
    """The project as a row. languages: those of the manifest, then those of its files in the order of the languages' own list, by `, `."""
    known = [x for x in LANGUAGES if x not in project.languages]
    seen = files.agg(F.array_sort(F.collect_set("language")).alias("seen"))
    declared = F.lit(list(project.languages)).cast("array<string>")
    listed = F.filter(F.lit(known).cast("array<string>"), lambda x: F.array_contains("seen", x))
    rest = F.array_except(F.array_except(F.col("seen"), listed), declared)
    told = spark.createDataFrame(
        [(project.name, project.name, project.version, project.description, ", ".join(project.authors) or None, project.license, project.repository, project.build_system, project.crate_type, project.manifest)],
        "id string, title string, version string, description string, authors string, license string, repository string, build_system string, crate_type string, manifest string",
    )
    languages = F.array_join(F.concat(declared, listed, rest), ", ")
    return told.crossJoin(seen).withColumn("languages", F.when(languages != "", languages)).drop("seen")
