"""Names that a tree's own configuration gives to its folders: path aliases of TypeScript projects, packages, Go modules."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import resolve as R
from loomgraph.sources.files import walk

_STRING = r'"(?:\\.|[^"\\])*"'


def plain_json(text: str) -> str:
    """JSON without the comments and trailing commas that configurations have; strings stay."""
    keep = lambda m: m[0] if m[0].startswith('"') else ""
    text = re.sub(rf"(?s){_STRING}|//[^\n]*|/\*.*?(?:\*/|\Z)", keep, text)
    return re.sub(rf"{_STRING}|,(?=\s*[}}\]])", keep, text)


def folded(path: str) -> str | None:
    """A path without empty, `.` and `..` segments; None if it leaves the root."""
    out: list[str] = []
    for s in path.split("/"):
        if s == "..":
            if not out:
                return None
            out.pop()
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


def entries(folder: str, name: str, text: str) -> list[tuple[str, str, str, list[str]]]:
    """(kind, folder, name, targets) of one file: the aliases of a tsconfig.json (targets relative to the root, perhaps with a `*`), or a package's name."""
    if name == "go.mod":
        m = re.search(r"(?m)^module\s+(\S+)", text)
        return [("package", folder, m[1], [])] if m else []
    try:
        value = json.loads(plain_json(text))
    except ValueError:
        return []
    if not isinstance(value, dict):
        return []
    if name == "package.json":
        own = value.get("name")
        return [("package", folder, own.strip(), [])] if isinstance(own, str) and own.strip() else []
    options = value.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    base, paths, out = options.get("baseUrl"), options.get("paths"), []
    for pattern, targets in paths.items() if isinstance(paths, dict) else ():
        at = [folded(f"{folder}/{base if isinstance(base, str) else '.'}/{t}") for t in targets if isinstance(t, str)] if isinstance(targets, list) else []
        if at := [t for t in at if t is not None]:
            out.append(("alias", folder, pattern, at))
    return out


def configurations(spark: SparkSession, root: str) -> DataFrame:
    """kind (alias or package), folder, name, targets of the whole tree."""
    import pyarrow as pa

    found = walk(spark, root).withColumn("file", F.element_at(F.split("path", "/"), -1)).where(F.col("file").isin("tsconfig.json", "package.json", "go.mod"))

    def run(batches):
        for batch in batches:
            rows = [e for folder, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in entries(folder, name, (content or b"").decode("utf-8", "replace"))]
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["kind", "folder", "name", "targets"])

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return found.select(folder.alias("folder"), "file", "content").mapInArrow(run, "kind string, folder string, name string, targets array<string>")


def named_paths(asked: DataFrame, config: DataFrame) -> DataFrame:
    """asked (folder, name: each pair once), config -> folder, name, paths: where the tree's configuration puts the name, best first, relative to the root.

    An alias counts by the nearest folder above that has any; of its patterns an exact one, else the one with the longest part before the `*`.
    After it the package with the longest name that begins the asked one, in the shallowest folder that has it (ties: the first by name): the folder, or its `src`."""
    alias, package = config.where("kind = 'alias'"), config.where("kind = 'package'")
    above = F.concat(R.prefixes(F.col("folder"), "/"), F.array(F.lit("")))
    holders = alias.select(F.col("folder").alias("at")).distinct()
    near = asked.select("folder").distinct().select("folder", F.posexplode(above).alias("up", "at")).join(holders, "at").groupBy("folder").agg(F.min_by("at", "up").alias("at"))
    rules = alias.select(F.col("folder").alias("at"), F.col("name").alias("pattern"), "targets").withColumn("head", F.split("pattern", r"\*")[0]).withColumn("tail", F.when(F.contains("pattern", F.lit("*")), F.regexp_extract("pattern", r"\*(.*)$", 1)))
    pairs = asked.join(near, "folder").join(rules, "at")
    wild = F.col("tail").isNotNull() & F.startswith("name", "head") & F.endswith("name", "tail") & (F.length("name") >= F.length("head") + F.length("tail"))
    fits = pairs.where((F.col("name") == F.col("pattern")) | wild)
    best = F.max_by(F.struct("head", "tail", "targets"), F.struct(F.col("tail").isNull().alias("exact"), F.length("head").alias("n"), "pattern")).alias("b")
    hit = fits.groupBy("folder", "name").agg(best)
    stem = F.when(F.col("b.tail").isNull(), "").otherwise(F.substring("name", F.length("b.head") + 1, F.length("name") - F.length("b.head") - F.length("b.tail")))
    aliased = hit.select("folder", "name", F.transform("b.targets", lambda t: F.replace(t, F.lit("*"), stem)).alias("aliased"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    homes = package.groupBy("name").agg(F.min_by("folder", F.struct(depth.alias("depth"), "folder")).alias("home"))
    begun = asked.select("name").distinct().select("name", F.posexplode(R.prefixes(F.col("name"), "/")).alias("cut", "package"))
    held = begun.join(homes.select(F.col("name").alias("package"), "home"), "package").groupBy("name").agg(F.min_by(F.struct("package", "home"), "cut").alias("p"))
    rest = F.ltrim(F.substring("name", F.length("p.package") + 1, F.length("name")), F.lit("/"))
    below = F.array_distinct(F.array(F.concat_ws("/", "p.home", rest), F.concat_ws("/", "p.home", F.lit("src"), rest)))
    packaged = held.select("name", F.transform(below, lambda p: F.btrim(p, F.lit("/"))).alias("packaged"))
    empty = F.array().cast("array<string>")
    paths = F.concat(F.coalesce("aliased", empty), F.coalesce("packaged", empty))
    return asked.join(aliased, ["folder", "name"], "left").join(packaged, "name", "left").select("folder", "name", paths.alias("paths")).where(F.size("paths") > 0)
