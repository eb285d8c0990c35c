"""Source trees as DataFrames: discovery, language, filters and facts."""

from __future__ import annotations

import json
import os
import subprocess
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import resolve as R
from loomgraph.sources import extract as X
from loomgraph.sources.languages import EXTENSIONS, SKIPPED

_SITE = "array<struct<name:string,line:bigint>>"
FUNCTION = f"struct<name:string,qualified_name:string,visibility:string,signature:string,line_number:bigint,end_line:bigint,is_async:boolean,is_method:boolean,docstring:string,return_type:string,decorators:array<string>,calls:{_SITE},function_refs:{_SITE},references:{_SITE},parameters:array<struct<name:string,type_annotation:string,kind:string>>,branch_count:bigint,param_count:bigint,max_nesting:bigint,is_recursive:boolean,procedure_names:array<string>,nesting_depth:bigint,owner:string,metadata:map<string,string>>"
FACTS = (
    f"functions array<{FUNCTION}>, classes array<struct<name:string,qualified_name:string,kind:string,line_number:bigint,end_line:bigint,docstring:string,decorators:array<string>,metadata:map<string,string>>>, "
    "constants array<struct<name:string,qualified_name:string,kind:string,owner:string,line_number:bigint,value_preview:string>>, relations array<struct<source:string,target:string,relation:string>>, "
    f"imports {_SITE}, elements array<struct<tag:string,qualified_name:string,line_number:bigint,column:bigint,text:string,parent:string>>, selectors array<struct<name:string,qualified_name:string,line_number:bigint>>, "
    "transfers array<struct<caller:string,target:string,kind:string,line:bigint>>, sites array<struct<caller:string,target:string,opcode:string,access:string,line:bigint>>, submodules array<string>, "
    "fields array<struct<owner:string,name:string,type:string,visibility:string,default:string,line:bigint,place:bigint>>"
)


def _left_out(spark: SparkSession, top: str) -> DataFrame:
    """rel, length, content of the files that Spark's readers leave out: empty ones, and those with a name or folder that begins with `_` (`__init__.py`).

    The driver lists names, as it does for Spark's readers; tasks read the contents by Arrow's file systems. Where Arrow knows no file system for the tree's
    address, empty files are found by Spark's own list, and names with `_` stay out."""
    import pyarrow as pa
    from pyarrow import fs as afs

    schema = "rel string, length long, modification_time timestamp, content binary"
    try:
        store, base = afs.FileSystem.from_uri(top if "://" in top else "file://" + os.path.abspath(top.removeprefix("file:")))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        listed = spark.createDataFrame([(unquote(f),) for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top).inputFiles()], "rel string")
        return listed.select(below("rel", top).alias("rel"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modification_time"), F.lit(b"").alias("content"))
    infos = ((i.path[len(base) :].strip("/"), i.size, i.mtime) for i in store.get_file_info(afs.FileSelector(base, recursive=True)) if i.is_file)
    found = [x for x in infos if not x[1] or any(s.startswith("_") for s in x[0].split("/"))]

    def run(batches):
        for batch in batches:
            for row, (rel, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                content = b""
                if length:
                    with store.open_input_stream(f"{base}/{rel}") as f:
                        content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([len(content)], pa.int64()), batch.column(2).slice(row, 1), pa.array([content], pa.binary())], ["rel", "length", "modification_time", "content"])

    return spark.createDataFrame(found, "rel string, length long, modification_time timestamp").mapInArrow(run, schema)


def below(path: str, top: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^.*?" + "\\Q" + top.removeprefix("file://") + "\\E/", "")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), length, modification_time, content of all files, but for hidden and generated directories. The root itself is never skipped."""
    top = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top).where("length > 0")
    files = files.select(below("path", top).alias("path"), "length", F.col("modificationTime").alias("modification_time"), "content")
    more = _left_out(spark, top).withColumnRenamed("rel", "path").join(files.select("path"), "path", "left_anti")
    every = files.unionByName(more)
    parts = F.split("path", "/")
    skipped = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda s: s.startswith(".") | s.isin(*SKIPPED))
    return every.where(~skipped & ~F.element_at(parts, -1).startswith("."))


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return table[F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)]


def is_test(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in ("test", "tests", "__tests__", "spec", "specs")))) | path.rlike(r"(?:^|/)test_[^/]*\.py$|_test\.(?:py|go|dart)$|\.(?:test|spec)\.[jt]sx?$|Tests?\.(?:java|cs|swift)$")


def folders(path: Column) -> Column:
    """Folders above a path, the tree's own ("") last."""
    up = R.prefixes(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/")
    return F.array_distinct(F.concat(up, F.array(F.lit(""))))


def sources(spark: SparkSession, root: str, scope: DataFrame | None = None) -> DataFrame:
    """Files in a supported language; `.h` files are C++ where the tree has C++ files. scope: the folders (path) whose files count, none inside another."""
    found = walk(spark, root).withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    if scope is not None:
        held = found.select("path", F.explode(folders(F.col("path"))).alias("_root")).join(scope.select(F.col("path").alias("_root")), "_root", "left_semi")
        found = found.join(held.select("path"), "path", "left_semi")
    cpp = found.agg(F.coalesce(F.max(F.col("language") == "cpp"), F.lit(False)).alias("_cpp"))  # one row
    return found.crossJoin(F.broadcast(cpp)).withColumn("language", F.when(F.col("_cpp") & F.col("path").endswith(".h"), "cpp").otherwise(F.col("language"))).drop("_cpp")


def facts(spark: SparkSession, root: str, max_loc: int | None = None, include_tests: bool = True, known: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """One row per file: path, filename, digest (of its content), language, loc, module_path, is_test, skip_reason, annotations and the fact lists.

    scope: the folders that count (see `sources`).
    known: facts of an earlier state of this tree, made with the same arguments. Files that have the same path, content and language as there aren't parsed again.

    Files that are too large, generated, or don't parse have no facts and say why."""
    import pyarrow as pa

    name = os.path.basename(root.rstrip("/"))
    found = sources(spark, root, scope).withColumn("is_test", is_test(F.col("path"))).withColumn("digest", F.sha2("content", 256))
    if not include_tests:
        found = found.where("NOT is_test")
    same = ["path", "digest", "language"]
    todo = found if known is None else found.join(known.select(*same), same, "left_anti")

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text, reason, got = content.decode("utf-8", "replace"), None, {}
                lines = X.loc(text)
                if max_loc is not None and lines > max_loc:
                    reason = "too_large"
                elif X.generated(text):
                    reason = "generated"
                else:
                    try:
                        got = X.extract(path, text, name, language)
                    except (SyntaxError, ValueError, RecursionError) as e:
                        reason = f"unparsed: {type(e).__name__}"
                rows.append((path, lines, X.module_of(path, text, name, language), reason, X.annotations(text), json.dumps(got)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("line", pa.int64())])), pa.string())
            names = ["path", "loc", "module_path", "skip_reason", "annotations", "facts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names)

    parsed = todo.select("path", "language", "content").repartition(max(1, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, "path string, loc bigint, module_path string, skip_reason string, annotations array<struct<kind:string,text:string,line:bigint>>, facts string")
    shown = parsed.join(todo.select("path", "digest", "language", "is_test"), "path")
    new = shown.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "digest", "language", "loc", "module_path", "is_test", "skip_reason", "annotations", F.from_json("facts", FACTS).alias("f")).select("*", "f.*").drop("f")
    return new if known is None else new.unionByName(known.join(found.select(*same), same, "left_semi"))


def snapshot(repo: str, rev: str, into: str) -> str:
    """The tree of a git revision, in a folder of the repository's own name (ids begin with it)."""
    at = os.path.join(into, rev.replace("/", "_"), os.path.basename(os.path.abspath(repo)))
    os.makedirs(at, exist_ok=True)
    archive = subprocess.run(["git", "-C", repo, "archive", "--format=tar", rev], check=True, capture_output=True)
    subprocess.run(["tar", "-x", "-C", at], input=archive.stdout, check=True)
    return at
