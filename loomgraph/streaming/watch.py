"""Freshness of a stored graph, and rebuilding when sources change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions import store
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans import codegraph
from loomgraph.sources.docs import PRECEDENCE
from loomgraph.sources.files import language_of, walk


def fingerprint(spark: SparkSession, root: str) -> str:
    """One hash of the paths and contents of all files that count, in any order of reading. Summed per file, nothing is sorted."""
    files = walk(spark, root).where(language_of(F.col("path")).isNotNull() | F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*PRECEDENCE))
    h = files.select(F.xxhash64("path", F.sha2("content", 256)).cast("decimal(38,0)").alias("h"))
    n, total = h.agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)"))).first()
    return f"{n}:{int(total) & 0xFFFFFFFFFFFFFFFF:016x}"


def status(spark: SparkSession, path: str, root: str | None = None) -> dict:
    """verdict missing, stale or fresh, and why."""
    p = store.provenance(spark, path)
    if p is None:
        return {"verdict": "missing", "reason": "no graph is stored there"}
    if not p.get("fingerprint") or not (root or p.get("source")):
        return {"verdict": "stale", "reason": "the graph doesn't say what it was made of"}
    now = fingerprint(spark, root or p["source"])
    return {"verdict": "fresh", "reason": "sources are as they were"} if now == p["fingerprint"] else {"verdict": "stale", "reason": "sources have changed"}


def require_fresh(spark: SparkSession, path: str, root: str | None = None) -> None:
    s = status(spark, path, root)
    if s["verdict"] != "fresh":
        raise RuntimeError(f"{s['verdict']}: {s['reason']}")


def refresh(spark: SparkSession, root: str, before: str | None, after: str, **options) -> PropertyGraph:
    """The graph of a tree as it is now, parsing only what has changed: facts are read from `before` (None at first) and written to `after`.

    Facts of files that are gone or changed are dropped with all that came from them. Names are resolved anew, since a new definition can make
    a name of any file ambiguous; that is joins over the facts. options: those of `codegraph.build`, the same each time."""
    g = codegraph.build(spark, root, known=spark.read.parquet(before) if before else None, **options)
    g.facts.write.parquet(after)
    return g


def watch(spark: SparkSession, root: str, checkpoint: str, rebuild: Callable[[DataFrame], None]) -> StreamingQuery:
    """A stream over new and changed files: each batch of changed paths is handed to `rebuild` once.

    `refresh` is what a `rebuild` calls; it finds the changed files by their contents, so a batch that is handed over twice does no harm."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    changed = files.where(language_of(F.col("path")).isNotNull() | F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*PRECEDENCE)).select("path", "modificationTime")

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            rebuild(batch)

    return changed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
