"""Graphs on disk: one folder per node label and per edge table, a catalogue and a provenance file; results as text."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.graph import PropertyGraph


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at, _ = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at, jvm = _fs(spark, path)
    if not fs.exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def save(spark: SparkSession, graph: PropertyGraph, path: str, provenance: dict | None = None, allow_empty: bool = False) -> None:
    """Writes beside `path` and renames, so readers see the old graph or the new one. A graph without nodes is refused unless allowed."""
    path = path.rstrip("/")
    staged = f"{path}.staged-{int(time.time() * 1000)}"
    catalogue: dict = {"nodes": {}, "edges": []}
    for label, t in sorted(graph.node_tables.items()):
        t.write.parquet(f"{staged}/nodes/{label}")
        catalogue["nodes"][label] = spark.read.parquet(f"{staged}/nodes/{label}").count()
    fs, at, jvm = _fs(spark, staged)
    if not sum(catalogue["nodes"].values()) and not allow_empty:
        fs.delete(at, True)
        raise ValueError("the graph has no nodes")
    for (kind, src, dst), t in sorted(graph.edge_tables.items()):
        t.write.parquet(f"{staged}/edges/{kind}/{src}__{dst}")
        catalogue["edges"].append([kind, src, dst])
    _write_text(spark, f"{staged}/catalog.json", json.dumps(catalogue))
    _write_text(spark, f"{staged}/provenance.json", json.dumps(provenance or {}, sort_keys=True))
    target, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    replaced = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(at, target):
        raise OSError(f"cannot rename {staged} to {path}")
    if replaced:
        fs.delete(old, True)


def load(spark: SparkSession, path: str) -> PropertyGraph:
    text = _read_text(spark, f"{path}/catalog.json")
    if text is None:
        raise FileNotFoundError(path)
    c = json.loads(text)
    return PropertyGraph({x: spark.read.parquet(f"{path}/nodes/{x}") for x in c["nodes"]}, {(k, s, d): spark.read.parquet(f"{path}/edges/{k}/{s}__{d}") for k, s, d in c["edges"]})


def provenance(spark: SparkSession, path: str) -> dict | None:
    text = _read_text(spark, f"{path}/provenance.json")
    return None if text is None else json.loads(text)


def _cell(x: object) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def as_tsv(df: DataFrame) -> Iterator[str]:
    """Header and rows, never cut off; rows come partition by partition."""
    esc = lambda s: s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    yield "\t".join(df.columns)
    for r in df.toLocalIterator():
        yield "\t".join(esc(_cell(x)) for x in r)


def as_csv(df: DataFrame) -> Iterator[str]:
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s
    yield ",".join(df.columns)
    for r in df.toLocalIterator():
        yield ",".join(quote(_cell(x)) for x in r)


def as_json(df: DataFrame) -> Iterator[str]:
    yield from df.toJSON().toLocalIterator()


def with_csv(spark: SparkSession, graph: PropertyGraph, label: str, path: str, id_column: str) -> PropertyGraph:
    """The graph with a CSV file's rows as nodes of a further label."""
    rows = spark.read.option("header", True).csv(path)
    return PropertyGraph(graph.node_tables | {label: rows.withColumnRenamed(id_column, "id")}, graph.edge_tables)
