"""Bases of types: which of several types of one name a declaration means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import settled
from loomgraph.operators.resolve import unique_match

#: Labels that are implemented rather than extended.
INTERFACES = ("Interface", "Trait", "Protocol")
#: What a matching kind counts, against a character of a scope.
KIND_SCORE = 100


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, r"::|[./\\]"), -1)


def scopes(typed: DataFrame, named: DataFrame) -> DataFrame:
    """source (a type's id), scope: its own namespace, and what its file imports. typed: id, file_path; named: file_path, scope."""
    own = typed.select(F.col("id").alias("source"), F.regexp_extract("id", r"^(.*)(?:::|\.|\\|/)[^.:\\/]+$", 1).alias("scope"))
    imported = typed.select(F.col("id").alias("source"), "file_path").join(named, "file_path").select("source", "scope")
    return own.unionByName(imported).where("scope <> ''").distinct()


def nearest_types(sites: DataFrame, typed: DataFrame, scope: DataFrame) -> DataFrame:
    """sites (source, target, prefers_interface) -> those columns with score, dst, dst_label: of the types of the target's last name the one that scores best.

    100 for the preferred kind, and the length of the longest scope of the source that the type's id goes on from by a dot. Of equals the last counts, interfaces
    behind the others, by id. Types are first reduced to one a name, kind and beginning of the id (the last; it scores no less there than the others),
    so that a name that many types have and many sites ask for doesn't meet in pairs: a site meets two rows for each of its scopes."""
    parts = F.split("id", r"\.")
    begins = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    kinds = typed.select("id", F.col("title").alias("short"), "label", F.col("label").isin(*INTERFACES).alias("interface"), F.explode(begins).alias("scope"))
    last = kinds.groupBy("short", "interface", "scope").agg(F.max(F.struct("id", "label")).alias("t"))
    asked = sites.withColumn("short", _last(F.col("target")))
    at = asked.withColumn("scope", F.lit("")).unionByName(asked.join(scope, "source"))
    score = F.when(F.col("interface") == F.col("prefers_interface"), KIND_SCORE).otherwise(0) + F.length("scope")
    best = at.join(last, ["short", "scope"]).groupBy(*sites.columns).agg(F.max(F.struct(score.alias("score"), "interface", "t")).alias("b"))
    return best.select(*sites.columns, F.col("b.score").alias("score"), F.col("b.t.id").alias("dst"), F.col("b.t.label").alias("dst_label"))


def type_edges(relations: DataFrame, typed: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EXTENDS and IMPLEMENTS (type, src, dst, src_label, dst_label), and the types outside the tree that they lead to (id, title, label).

    relations: source, target, relation; typed: id, title, label, file_path; named: file_path, scope (what files import). A target that is a type's id
    is that type; else the nearest type of its name; else it stands for itself, as a Trait if implemented and as a Class if extended. To extend an
    interface is to implement it, unless by an interface. A source that is no type's id is the only type of its name."""
    known = settled(typed.select("id", "title", "label", "file_path").distinct())
    ids = known.select(F.col("id").alias("source"), F.col("label").alias("src_label"))
    relations = relations.distinct()
    direct = relations.join(ids, "source")
    other = unique_match(relations.join(ids, "source", "left_anti").withColumn("title", _last(F.col("source"))).drop("source"), known.select("title", F.col("id").alias("source")), "title", "source")
    sites = settled(direct.unionByName(other.join(ids, "source").drop("title")).withColumn("prefers_interface", F.col("relation") != "extends").distinct())
    exact = sites.join(known.select(F.col("id").alias("target"), F.col("label").alias("dst_label")), "target").withColumn("dst", F.col("target"))
    rest = sites.join(known.select(F.col("id").alias("target")), "target", "left_anti")
    near = nearest_types(rest, known, scopes(known, named)).drop("score").where("source <> dst")
    inside = exact.unionByName(near)
    outside = rest.join(near.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti").withColumn("dst", F.col("target")).withColumn("dst_label", F.when(F.col("prefers_interface"), "Trait").otherwise("Class"))
    every = settled(inside.unionByName(outside))
    to_interface = F.col("dst_label").isin(*INTERFACES) & ~F.col("src_label").isin(*INTERFACES)
    kind = F.when(F.col("prefers_interface") | to_interface, "IMPLEMENTS").otherwise("EXTENDS")
    edges = every.select(kind.alias("type"), F.col("source").alias("src"), "dst", "src_label", "dst_label").where("src <> dst").distinct()
    stubs = every.join(known.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.max("dst_label").alias("label"))
    return edges, stubs.select(F.col("dst").alias("id"), _last(F.col("dst")).alias("title"), "label")
