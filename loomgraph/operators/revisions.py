"""Graphs of several revisions in one: membership lists, fingerprints and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, fields: list[str], out: str = "fp") -> DataFrame:
    """A hash of the named fields; 0 without fields. Values are compared only within one graph."""
    return df.withColumn(out, F.xxhash64(*(c for f in fields for c in (F.lit(f), F.col(f)))) if fields else F.lit(0).cast("long"))


def merge_nodes(revisions: list[tuple[str, DataFrame]], keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the newest revision's columns, revs (in order) and rev_fp (aligned with revs).

    A key that a revision has several times gets one fingerprint of all of them. One aggregation, however many revisions."""
    every = None
    for n, (rev, df) in enumerate(revisions):
        one = fingerprint(df, fields).select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("_row"), "fp", F.lit(n).alias("_n"), F.lit(rev).alias("_rev"))
        every = one if every is None else every.unionByName(one)
    per_rev = every.groupBy(*keys, "_n", "_rev").agg(F.max("_row").alias("_row"), F.count("*").alias("_many"), F.min("fp").alias("_fp"), F.array_sort(F.collect_list("fp")).alias("_fps"))
    per_rev = per_rev.withColumn("fp", F.when(F.col("_many") == 1, F.col("_fp")).otherwise(F.xxhash64("_fps")))
    merged = per_rev.groupBy(*keys).agg(F.max_by("_row", "_n").alias("_row"), F.array_sort(F.collect_list(F.struct("_n", "_rev", "fp"))).alias("_list"))
    return merged.select(*keys, "_row.*", F.transform("_list", lambda x: x["_rev"]).alias("revs"), F.transform("_list", lambda x: x["fp"]).alias("rev_fp"))


def merge_edges(revisions: list[tuple[str, DataFrame]]) -> DataFrame:
    """type, src, dst and revs in order."""
    every = None
    for n, (rev, df) in enumerate(revisions):
        one = df.select("type", "src", "dst", F.lit(n).alias("_n"), F.lit(rev).alias("_rev"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("type", "src", "dst").agg(F.transform(F.array_sort(F.collect_set(F.struct("_n", "_rev"))), lambda x: x["_rev"]).alias("revs"))


def available(merged: DataFrame) -> list[str]:
    return sorted(r[0] for r in merged.select(F.explode("revs")).distinct().collect())  # as many as there are revisions


def rev_diff(merged: DataFrame, old: str, new: str, check: bool = False) -> DataFrame:
    """merged's rows with bucket: added, removed (by membership) or changed (fingerprints differ). `check` names the revisions of an unknown one."""
    if "revs" not in merged.columns:
        raise ValueError("the graph has one revision only")
    if check and (missing := {old, new} - set(available(merged))):
        raise ValueError(f"no revisions {sorted(missing)}; there are {available(merged)}")
    had, has = F.array_contains("revs", old), F.array_contains("revs", new)
    at = lambda rev: F.try_element_at("rev_fp", F.array_position("revs", rev).cast("int"))
    bucket = F.when(has & ~had, "added").when(had & ~has, "removed").when(had & has & (at(old) != at(new)), "changed")
    return merged.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())


def graph_diff(old: DataFrame, new: DataFrame, keys: list[str], loose: list[str], place: str, fields: list[str]) -> DataFrame:
    """bucket, the keys, old_<place>, new_<place>, fields_changed of two node tables.

    First by keys; what is left over is paired by the `loose` columns where those are unique on both sides: moved. A new name
    for the same thing is removed and added."""
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in dict.fromkeys([place, *loose, *fields]) if c not in keys], F.lit(True).alias("_a"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in dict.fromkeys([place, *loose, *fields]) if c not in keys], F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    names = lambda c: F.col(c) if c in keys else None
    differ = F.array_compact(F.array(*(F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields)))
    changed = both.where("_a AND _b").select(F.lit("changed").alias("bucket"), *keys, f"old_{place}", f"new_{place}", F.array_join(differ, ",").alias("fields_changed")).where("fields_changed <> ''")
    side = lambda mine, other, tag: both.where(f"{mine} AND {other} IS NULL").select(*keys, F.col(f"{tag}_{place}"), *[(names(c) if names(c) is not None else F.col(f"{tag}_{c}")).alias(f"_l_{c}") for c in loose])
    gone, came = side("_a", "_b", "old"), side("_b", "_a", "new")
    link = [f"_l_{c}" for c in loose]
    once = lambda df: df.groupBy(*link).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in df.columns if c not in link]).where("_n = 1").drop("_n")
    g, c = once(gone), once(came)
    pairs = g.select(*link, *[F.col(k).alias(f"_g_{k}") for k in keys], f"old_{place}").join(c.select(*link, *[F.col(k).alias(f"_c_{k}") for k in keys], f"new_{place}"), link)
    moved = pairs.select(F.lit("moved").alias("bucket"), *[F.col(f"_c_{k}").alias(k) for k in keys], f"old_{place}", f"new_{place}", F.lit("").alias("fields_changed"))
    none = F.lit(None).cast(old.schema[place].dataType)
    removed = gone.join(pairs.select(*[F.col(f"_g_{k}").alias(k) for k in keys]), keys, "left_anti").select(F.lit("removed").alias("bucket"), *keys, f"old_{place}", none.alias(f"new_{place}"), F.lit("").alias("fields_changed"))
    added = came.join(pairs.select(*[F.col(f"_c_{k}").alias(k) for k in keys]), keys, "left_anti").select(F.lit("added").alias("bucket"), *keys, none.alias(f"old_{place}"), f"new_{place}", F.lit("").alias("fields_changed"))
    return changed.unionByName(moved).unionByName(removed).unionByName(added)


def match_entities(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and status: matched, only_a or only_b."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("matched").alias("status"))
