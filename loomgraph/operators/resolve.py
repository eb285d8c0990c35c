"""Kernels of entity resolution, for any tables.

References are matched with definitions by keys; these functions say which of several candidates count. Every "first" and
"last" takes an explicit order column, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key by a total order. Aggregates before the shuffle; rows aren't sorted."""
    whole = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*df.columns).alias("row"))
    return df.groupBy(*keys).agg(F.max(whole).alias("_last")).select("_last.row.*")


def overload_ids(df: DataFrame, name: str, signature: str, out: str = "entity_id") -> DataFrame:
    """name, or name#sha256(signature) where the name has more than one signature."""
    several = df.select(name, signature).distinct().groupBy(name).agg((F.count("*") > 1).alias("_several"))
    with_id = F.when(F.col("_several"), F.concat_ws("#", F.col(name), F.sha2(F.col(signature).cast("binary"), 256))).otherwise(F.col(name))
    return df.join(several, name).withColumn(out, with_id).drop("_several")


def nested_twins(df: DataFrame, keys: list[str], line: str, name: str, nested: Column) -> DataFrame:
    """The second and later nested definitions of one name in a file get `#line` behind the name."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    return df.withColumn(name, F.when(nested & (n > 1), F.concat_ws("#", F.col(name), F.col(line).cast("string"))).otherwise(F.col(name)))


def tiered_narrow(candidates: DataFrame, site: list[str], tiers: list[tuple[str, Column]], limit: int | None, start: str = "unique_name") -> DataFrame:
    """Candidates of each site narrowed tier by tier: a tier's condition replaces the set only if some candidate meets it.

    A site with one candidate is settled at once as `start`. Adds tier (the last that narrowed, `start` if none did) and
    candidates (how many are left); sites with more than `limit` left are dropped. All windows share one partitioning: one shuffle."""
    w = Window.partitionBy(*site)
    df = candidates.withColumn("_keep", F.lit(True)).withColumn("_n", F.count("*").over(w)).withColumn("tier", F.lit(start))
    alone = F.col("_n") == 1
    for name, condition in tiers:
        met = F.col("_keep") & F.coalesce(condition, F.lit(False))
        df = df.withColumn("_any", F.max(met).over(w)).withColumn("_left", F.sum(F.col("_keep").cast("int")).over(w))
        narrows = F.col("_any") & (F.col("_left") > 1) & ~alone
        df = df.withColumn("tier", F.when(narrows, F.lit(name)).otherwise(F.col("tier"))).withColumn("_keep", F.when(narrows, met).otherwise(F.col("_keep")))
    left = df.where("_keep").withColumn("candidates", F.count("*").over(w))
    if limit is not None:
        left = left.where(F.col("candidates") <= limit)
    return left.drop("_keep", "_n", "_any", "_left")


def tiered_match(sites: DataFrame, definitions: DataFrame, site: list[str], name: str, tiers: list[tuple[str, str]], limit: int, start: str = "unique_name") -> DataFrame:
    """sites joined with the definitions of their name, narrowed as by tiered_narrow, where each tier asks that one column is equal on both sides.

    Definitions are counted by name and each choice of the tiers' columns. The counts tell a site's tier and how many candidates are left, so only the
    candidates of sites with at most `limit` of them are ever joined, not all candidates of all sites. Columns of both sides, those of the tiers from the sites."""
    choices = range(2 ** len(tiers))
    chosen = lambda c: [name, *(column for i, (_, column) in enumerate(tiers) if c >> i & 1)]
    df = sites
    for c in choices:
        df = df.join(definitions.groupBy(*chosen(c)).agg(F.count("*").alias(f"_{c}")), chosen(c), "left")
    w = Window.partitionBy(*site)
    df = df.withColumn("_n", F.array(*(F.coalesce(F.sum(f"_{c}").over(w), F.lit(0)) for c in choices))).withColumn("_by", F.lit(0)).withColumn("tier", F.lit(start))
    for i, (tier, _) in enumerate(tiers):
        narrows = (F.get("_n", F.col("_by").bitwiseOR(F.lit(1 << i))) > 0) & (F.get("_n", "_by") > 1)
        df = df.withColumn("tier", F.when(narrows, F.lit(tier)).otherwise(F.col("tier"))).withColumn("_by", F.when(narrows, F.col("_by").bitwiseOR(F.lit(1 << i))).otherwise(F.col("_by")))
    left = df.withColumn("candidates", F.get("_n", "_by")).where(F.col("candidates").between(1, limit)).drop("_n", *(f"_{c}" for c in choices))
    # A column that wasn't chosen is null in the key on both sides; what is chosen and null is equal to nothing.
    column = lambda i, column: F.when(F.col("_by").bitwiseAND(F.lit(1 << i)) > 0, F.col(column))
    key = F.struct("_by", name, *(column(i, x).alias(f"_{i}") for i, (_, x) in enumerate(tiers)))
    known = definitions.where(F.col(name).isNotNull()).withColumn("_by", F.explode(F.array(*(F.lit(c) for c in choices))))
    for i, (_, x) in enumerate(tiers):
        known = known.where((F.col("_by").bitwiseAND(F.lit(1 << i)) == 0) | F.col(x).isNotNull())
    known = known.withColumn("_key", key).drop("_by", name, *(x for _, x in tiers))
    return left.withColumn("_key", key).drop("_by").join(known, "_key").drop("_key")


def first_candidate(sites: DataFrame, site: list[str], generated: str, known: DataFrame, key: str) -> DataFrame:
    """sites with an array of generated names, best first -> the first name that is known: site columns, key. Sites without one have no row."""
    named = sites.select(*site, F.posexplode(generated).alias("_at", key))
    return named.join(known.select(key).distinct(), key).groupBy(*site).agg(F.min_by(key, "_at").alias(key))


def unique_match(sites: DataFrame, definitions: DataFrame, key: str, target: str) -> DataFrame:
    """sites joined with the definitions whose key has exactly one target; ambiguous keys match nothing."""
    one = definitions.select(key, target).distinct().groupBy(key).agg(F.count("*").alias("_n"), F.first(target).alias(target)).where("_n = 1").drop("_n")
    return sites.join(one, key)


def scored_best(candidates: DataFrame, site: list[str], score: Column, order: list[str], target: str) -> DataFrame:
    """The candidate of the highest score for each site; of equals the last by `order`, which has to be total."""
    return candidates.withColumn("_score", score).groupBy(*site).agg(F.max(F.struct("_score", *order, F.col(target).alias("_target"))).alias("_best")).select(*site, F.col("_best._score").alias("score"), F.col("_best._target").alias(target))


def segment_match(paths: DataFrame, path: str, templates: DataFrame, template: str) -> DataFrame:
    """Paths with the templates that fit: as many segments, each equal or a wildcard `{...}`, `:name` or `<...>`.

    The join's key is the number of segments and the first literal segment of the template among the path's, so that no path meets all templates."""
    split = lambda c: F.filter(F.split(F.split(c, "[?#]")[0], "/"), lambda s: s != "")
    wild = lambda s: s.rlike(r"^(?:\{.*\}|:.+|<.*>)$")
    left = paths.withColumn("_p", split(F.col(path))).withColumn("_n", F.size("_p"))
    left = left.withColumn("_hook", F.explode(F.array_distinct(F.concat(F.transform("_p", lambda s, i: F.concat_ws("=", i.cast("string"), s)), F.array(F.lit("*"))))))
    right = templates.withColumn("_t", split(F.col(template))).withColumn("_n", F.size("_t"))
    literal = F.filter(F.transform("_t", lambda s, i: F.when(~wild(s), F.concat_ws("=", i.cast("string"), s))), lambda x: x.isNotNull())
    right = right.withColumn("_hook", F.coalesce(F.try_element_at(literal, F.lit(1)), F.lit("*")))
    fits = F.forall(F.zip_with("_p", "_t", lambda p, t: wild(t) | (p == t)), lambda x: x)
    return left.join(right, ["_n", "_hook"]).where(fits).drop("_n", "_hook", "_p", "_t")


def prefixes(path: Column, separator: str = "/") -> Column:
    """Every prefix of a path, the longest first."""
    parts = F.split(path, separator.replace(".", r"\."))
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def merge_sites(edges: DataFrame, keys: list[str], rank: str, candidates: str, line: str) -> DataFrame:
    """One row per pair: best rank, fewest candidates, sorted distinct lines by comma, and how many."""
    lines = F.array_sort(F.collect_set(line))
    return edges.groupBy(*keys).agg(F.min(rank).alias("best_rank"), F.min(candidates).alias("candidates"), F.array_join(lines.cast("array<string>"), ",").alias("lines"), F.size(lines).cast("long").alias("line_count"))
