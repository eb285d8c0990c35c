"""Property graphs as tables: one DataFrame per node label, one per (edge type, source label, target label)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import forget, settled

EdgeKey = tuple[str, str, str]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def one_edge_per_pair(edges: DataFrame, site: str | None = None) -> DataFrame:
    """Edges (src, dst[, site]) -> one row per pair; sites become a sorted, distinct, comma-joined list and a count."""
    if site is None:
        return edges.select("src", "dst").distinct()
    sites = F.array_sort(F.collect_set(site))
    return edges.groupBy("src", "dst").agg(F.array_join(sites.cast("array<string>"), ",").alias("sites"), F.size(sites).cast("long").alias("site_count"))


class Lazy(dict):
    """A dict of tables or of functions that make them; a table is made when it is first asked for."""

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if callable(value):
            value = self[key] = value()
        return value

    def items(self):
        return [(k, self[k]) for k in self]

    def values(self):
        return [self[k] for k in self]


@dataclass
class PropertyGraph:
    """Node tables have `id` and usually `title`; edge tables have `src`, `dst` and properties."""

    node_tables: dict[str, DataFrame] = field(default_factory=dict)
    edge_tables: dict[EdgeKey, DataFrame] = field(default_factory=dict)

    def labels(self) -> list[str]:
        return sorted(self.node_tables)

    def types(self) -> list[str]:
        return sorted({t for t, _, _ in self.edge_tables})

    def nodes(self, label: str | None = None) -> DataFrame:
        """A label's table, or the union of all, with a `label` column."""
        if label is not None:
            if label not in self.node_tables:
                raise KeyError(f"no label {label}; there are {self.labels()}")
            return self.node_tables[label].withColumn("label", F.lit(label))
        return union_all([t.withColumn("label", F.lit(x)) for x, t in sorted(self.node_tables.items())])

    def keys(self, types: tuple[str, ...] = (), src: str | None = None, dst: str | None = None) -> list[EdgeKey]:
        return sorted(k for k in self.edge_tables if (not types or k[0] in types) and src in (None, k[1]) and dst in (None, k[2]))

    def edges(self, types: tuple[str, ...] = (), src: str | None = None, dst: str | None = None) -> DataFrame:
        """Edges of the types between the labels (any, where not given), with type, src_label and dst_label."""
        found = self.keys(types, src, dst)
        if not found:
            raise KeyError(f"no edges {types or ''} from {src} to {dst}")
        return union_all([self.edge_tables[k].withColumns({"type": F.lit(k[0]), "src_label": F.lit(k[1]), "dst_label": F.lit(k[2])}) for k in found])

    def pairs(self, *types: str) -> DataFrame:
        """src, dst only: the scan reads two columns."""
        return union_all([self.edge_tables[k].select("src", "dst") for k in self.keys(types)])

    def label_pair_counts(self) -> DataFrame:
        """src_type, edge_type, tgt_type, count of every edge table. Each table is counted by itself; nothing is joined."""
        return union_all([t.agg(F.count("*").alias("count")).select(F.lit(k[1]).alias("src_type"), F.lit(k[0]).alias("edge_type"), F.lit(k[2]).alias("tgt_type"), "count") for k, t in sorted(self.edge_tables.items())])

    def schema(self) -> dict[str, dict[str, str]]:
        """Property types of each label and edge type."""
        out = {x: dict(t.dtypes) for x, t in self.node_tables.items()}
        for (t, s, d), table in self.edge_tables.items():
            out[f"{s}-{t}->{d}"] = {c: k for c, k in table.dtypes if c not in ("src", "dst")}
        return out

    def describe(self) -> str:
        lines = [f"{len(self.node_tables)} node labels, {len(self.types())} edge types"]
        for name, columns in sorted(self.schema().items()):
            lines.append(f"{name}: " + ", ".join(f"{c} {k}" for c, k in columns.items()))
        return "\n".join(lines)


def degree(edges: DataFrame, end: str) -> DataFrame:
    """id, degree counted at one end (`src`: out, `dst`: in)."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, end: str, n: int = 1) -> DataFrame:
    """The n nodes of the highest degree; ties by id."""
    return degree(edges, end).orderBy(F.desc("degree"), "id").limit(n)


def neighbours(edges: DataFrame, anchors: DataFrame, reverse: bool = False) -> DataFrame:
    """(id) anchors -> anchor, id one hop away. The join starts from the anchors; Spark broadcasts them if they are few."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    return anchors.select(F.col("id").alias("anchor")).join(edges.select(F.col(near).alias("anchor"), F.col(far).alias("id")), "anchor")


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int | None, reverse: bool = False, include_seeds: bool = False, settle_after: int = 3) -> DataFrame:
    """Distinct nodes within 1..max_hops directed hops of any seed (None: any number): id, hops (the fewest).

    Each step expands the frontier of nodes not met before, so work is bounded by nodes and edges, not by paths. With a least
    hop count of one and distinct ends this equals trail semantics. A seed is met again only by a closed trail."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(near).alias("id"), F.col(far).alias("next"))
    frontier, met = seeds.select("id").distinct(), None
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        found = frontier.join(steps, "id").select(F.col("next").alias("id")).distinct()
        if met is not None:
            found = found.join(met, "id", "left_anti")
        new = found.withColumn("hops", F.lit(hop))
        met = new if met is None else met.unionByName(new)
        if hop % settle_after == 0 and (max_hops is None or hop < max_hops):
            met = settled(met)
            frontier = met.where(F.col("hops") == hop).select("id")
            if frontier.isEmpty():
                break
        else:
            frontier = new.select("id")
    if include_seeds:
        met = seeds.select("id").distinct().withColumn("hops", F.lit(0)).unionByName(met.join(seeds.select("id").distinct(), "id", "left_anti"))
    return met


def trails(edges: DataFrame, seeds: DataFrame, min_hops: int, max_hops: int, reverse: bool = False) -> DataFrame:
    """All trails of min_hops..max_hops edges from the seeds: start, id (the end), hops, path (nodes). No edge is used twice in one."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(near).alias("near"), F.col(far).alias("far"), F.struct("src", "dst").alias("edge"))
    now = seeds.select(F.col("id").alias("start"), "id", F.array("id").alias("path"), F.array().cast(f"array<{steps.schema['edge'].dataType.simpleString()}>").alias("used"))
    out = [now.withColumn("hops", F.lit(0))] if min_hops == 0 else []
    for hop in range(1, max_hops + 1):
        now = now.join(steps, now["id"] == steps["near"]).where(~F.array_contains("used", F.col("edge"))).select("start", F.col("far").alias("id"), F.array_append("path", F.col("far")).alias("path"), F.array_append("used", F.col("edge")).alias("used"))
        if hop >= min_hops:
            out.append(now.withColumn("hops", F.lit(hop)))
    return union_all(out).select("start", "id", "hops", "path")


#: Pairs, and pairs a node, from which on it's tried whether nodes that reach each other can be merged.
SMALL, DENSE = 1 << 16, 8
#: Nodes of a group that are written out together, and pairs that a task writes out of groups; of groups with more than 512 parts and of results for more than 16384 tasks both are larger.
PART, TASK = 256, 1 << 20


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure (src, dst), without pairs of a node with itself.

    Path lengths double until nothing is new. Joining all pairs with all pairs would find each of them over and over where many nodes reach each other; such nodes are
    merged into one as soon as that saves pairs, and the search begins anew between what is left. At the end a pair of groups becomes the pairs of their nodes."""
    steps, groups = settled(edges.select("src", "dst").where("src <> dst").distinct()), None
    if steps.count() > SMALL // 16 and (chains := _chains(steps)) is not None:
        _, found = _closed(settled(_renamed(steps, chains)), None, 0)
        if found is not None:
            groups = settled(_of_chains(chains, found))
            last, steps = steps, settled(_renamed(steps, groups))
            forget(last, found)
        forget(chains)
    pairs, groups = _closed(steps, groups, SMALL)
    return pairs if groups is None else _written_out(pairs, groups)


def _closed(steps: DataFrame, groups: DataFrame | None, small: int) -> tuple[DataFrame, DataFrame | None]:
    """All pairs of what is left of the nodes, and the (id, group) of those that were merged; groups: those merged before."""
    while True:
        pairs, merged = _doubled(steps, small)
        if merged is None:
            return pairs, groups
        further, fewer = settled(merged if groups is None else _onward(groups, merged)), settled(_renamed(steps, merged))
        forget(steps, groups, pairs, merged)
        steps, groups = fewer, further


def _chains(steps: DataFrame, jumps: int = 10) -> DataFrame | None:
    """(id, group) of all nodes, where a node with one way in goes with the node before it if that has one way out; None if at least half as many groups as nodes are left.

    A group is a stretch of a chain of at most 2^jumps nodes. All nodes of a chain are in one larger circle, or none is."""
    only = lambda end: steps.groupBy(end).agg(F.count("*").alias("n")).where("n = 1").select(end)
    before = steps.join(only("src"), "src").join(only("dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("before"))
    nodes = steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct()
    groups = settled(nodes.join(before, "id", "left").select("id", F.coalesce("before", "id").alias("group")))
    n, left = groups.count(), groups.select("group").distinct().count()
    for _ in range(jumps):
        last, groups = groups, settled(_onward(groups, groups))
        forget(last)
        if (fewer := groups.select("group").distinct().count()) == left:
            break
        left = fewer
    if 2 * left >= n:
        forget(groups)
        return None
    return groups


def _of_chains(chains: DataFrame, found: DataFrame) -> DataFrame:
    """(id, group) of all nodes from the groups of their chains; nodes of chains that weren't merged stay by themselves. A group has the name of one of its nodes."""
    several = found.join(found.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "group").select(F.col("id").alias("group"), F.col("group").alias("to"))
    merged = chains.join(several, "group", "left")
    names = merged.where("to IS NOT NULL").groupBy("to").agg(F.min("id").alias("name"))
    return merged.join(names, "to", "left").select("id", F.coalesce("name", "id").alias("group"))


def _doubled(steps: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """All pairs (src, dst) and None; or pairs that aren't whole, and (id, group) of all nodes, where merging nodes that reach each other saves a quarter of the pairs.

    `far` is 2 for pairs as many steps apart as were looked at so far, else less. Pairs that far apart are joined with all pairs: each new one is a pair
    that is exactly so far apart, then any rest, so that few are found twice."""
    nodes = settled(steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct().select("id", F.col("id").alias("group")))
    n, pairs = nodes.count(), settled(steps.withColumn("far", F.lit(2)))
    while True:
        count, farthest = pairs.agg(F.count("*"), F.count_if(F.col("far") == 2)).first()
        if not farthest:
            forget(nodes)
            return pairs.select("src", "dst"), None
        if count > max(small, DENSE * n) and (merged := _merged(pairs, count, nodes)) is not None:
            forget(nodes)
            return pairs, merged
        ends = pairs.where("far = 2").select("src", F.col("dst").alias("mid")).join(pairs.select(F.col("src").alias("mid"), "dst", "far"), "mid").where("src <> dst")
        found = ends.select("src", "dst", F.when(F.col("far") == 2, 2).otherwise(1).alias("far"))
        last, pairs = pairs, settled(pairs.withColumn("far", F.lit(0)).unionByName(found).groupBy("src", "dst").agg(F.min("far").alias("far")))
        forget(last)


def _merged(pairs: DataFrame, count: int, nodes: DataFrame) -> DataFrame | None:
    """(id, group) of all nodes, where nodes of a group reach each other; None if that leaves more than three quarters of the pairs."""
    left, n, groups = pairs, count, nodes
    while True:
        # Of the nodes that it reaches and that reach it a node takes the least: all that take the same one reach each other by it.
        same = settled(left.join(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("group")).where("id <> group"))
        if same.isEmpty():
            forget(same)
            break
        further, fewer = settled(_onward(groups, same)), settled(_renamed(left, same))
        forget(same, *(x for x in (left, groups) if x is not pairs and x is not nodes))
        left, groups, before, n = fewer, further, n, fewer.count()
        if n > 0.98 * before:  # hardly any: the next doubling finds more
            break
    if left is not pairs:
        forget(left)
    if n > 0.75 * count:
        if groups is not nodes:
            forget(groups)
        return None
    return groups


def _onward(groups: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, group), where groups are themselves merged into others."""
    return groups.join(merged.select(F.col("id").alias("group"), F.col("group").alias("to")), "group", "left").select("id", F.coalesce("to", "group").alias("group"))


def _renamed(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """Distinct pairs of the groups that nodes are merged into, without pairs within one."""
    for end in ("src", "dst"):
        pairs = pairs.join(merged.select(F.col("id").alias(end), F.col("group").alias(f"{end}_to")), end, "left")
    return pairs.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst")).where("src <> dst").distinct()


def _written_out(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of groups as pairs of their nodes, and those within a group. Groups are cut into parts, so the pairs of a large one are made by many tasks."""
    sizes = settled(groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.least(F.ceil(F.col("n") / PART), F.lit(512))))
    ids = groups.join(sizes, "group").groupBy("group", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list("id").alias("ids"))
    both = pairs.unionByName(sizes.select(F.col("group").alias("src"), F.col("group").alias("dst")))
    for end in ("src", "dst"):
        both = both.join(sizes.select(F.col("group").alias(end), F.col("n").alias(f"{end}_n"), F.col("parts").alias(f"{end}_parts")), end, "left")
    both, alone = settled(both), F.col("src_n").isNull() & F.col("dst_n").isNull()
    many = both.where(~alone)
    total = many.agg(F.sum(F.coalesce("src_n", F.lit(1)).cast("double") * F.coalesce("dst_n", F.lit(1)))).first()[0] or 0
    for end in ("src", "dst"):
        many = many.withColumn(f"{end}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{end}_parts", F.lit(1)) - 1)))
    for end in ("src", "dst"):
        many = many.join(ids.select(F.col("group").alias(end), F.col("part").alias(f"{end}_part"), F.col("ids").alias(f"{end}_ids")), [end, f"{end}_part"], "left")
        many = many.withColumn(f"{end}_ids", F.when(F.col(f"{end}_n").isNull(), F.array(end)).otherwise(F.col(f"{end}_ids")))
    many = many.select("src_ids", "dst_ids").repartition(min(1 + int(total / TASK), 1 << 14))
    made = many.select(F.explode("src_ids").alias("src"), "dst_ids").select("src", F.explode("dst_ids").alias("dst")).where("src <> dst")
    return both.where(alone).select("src", "dst").unionByName(made)


def full_match(text: Column, pattern: str) -> Column:
    """A regular expression that has to match the whole text."""
    return text.rlike(f"^(?:{pattern})$")


def digest(df: DataFrame) -> DataFrame:
    """rows, digest: of the rows in any order; equal for equal multisets. Sums of hash parts, so nothing is sorted or gathered."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)))
    h = F.sha2(text.cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.concat_ws("-", *(part(i).cast("string") for i in range(4))), F.lit("")).alias("digest"))
