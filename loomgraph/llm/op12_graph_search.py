"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

Vectors are dealt to shards by a hash of id and vector. Each shard has a graph: a point is inserted by a greedy beam search
from the shard's most central point, what the search reaches is pruned, and the kept points are its edges. Pruning goes from the
nearest to the farthest and drops a point that lies `relax` times nearer to a kept one than to the point itself, so edges
lead in diverse directions. Edges get their reverse; a point with too many is pruned again. At the end points that no path
from the entry reaches get an edge from the nearest point that one reaches. Points are inserted in batches of at most the
number already there, all searches of a batch at a time.

The largest inner product is sought: a graph is built on directions and searched by inner product, which among vectors of one shard is much
the same, since they are of one level: their lengths are within a factor of 4. Equal vectors are one point of the graph with the
list of their ids.

Every query searches every shard by a beam of `beam` points; their scores are then computed in double precision from the original
vectors, component by component in order, and a query keeps its best over all shards.

A shard holds about 16 sqrt(n) rows, between 1,024 and 2^20: searches, of which there are queries times shards, so grow as n^1.5 up to
some 4 billion rows. A task holds one shard; queries stream through it in batches. What is random is a fixed sequence: reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import written

K, EVERY = 20, 20
#: Most edges of a point, width of the beam when inserting and searching, how much farther a point may be than from a kept one, points that a search expands at a time.
DEGREE, BUILD_BEAM, BEAM, RELAX, EXPAND = 32, 64, 96, 1.2, 4
#: Slots kept free for edges to points that are not reached otherwise; bytes of a search's marks of seen points, few enough for a core's cache; queries that are searched
#: at a time at least, whatever their marks take; queries of one task.
SPARE, SEEN_BYTES, LEAST_QUERIES, TASK_QUERIES = 8, 1 << 20, 64, 1 << 20


def shard_rows(n: int) -> int:
    return min(1 << 20, max(1024, int(16 * math.sqrt(n))))


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int) -> np.ndarray:
    """Points by falling inner product with each query, [queries, width], -1 where there are fewer."""
    n, step = len(x), max(LEAST_QUERIES, SEEN_BYTES // len(x))
    if len(queries) > step:
        return np.concatenate([beam_search(x, edges, entry, queries[i : i + step], width) for i in range(0, len(queries), step)])
    size = len(queries)
    ids, score, fresh = np.full((size, width), -1), np.full((size, width), -np.inf, np.float32), np.zeros((size, width), bool)
    ids[:, 0], score[:, 0], fresh[:, 0] = entry, queries @ x[entry], True
    seen = np.zeros(size * n, bool)
    seen[np.arange(size) * n + entry] = True
    live = np.arange(size)
    while len(live):
        places = np.where(fresh[live], np.arange(width), width)
        places = np.partition(places, EXPAND - 1, axis=1)[:, :EXPAND] if width > EXPAND else places
        row, column = np.nonzero(places < width)
        place = places[row, column]
        row = live[row]
        fresh[row, place] = False
        near = edges[ids[row, place]]
        key = ((row * n)[:, None] + near)[near >= 0]
        key = np.sort(key[~seen[key]])
        key = key[_starts(key)]
        seen[key] = True
        row, near = np.divmod(key, n)
        values = np.einsum("ij,ij->i", queries[row], x[near])
        better = values > score[row, -1]
        row, near, values = row[better], near[better], values[better]
        first = np.flatnonzero(_starts(row))
        some, count = row[first], np.diff(first, append=len(row))
        if len(some):
            most = int(count.max())
            at = np.arange(len(row)) - np.repeat(first, count), np.repeat(np.arange(len(some)), count)
            more, more_score = np.full((len(some), most), -1), np.full((len(some), most), -np.inf, np.float32)
            more[at[1], at[0]], more_score[at[1], at[0]] = near, values
            all_score = np.hstack([score[some], more_score])
            order = np.argsort(-all_score, axis=1, kind="stable")[:, :width]
            score[some] = np.take_along_axis(all_score, order, 1)
            ids[some] = np.take_along_axis(np.hstack([ids[some], more]), order, 1)
            fresh[some] = np.take_along_axis(np.hstack([fresh[some], more >= 0]), order, 1)
        live = live[fresh[live].any(1)]
    return ids


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def prune(x: np.ndarray, points: np.ndarray, others: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point at most `degree` of the others (rows of numbers, -1 for none) in diverse directions, [points, degree]."""
    out = np.full((len(points), degree), -1)
    for start in range(0, len(points), 512):
        p, c = points[start : start + 512], others[start : start + 512]
        far = 1 - np.einsum("bcd,bd->bc", x[c], x[p])  # half of the squared distance, since all lengths are 1
        far[(c < 0) | (c == p[:, None])] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        c, far = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1)
        again = np.zeros(c.shape, bool)
        again[:, 1:] = c[:, 1:] == c[:, :-1]
        alive = np.isfinite(far) & ~again
        v = x[c]
        apart = 1 - v @ v.transpose(0, 2, 1)
        rows = np.arange(len(p))
        for k in range(degree):
            pick = alive.argmax(1)
            has = alive[rows, pick]
            if not has.any():
                break
            out[start + rows[has], k] = c[rows[has], pick[has]]
            alive &= relax * apart[rows, pick] > far
            alive[rows, pick] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Edges ([points, degree + SPARE], -1 for none) and entry of the graph of points of length 1."""
    n = len(x)
    entry = int(np.argmax(x @ x.mean(0, dtype=np.float64).astype(np.float32)))
    edges = np.full((n, degree + SPARE), -1)
    order = np.random.default_rng(1).permutation(n)
    order = order[order != entry]
    done = 0
    while done < len(order):
        batch = order[done : done + min(done + 1, 1024)]
        edges[batch, :degree] = prune(x, batch, beam_search(x, edges, entry, x[batch], width), degree, relax)
        _reverse(x, edges, batch, degree, relax)
        done += len(batch)
    _reach(x, edges, entry)
    return edges, entry


def _reverse(x: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, relax: float) -> None:
    to = edges[batch, :degree]
    source, target = np.repeat(batch, degree)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    near = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-near, target))
    source, target = source[order], target[order]
    some, first, count = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, count)
    keep = rank < 3 * degree  # of very many the nearest; the others have their own edges, and _reach() looks after them
    some_at = np.repeat(np.arange(len(some)), count)[keep]
    new = np.full((len(some), min(3 * degree, int(count.max(initial=0)))), -1)
    new[some_at, rank[keep]] = source[keep]
    both = np.hstack([edges[some, :degree], new])
    held = (both >= 0).sum(1)
    full = held > degree
    tight = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
    edges[some[~full], : tight.shape[1]] = tight[~full]
    edges[some[full], :degree] = prune(x, some[full], both[full], degree, relax)


def _reach(x: np.ndarray, edges: np.ndarray, entry: int) -> None:
    """Every point gets a path from the entry."""
    reached = np.zeros(len(x), bool)
    front = np.array([entry])
    while True:
        while len(front):
            reached[front] = True
            near = edges[front].ravel()
            front = np.unique(near[near >= 0])
            front = front[~reached[front]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        free = np.flatnonzero(reached & (edges[:, -1] < 0))
        if not len(free):
            raise RuntimeError("no free slot")  # each reached point brings SPARE slots and takes one
        some = lost[:256]
        nearest = free[np.argmax(x[some] @ x[free].T, axis=1)]
        for i in np.unique(nearest, return_index=True)[1].tolist():
            edges[nearest[i], np.flatnonzero(edges[nearest[i]] < 0)[-1]] = some[i]
            row = edges[nearest[i]]
            edges[nearest[i]] = np.concatenate([row[row >= 0], row[row < 0]])
            front = np.append(front, some[i])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length 1."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled together, so that products of single-precision numbers don't overflow."""
    return (vectors / np.abs(vectors).max()).astype(np.float32)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, component after component."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, size) + 0.0  # -0.0 is 0.0


def _runs(batch: pa.RecordBatch, columns: int):
    """(key, slice) for each run of equal values in the first columns."""
    keys = np.stack([np.asarray(batch.column(i)) for i in range(columns)])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), dim, level (of its length). Vectors that are null, empty or zero or hold a null or non-finite component, and rows without an id, take no part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~bad & F.exists("vector", lambda c: c != 0)).withColumn("dim", F.size("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)
    return rows.withColumn("level", F.greatest(F.lit(-600.0), F.least(F.lit(600.0), F.floor((F.log2(square) / 2 + 1) / 2))).cast("int"))


def index(rows: DataFrame, rows_per_shard: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The graphs, a row for each different vector of a shard: dim, level, shard, node, ids (sorted, each once), vector, near (node numbers), entry; and how many
    shards there are: dim, level, shards.

    rows: vec_id, embedding (see usable()). Vectors of different sizes are in different graphs. Other columns are not read."""
    rows = usable(rows)
    levels = written(rows.groupBy("dim", "level").count(), "ann-levels")
    n = levels.agg(F.sum("count")).first()[0] or 0
    plan = levels.select("dim", "level", F.ceil(F.col("count") / (rows_per_shard or shard_rows(n))).cast("int").alias("shards"))

    def graph(dim: int, ids: list[np.ndarray], vectors: list[np.ndarray]):
        v, at = np.unique(np.concatenate(vectors), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([at.ravel(), np.concatenate(ids)], axis=1), axis=0)
        edges, entry = build(unit(v))
        offsets = np.searchsorted(pairs[:, 0], np.arange(len(v) + 1))
        edge_at = np.concatenate([[0], np.cumsum((edges >= 0).sum(1))])
        for a in range(0, len(v), 4096):
            b = min(len(v), a + 4096)
            lists = [pa.ListArray.from_arrays(pa.array(o[a : b + 1] - o[a], pa.int32()), pa.array(x[o[a] : o[b]])) for o, x in ((offsets, pairs[:, 1]), (np.arange(len(v) + 1) * dim, v.ravel()), (edge_at, edges[edges >= 0].astype(np.int32)))]
            yield np.arange(a, b), lists, np.arange(a, b) == entry

    def work(batches):
        now, ids, vectors = None, [], []

        def made():
            for node, (of, vector, near), entry in graph(now[0], ids, vectors):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(node), x), pa.int32()) for x in now), pa.array(node, pa.int32()), of, vector, near, pa.array(entry)], ["dim", "level", "shard", "node", "ids", "vector", "near", "entry"])

        for batch in batches:
            for key, part in _runs(batch, 3):
                if key != now and ids:
                    yield from made()
                    ids, vectors = [], []
                now = key
                ids.append(np.asarray(part.column(3)))
                vectors.append(_matrix(part.column(4), key[0]))
        if ids:
            yield from made()

    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")).cast("int").alias("shard")
    dealt = rows.join(plan, ["dim", "level"]).select("dim", "level", shard, "vec_id", "vector")
    sorted_ = dealt.repartitionByRange(_total(plan), "dim", "level", "shard").sortWithinPartitions("dim", "level", "shard", "vec_id")
    return sorted_.mapInArrow(work, "dim int, level int, shard int, node int, ids array<long>, vector array<double>, near array<int>, entry boolean"), plan


def _total(plan: DataFrame) -> int:
    return min(100_000, plan.agg(F.sum("shards")).first()[0] or 1)


def search(graphs: DataFrame, plan: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
    """The k nearest found for each query: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    graphs, plan: of index(), the graphs written. queries: vec_id, embedding (see usable()). A query's own row (its id with the same vector) is no result. Repeated rows count
    once, in queries and results; different vectors of one id are queries and results of their own. A query meets only vectors of its size."""
    asked = written(usable(queries).dropDuplicates(["vec_id", "vector"]).withColumn("query", F.monotonically_increasing_id()), "ann-queries")
    parts = max(1, math.ceil(asked.count() / TASK_QUERIES))
    none = F.lit(None)
    left = graphs.select("dim", "level", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.col("node").cast("long").alias("number"), "ids", "vector", "near", "entry")
    right = asked.drop("level").join(plan, "dim").select("dim", "level", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod("query", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("query").alias("number"), F.array("vec_id").alias("ids"), "vector", none.cast("array<int>").alias("near"), none.cast("boolean").alias("entry"))

    def found(part: pa.RecordBatch, dim: int, x, v, edges, entry, ids, offsets):
        q, own, number = _matrix(part.column(7), dim), np.asarray(part.column(6).flatten()), np.asarray(part.column(5))
        for a in range(0, len(q), 2048):
            some = q[a : a + 2048]
            near = beam_search(x, edges, entry, unit(some), beam)
            row, place = np.nonzero(near >= 0)
            node = near[row, place]
            score = exact(some[row], v[node])
            count = np.minimum(offsets[node + 1] - offsets[node], k + 1)  # of equal vectors the k smallest ids come first, and the query's own may be among them
            at = np.repeat(np.arange(len(node)), count)
            vec = ids[offsets[node[at]] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)]
            row, score = row[at], score[at]
            same = np.flatnonzero(vec == own[a + row])
            mine = same[(v[node[at[same]]] == some[row[same]]).all(1)]
            row, vec, score = (np.delete(z, mine) for z in (row, vec, score))
            order = np.lexsort((vec, -score, row))
            row, vec, score = row[order], vec[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, vec, score = row[keep], vec[keep], score[keep]
            yield pa.RecordBatch.from_arrays([pa.array(number[a + row]), pa.array(own[a + row]), pa.array(vec), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    def work(batches):
        now, held, graph = None, [], None
        for batch in batches:
            for key, part in _runs(batch, 5):
                if key[:4] != now:
                    now, held, graph = key[:4], [], None
                if key[4] == 0:
                    held.append(part)
                elif held or graph:
                    if graph is None:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        v = _matrix(whole.column(7), key[0])
                        sizes = np.asarray(whole.column(8).value_lengths())
                        edges = np.full((len(v), int(sizes.max())), -1)
                        edges[np.arange(edges.shape[1]) < sizes[:, None]] = np.asarray(whole.column(8).flatten())
                        offsets = np.concatenate([[0], np.cumsum(np.asarray(whole.column(6).value_lengths()))])
                        graph = scaled(v), v, edges, int(np.flatnonzero(np.asarray(whole.column(9)))[0]), np.asarray(whole.column(6).flatten()), offsets
                        held = []
                    yield from found(part, key[0], *graph)

    deal = ["dim", "level", "shard", "part"]
    both = left.unionByName(right).repartitionByRange(_total(plan) * parts, *deal).sortWithinPartitions(*deal, "kind", "number")
    each = both.mapInArrow(work, "query long, query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(rows: DataFrame) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    graphs, plan = index(rows)
    return search(written(graphs, "ann-graphs"), plan, rows.where(F.col("vec_id") % EVERY == 0))


