"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles. Two documents link when their sets' Jaccard similarity is at least
`percent` / 100; the join is exact. Documents with equal sets are one node.

Shingles have one order for the whole corpus, rare ones first (by counts of all shingles in all documents, hashed into
a table of 2^`order_bits` counters; any order gives the same links, this one makes few candidates). A set of n shingles
that links with another shares at least o = ceil(n * percent / 100) of its shingles with it, so the first n - o + l
shingles of both have at least l in common. Each document picks its own l, from `LEAST_L` to `most_l` (less for the smallest
sets): it lengthens its prefix while the estimated cost of looking up its shingles and verifying the candidates falls. A pair
must share the smaller of the two l's before it is verified. The estimate doesn't see single rare shingles that two
documents share by chance, of which there are more with the square of the corpus; `LEAST_L` keeps these out.

Shingles that up to `group` documents have in their prefixes give pairs of documents. Larger groups (thousands of near
copies) aren't written out as pairs. Their members are first compared with a few pivots: those with the least hashes, so
that the groups of one family, which share most members, have the same pivots. Links only matter between different
components, so what is left is to compare the members of a group that the links so far leave apart. They meet in blocks of
at most `block` members and `BLOCK_SHINGLES` shingles, sorted by size, where two blocks have sizes that can link; a pair meets in
the first group that it shares, and a text goes only where it has a partner.

All comparisons are of whole sets, pairs in portions of at most about `PORTION` pairs and `PORTION_SHINGLES` shingles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHash, by_bytes, forget, grams, shared, small_batches, spread_join, utf8, written
from loomgraph.llm.components import components

WORDS, PERCENT, ORDER_BITS, MOST_L, GROUP, BLOCK, VERIFY, FAN_IN, ID_BITS = 5, 80, 22, 6, 32, 1024, 20.0, 32, 23
#: Rows of a meeting whose numbers are compared at a time.
SLICE = 256
LEAST_L, PIVOTS, PORTION, PORTION_SHINGLES, BLOCK_SHINGLES, FIRSTS = 3, 4, 2048, 4_000_000, 500_000, 16


def shingle_sets(texts: Iterable[bytes], k: int, cache: WordHash) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words between white space; fewer than k words are one shingle."""
    for text in texts:
        words = cache.array(text.lower().split())
        n = len(words)
        if n >= k:
            yield np.unique(grams(words, k))
        else:
            yield grams(words, n) if n else np.empty(0, np.uint64)


def key_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _half(key: bytes | None) -> int | None:
    return None if key is None else int.from_bytes(key[:8], "big", signed=True)


def _packed(counts: np.ndarray) -> bytes:
    """Counts byte plane by byte plane: the upper planes are nearly all zero and take no room. One plane is held at a time."""
    to, out = zlib.compressobj(1), []
    for i in range(8):
        out.append(to.compress((counts >> min(8 * i, 8 * counts.itemsize - 1)).astype(np.uint8).tobytes()))
    return b"".join([*out, to.flush()])


def _add(total: np.ndarray, data: bytes) -> None:
    """Adds packed counts to total, a plane at a time."""
    more = zlib.decompressobj()
    for i in range(8):
        plane = bytearray()
        while len(plane) < len(total):
            plane += more.decompress(data, len(total) - len(plane))
            data = more.unconsumed_tail
        some = np.frombuffer(plane, np.uint8)
        if some.any():
            total += some.astype(np.int64) << 8 * i


def shingle_counts(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """How often the shingles of each hash range occur (once per document), over all documents. Summed in a tree, FAN_IN tables at a time."""

    def count(batches):
        cache, total, some = WordHash(), np.zeros(1 << bits, np.int32), False
        for batch in batches:
            for _, texts in by_bytes(utf8(batch.column(1))):
                every = np.concatenate(list(shingle_sets(texts, k, cache)))
                places, times = np.unique((every >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                total[places] += times.astype(np.int32)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN], pa.int64()), pa.array([_packed(total)], pa.binary())], ["part", "counts"])

    def add(pdf):
        import pandas as pd

        total = np.zeros(1 << bits, np.int64)
        for c in pdf["counts"]:
            _add(total, c)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], "counts": [_packed(total)]})

    tables, n = docs.mapInArrow(count, "part long, counts binary"), docs.rdd.getNumPartitions()
    while True:
        tables, n = tables.groupBy("part").applyInPandas(add, "part long, counts binary"), -(-n // FAN_IN)
        if n <= 1:
            break
    rows = tables.collect()  # one table of fixed size
    total = np.zeros(1 << bits, np.int64)
    for r in rows:
        _add(total, r.counts)
    return total


class Order:
    """The corpus order of shingles, and the prefixes it gives."""

    def __init__(self, counts: np.ndarray, percent: int, most_l: int):
        self.bits, self.percent, self.most_l = int(len(counts)).bit_length() - 1, percent, most_l
        self.rank = np.minimum(255, np.round(8 * np.log2(counts + 1.0))).astype(np.uint8)
        self.load = float(2 * counts.mean() + 4)  # what a counter has from rare shingles alone

    def prefix(self, shingles: np.ndarray) -> tuple[int, np.ndarray]:
        n = len(shingles)
        base = n - -(-n * self.percent // 100)
        most = min(n, base + self.most_l)
        rank = self.rank[(shingles >> np.uint64(64 - self.bits)).astype(np.int64)]
        near = np.argpartition(rank, most - 1)[:most] if most < n else np.arange(n)
        if most < n:  # all of the last one's rank, so that hashes decide
            near = np.flatnonzero(rank <= rank[near].max())
        first = near[np.lexsort((shingles[near], rank[near]))][:most]
        partners = np.cumsum(np.maximum(0.0, 2.0 ** (rank[first] / 8.0) - 1 - self.load))
        best, cost = 1, None
        for ell in range(min(LEAST_L, max(1, most - base)), max(1, most - base) + 1):
            found = partners[min(most, base + ell) - 1]
            now = found + VERIFY * found / ell
            if cost is None or now < cost:
                best, cost = ell, now
        return best, shingles[first[: base + best]]


def nodes(docs: DataFrame, order: Order, k: int) -> DataFrame:
    """doc_id, n, key (null for an empty set), id (the key's first half), ell, prefix of every document."""
    sent = shared(docs.sparkSession, (order.rank, order.load, order.percent, order.most_l))

    def run(batches):
        order = Order.__new__(Order)
        order.rank, order.load, order.percent, order.most_l = sent()
        order.bits, cache = int(len(order.rank)).bit_length() - 1, WordHash()
        for batch in batches:
            n, keys, ells, prefixes = [], [], [], []
            for _, texts in by_bytes(utf8(batch.column(1))):
                for s in shingle_sets(texts, k, cache):
                    ell, prefix = order.prefix(s) if len(s) else (1, s)
                    n.append(len(s))
                    keys.append(key_of(s))
                    ells.append(ell)
                    prefixes.append(prefix.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([_half(x) for x in keys], pa.int64()), pa.array(ells, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "key", "id", "ell", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, id long, ell int, prefix array<long>")


def candidates(reps: DataFrame, percent: int, group: int, block: int) -> DataFrame:
    """Rows of two kinds: pairs (a, b, ell, n: both sizes) from shingles with few documents, and members (shingle, a, n, part) of larger groups.

    Documents go by half of their key here: what coincides by chance is a candidate too, and compared in full later on. A
    shingle's documents come in one after the other, sorted by size; at most `group` of them are held."""
    rows = reps.select(F.explode("prefix").alias("shingle"), (F.col("n") * 16 + F.col("ell")).alias("size"), "id")
    rows = rows.repartition("shingle").sortWithinPartitions("shingle", "size", "id")
    types = {"shingle": pa.int64(), "a": pa.int64(), "b": pa.int64(), "ell": pa.int32(), "n": pa.int64(), "part": pa.int32()}

    def run(batches):
        at, held, seen, part, filled, shingles = None, [], 0, 0, 0, 0
        out: list[tuple] = []

        def member(a, n):
            nonlocal part, filled, shingles
            if filled == block or filled and shingles + n > BLOCK_SHINGLES:
                part, filled, shingles = part + 1, 0, 0
            filled, shingles = filled + 1, shingles + n
            out.append((at, a, None, None, n, part))

        def close():
            nonlocal held
            for i, (x, a) in enumerate(held):
                for y, b in held[i + 1 :]:
                    if (x >> 4) * 100 >= (y >> 4) * percent:
                        out.append((None, min(a, b), max(a, b), min(x & 15, y & 15), (x >> 4) + (y >> 4), None))
            held = []

        def flush():
            nonlocal out
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))
            out = []
            return batch

        for batch in batches:
            s, sizes, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            again = np.flatnonzero(s[1:] == s[:-1])
            busy = np.unique(np.concatenate([again, again + 1, [0, len(s) - 1]])).astype(np.int64) if len(s) else np.empty(0, np.int64)  # rows whose shingle may recur
            for shingle, size, a in zip(s[busy].tolist(), sizes[busy].tolist(), ids[busy].tolist(), strict=True):
                if shingle != at:
                    if seen <= group:
                        close()
                    at, held, seen, part, filled, shingles = shingle, [], 0, 0, 0, 0
                seen += 1
                if seen <= group:
                    held.append((size, a))
                    continue
                if seen == group + 1:
                    for z, x in held:
                        member(x, z >> 4)
                    held = []
                member(a, size >> 4)
            if len(out) > 50_000:
                yield flush()
        if seen <= group:
            close()
        if out:
            yield flush()

    return rows.mapInArrow(run, "shingle long, a long, b long, ell int, n long, part int")


def pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each member of a large group with the group's pivots: a, b, n (both sizes)."""
    pick = [F.min(F.struct(F.xxhash64(F.lit(i), "a").alias("h"), F.col("a").alias("p"), F.col("n").alias("m"))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = members.groupBy("shingle").agg(*pick).select("shingle", F.array_distinct(F.array(*(F.struct(f"p{i}.p", f"p{i}.m") for i in range(PIVOTS)))).alias("pivots"))
    rows = spread_join(members.select("shingle", "a", "n"), pivots, "shingle").select("a", "n", F.inline("pivots").alias("p", "m"))
    rows = rows.where((F.col("a") != F.col("p")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    return rows.select(F.least("a", "p").alias("a"), F.greatest("a", "p").alias("b"), (F.col("n") + F.col("m")).alias("n")).distinct()


def _to_compare(pdf, percent: int) -> np.ndarray:
    """Which rows of a meeting have to be compared with which: of the two blocks, of labels that differ, of sizes that can link, and without an earlier group in common."""
    import pandas as pd

    n, part, own = pdf["n"].to_numpy(), pdf["part"].to_numpy(), np.arange(len(pdf))
    code = np.where(pd.isna(pdf["label"]), -1 - own, pd.factorize(pdf["label"])[0])
    out = code[:, None] != code[None, :]
    out &= n[None, :] >= -(-n * percent // 100)[:, None]  # each row's least and most size of a partner: no table of numbers is made
    out &= n[None, :] <= (100 * n // percent)[:, None]
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    out &= (part == i)[:, None] & (part == j)[None, :] | (part == j)[:, None] & (part == i)[None, :]
    np.fill_diagonal(out, False)
    earlier = [(at, x) for at, xs in enumerate(pdf["firsts"]) for x in xs if x < pdf["shingle"].iloc[0]]
    if earlier and out.any():
        doc = np.array([x[0] for x in earlier])
        column = np.unique([x[1] for x in earlier], return_inverse=True)[1]
        for lo in range(0, int(column.max()) + 1, 4096):
            here = (column >= lo) & (column < lo + 4096)
            x = np.zeros((len(pdf), 4096), np.float32)
            x[doc[here], column[here] - lo] = 1
            out &= x @ x.T == 0
    return out


def overlaps(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at `left` with all others: columns that many sets have by matrix products, others pair by pair."""
    n, every = len(sets), np.concatenate(sets)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, doc = every[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    often = np.diff(np.concatenate([starts, [len(every)]]))
    times = np.repeat(often, often)
    few = doc[(times > 1) & (times <= 8)], every[(times > 1) & (times <= 8)]
    at = np.full(n, -1)
    at[left] = np.arange(len(left))
    both = np.zeros(len(left) * n, np.float32)
    for step in range(1, 8):
        same = np.flatnonzero(few[1][step:] == few[1][:-step])
        for x, y in ((few[0][same], few[0][same + step]), (few[0][same + step], few[0][same])):
            both += np.bincount(at[x[at[x] >= 0]] * n + y[at[x] >= 0], minlength=len(both))
    both = both.reshape(len(left), n)
    many = times > 8
    column, doc = np.repeat(np.cumsum(often > 8) - 1, often)[many], doc[many]
    for lo in range(0, int((often > 8).sum()), 2048):
        here = (column >= lo) & (column < lo + 2048)
        x = np.zeros((n, 2048), np.float32)
        x[doc[here], column[here] - lo] = 1
        both += x[left] @ x.T
    return both


def apart_links(members: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """A spanning forest (a, b: keys) of the links in large groups between documents that labels (id, label; a null label is apart from all) leave apart.

    Blocks (shingle, part) meet two by two unless one label fills both or their sizes are too far apart; a meeting has two blocks of members at most."""
    firsts = members.groupBy("a").agg(F.slice(F.sort_array(F.collect_set("shingle")), 1, FIRSTS).alias("firsts"))
    known = written(members.join(firsts.join(labels.withColumnRenamed("id", "a"), "a"), "a").select("shingle", "part", "a", "n", "label", "firsts"), "jaccard-members")
    blocks = known.groupBy("shingle", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("lo"), F.max("label").alias("hi"), (F.count("label") < F.count("*")).alias("open"))
    ends = [F.col(x).alias(f"{x}2") for x in ("part", "least", "most", "lo", "hi", "open")]
    both = blocks.join(blocks.select("shingle", *ends), "shingle").where("part <= part2")
    same = ~F.col("open") & ~F.col("open2") & (F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))
    both = both.where((100 * F.least("most", "most2") >= percent * F.greatest("least", "least2")) & ~same)
    meets = both.select("shingle", F.col("part").alias("i"), F.col("part2").alias("j"), F.explode(F.array_distinct(F.array("part", "part2"))).alias("part"))
    rows = meets.join(known, ["shingle", "part"]).select("shingle", "i", "j", "part", "a", "n", "label", "firsts")

    def needed(pdf):
        return pdf[_to_compare(pdf, percent).any(1)]

    def links(pdf):
        import pandas as pd

        keys, sets = pdf["key"].tolist(), list(shingle_sets(map(zlib.decompress, pdf["text"]), k, WordHash()))
        compare, size = _to_compare(pdf, percent), np.array([len(x) for x in sets])
        code = pd.factorize(pdf["label"])[0]
        main = np.bincount(code[code >= 0]).argmax() if (code >= 0).any() else -2
        left = np.flatnonzero(compare.any(1) & (code != main))  # two labels differ, so one of any two is among these
        both = overlaps(sets, left)
        link = np.zeros(compare.shape, bool)
        for lo in range(0, len(left), SLICE):
            some, common = left[lo : lo + SLICE], both[lo : lo + SLICE].astype(np.int64)
            link[some] = compare[some] & (100 * common >= percent * (size[some][:, None] + size[None, :] - common))
        link |= link.T
        label = np.arange(len(sets))
        while True:
            lower = np.concatenate([np.where(link[lo : lo + SLICE], label[None, :], len(sets)).min(1) for lo in range(0, len(sets), SLICE)])
            lower = np.minimum(lower, label)
            if (lower == label).all():
                break
            label = lower
        found = np.flatnonzero(label != np.arange(len(sets)))
        return pd.DataFrame({"a": [keys[i] for i in found], "b": [keys[label[i]] for i in found]})

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be put together into one task
    some = rows.repartition(tasks, "shingle", "i", "j").groupBy("shingle", "i", "j").applyInPandas(needed, rows.schema)
    some = some.withColumnRenamed("a", "id").hint("merge").join(texts, "id")
    return some.groupBy("shingle", "i", "j").applyInPandas(links, "a binary, b binary")


def _id_bits(wanted: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits places with the hashes of the wanted document ids: of fixed size, however many there are."""
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << bits))
    rows = wanted.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), (place % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("on"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in rows.toLocalIterator():
        out[r.word] = r.on
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def texts_of(docs: DataFrame, wanted: DataFrame, k: int, bits: int) -> DataFrame:
    """key, id, text (UTF-8, compressed), large of the documents whose ids are on the bitmap of the wanted ones (rep, large: in a large group). The few
    others on it are in no candidate pair or group, so later joins pass them over; nothing is shuffled here. Texts travel, not sets: they are several times smaller."""
    sent = shared(docs.sparkSession, [np.packbits(_id_bits(x, bits)) for x in (wanted, wanted.where("large"))])
    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("place"))

    def run(batches):
        (on, large), cache = (np.unpackbits(x).astype(bool) for x in sent()), WordHash()
        for batch in batches:
            batch = batch.filter(pa.array(on[batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)], pa.bool_()))
            many = large[batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)]
            keys = [key_of(s) for _, texts in by_bytes(utf8(batch.column(1))) for s in shingle_sets(texts, k, cache)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([_half(x) for x in keys], pa.int64()), pa.array([zlib.compress(t, 1) for t in utf8(batch.column(1))], pa.binary()), pa.array(many, pa.bool_())], ["key", "id", "text", "large"])

    return placed.mapInArrow(run, "key binary, id long, text binary, large boolean").where("id IS NOT NULL")


def linked_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b: ids; n: both sizes) whose sets are similar enough, as keys.

    A pair is compared where the least partner of `a` is: the members of a family of copies meet in one place, so a text
    travels about once or twice, not once for each of its pairs. A place with more than a portion is split into several."""
    every = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hub = every.groupBy("a").agg(F.min("b").alias("hub")).select("a", F.least("a", "hub").alias("hub"))
    at = written(spread_join(pairs, hub, "a").select("hub", "a", "b", "n"), "jaccard-routes")
    portions = F.ceil(F.greatest(F.count("*") / PORTION, F.sum("n") / PORTION_SHINGLES)).alias("portions")
    large = at.groupBy("hub").agg(portions).where("portions > 1")
    at = at.join(large, "hub", "left").select("hub", F.pmod(F.xxhash64("a", "b"), F.coalesce("portions", F.lit(1))).alias("portion"), "a", "b")
    place = [F.col("hub").alias("to_hub"), F.col("portion").alias("to_portion")]
    goes = at.select(*place, F.col("a").alias("id")).unionByName(at.select(*place, F.col("b").alias("id"))).distinct()
    there = goes.hint("merge").join(texts, "id").select("to_hub", "to_portion", "id", "key", "text")  # by id at every size: routes grow with the corpus

    def compare(wanted, found):
        import pandas as pd

        held: dict[int, list] = {}
        for i, key, s in zip(found["id"], found["key"], shingle_sets(map(zlib.decompress, found["text"]), k, WordHash()), strict=True):
            held.setdefault(i, []).append((key, s))
        out = []
        for a, b in zip(wanted["a"], wanted["b"], strict=True):
            for key_a, x in held.get(a, ()):
                for key_b, y in held.get(b, ()):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((key_a, key_b))
        return pd.DataFrame(out, columns=["a", "b"])

    return at.groupBy("hub", "portion").cogroup(there.groupBy("to_hub", "to_portion")).applyInPandas(compare, "a binary, b binary")


def classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, order_bits: int = ORDER_BITS, most_l: int = MOST_L, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id: the least doc_id that links lead to, its own included.

    A text without words, or null, has an empty set and links with nothing, not even with its like. Repeated rows each give
    a row and are linked. Null ids are documents; they don't count for the least id (a component of null ids has a null id).
    Other columns are not read."""
    every, ids, roots = _linked(docs, k, percent, order_bits, most_l, group, block)
    rooted = ids.join(roots, ids["key"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = roots.select("root").distinct().join(rooted, "root").groupBy("root").agg(F.min("rep").alias("least"))
    named = rooted.join(least, "root", "left").select("key", F.coalesce("least", "rep").alias("component_id"))
    return every.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _linked(docs: DataFrame, k: int, percent: int, order_bits: int, most_l: int, group: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (doc_id, n, key), the different sets (key, id, rep: least doc_id) and their components (node, root: keys)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = Order(shingle_counts(docs, k, order_bits), percent, most_l)
    sets = written(nodes(docs, order, k), "jaccard-nodes")
    every = sets.select("doc_id", "n", "key")
    some = sets.where("key IS NOT NULL")
    # a set of n can at best share all n with one of n + 1: smaller sets link with equal ones alone, and those are one node
    able = some.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    reps = able.groupBy("key").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("ell").alias("ell"), F.first("prefix").alias("prefix"))
    found = written(candidates(reps, percent, group, block), "jaccard-candidates")
    few = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("ell").alias("ell"), F.max("n").alias("n")).where("shared >= ell").select("a", "b", "n")
    members = found.where("b IS NULL").select("shingle", "part", "a", "n")
    pairs = written(few.unionByName(pivot_pairs(members, percent)), "jaccard-pairs")
    ids = written(some.groupBy("key", "id").agg(F.min("doc_id").alias("rep")), "jaccard-ids")
    of = lambda df, column, large: df.select(F.col(column).alias("id"), F.lit(large).alias("large"))
    wanted = of(pairs, "a", False).unionByName(of(pairs, "b", False)).unionByName(of(members, "a", True)).groupBy("id").agg(F.max("large").alias("large"))
    wanted = written(ids.join(wanted, "id").select("key", "id", "rep", "large"), "jaccard-wanted")
    texts = written(texts_of(docs, wanted, k, ID_BITS), "jaccard-texts")
    roots = components(linked_pairs(pairs, texts, k, percent))
    members = written(members, "jaccard-members")
    forget(found, pairs)
    if not members.isEmpty():
        label = F.when(F.count("*") == 1, F.max(F.coalesce("root", "key"))).alias("label")  # ids that two sets have are apart from all
        labels = wanted.where("large").join(roots, F.col("key") == F.col("node"), "left").groupBy("id").agg(label)
        more = written(apart_links(members, labels, texts.where("large").select("key", "id", "text"), k, percent), "jaccard-links")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    forget(texts, members)
    return every, ids, roots


def report(docs: DataFrame) -> DataFrame:
    return classes(docs, 3, 90)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(r, t) AS (SELECT r, r FROM d UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.t)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN c USING (r) JOIN d o ON o.r = c.t LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
