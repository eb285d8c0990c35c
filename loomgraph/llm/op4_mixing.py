"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, document after document in a pseudorandom order, are packed into blocks of `block_words` words.
The targets (shares by weight, none above `most` times its source, the excess shared anew) become whole passes over a
source's blocks and a number of single blocks: its quota of slots. The output is a row of shards of `shard_slots`
slots. Each shard draws multinomial counts of the sources in proportion to the quotas; what all shards together drew
beyond a source's quota goes to the sources that fell short, so every quota is met exactly and no block is used more
than `most` times. A source's n-th slot takes the block that the pass's pseudorandom permutation (swap-or-not) puts at
its n-th place, and slots and blocks are joined by index: the result is a table of shard and slot rows with their tokens.

The table of sources (one row each) is held by the driver: a recipe has as many rows as it has sources, `MAX_SOURCES`
at most. Everything about documents, blocks, shards and slots is distributed, and no task gets a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import written

BLOCK_WORDS, SHARD_SLOTS, MOST, WEIGHTS, ROUNDS, SEED = 128, 1024, 3, (1, 2, 3), 12, 20_24
MAX_SOURCES, BUCKET_DOCS, TASK_SLOTS, SPAN, NONE = 100_000, 5_000, 20_000, 4_096, -1
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of the sum of the sizes by weight, none above `most` times its size."""
    total, capped = sum(sizes), 0
    rest, out = sum(weights), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i)):
        left = (total - capped) / rest if rest else 0.0
        if most * sizes[i] < weights[i] * left:
            out[i] = float(most * sizes[i])
            capped += most * sizes[i]
            rest -= weights[i]
        else:
            out[i] = weights[i] * left
    return out


@dataclass
class Source:
    name: str | None
    size: int
    docs: int
    target: float
    blocks: int  # the last one may be short
    passes: int  # whole ones
    singles: int  # whole blocks of a further pass

    @property
    def quota(self) -> int:
        return self.passes * self.blocks + self.singles


def recipe(sized: DataFrame, weights: tuple[int, ...], block_words: int, most: int) -> list[Source]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    out = []
    for r, target in zip(rows, targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most), strict=True):
        blocks = -(-r["size"] // block_words)
        passes = min(most, int(target // r["size"])) if r["size"] else 0
        rest = target - passes * r["size"]
        singles = 0 if passes == most else min(r["size"] // block_words, round(rest / block_words))
        out.append(Source(r.source, r["size"], r.docs, target, blocks, passes, singles))
    return out


def _values(xs: list) -> Column:
    return F.array(*(F.lit(x) for x in xs)).cast("array<bigint>") if len(xs) < 500 else F.from_json(F.lit(str(list(xs))), "array<bigint>")


def _place(x: Column, bounds: list[int]) -> Column:
    """How many of the rising bounds are not above x: the index of the interval that x is in. Of many bounds, by halving."""
    if len(bounds) <= 32:
        return sum(((F.lit(b) <= x).cast("int") for b in bounds), F.lit(0))
    values, steps = _values(bounds), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    on = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(values, at + step - 1) <= x), at + step).otherwise(at)
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), on)


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """`index` (0 <= index < n) put through a pseudorandom permutation of range(n) that depends on `key`: swap-or-not rounds.

    In each round an index and its mirror image about a keyed centre change places, or don't, by a keyed hash of the pair."""

    def one(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, key), n) - x, n)
        return F.when(F.xxhash64(-r - 1, key, F.greatest(x, mirror)) % 2 == 0, mirror).otherwise(x)

    return F.aggregate(F.array(*(F.lit(r).cast("long") for r in range(rounds))), index.cast("long"), one)


def placed(sized: DataFrame, sizes: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """(doc_id, source, size, digest) -> also source_index and start: where a document's words begin among its source's; text goes along if it is there.

    Positions are sums over hash buckets of documents and then within a bucket; buckets have about BUCKET_DOCS documents, so
    a source of any size is spread over many tasks. The hash is of id and text, so documents without an id, or of one id, are spread as well. `sizes` has the same rows without their texts: the buckets' sums come from it."""
    spark = sized.sparkSession
    table = spark.createDataFrame([(i, s.name, max(1, s.docs // BUCKET_DOCS)) for i, s in enumerate(sources)], "source_index int, name string, buckets long")

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["name"])).withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("digest"))).withColumn("bucket", F.pmod("h", "buckets"))

    sums = keyed(sizes).groupBy("source_index", "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source_index").orderBy("bucket")) - F.col("words")).drop("words")
    within = Window.partitionBy("source_index", "bucket").orderBy("h", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    local = keyed(sized).withColumn("upto", F.sum("size").over(within))
    return local.join(before, ["source_index", "bucket"]).select("doc_id", "source_index", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"), *({"text"} & set(sized.columns)))


def pieces(docs: DataFrame, block_words: int) -> DataFrame:
    """The part that each document has in each block: source_index, block, start, doc_id, size, words, text (the part's words, by space). Documents without words have none."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    of = F.sequence(F.floor(start / block_words), F.floor((end - 1) / block_words))

    def part(words: Column, block: Column) -> Column:
        lo, hi = F.greatest(start, block * block_words), F.least(end, (block + 1) * block_words)
        own = F.slice(words, (lo - start + 1).cast("int"), (hi - lo).cast("int"))
        return F.struct(block.alias("block"), F.size(own).cast("long").alias("words"), F.array_join(own, " ").alias("text"))

    every = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))  # an array of one, so that a text is cut into words once
    cut = F.flatten(F.transform(every, lambda words: F.transform(of, lambda block: part(words, block))))
    some = docs.where("size > 0").select("source_index", "start", "doc_id", "size", F.explode(cut).alias("part"))
    return some.select("source_index", "part.block", "start", "doc_id", "size", "part.words", "part.text")


def packed(pieces: DataFrame) -> DataFrame:
    """source_index, block, parts: the pieces of each block in their order, no more than it has words."""
    return pieces.groupBy("source_index", "block").agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "size", "words", "text"))).alias("parts"))


def joined(slots: DataFrame, blocks: DataFrame) -> DataFrame:
    """Slots and blocks by index: shard, slot, source_index, pass, block, text (the block's words, by space), parts (start, doc_id, size, words of each document in it).

    Slots grow with the corpus, and packed they look small enough to be broadcast: they are hashed within each partition instead, where no block has more than a few."""
    text = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    parts = F.transform("parts", lambda p: p.dropFields("text"))
    return slots.hint("shuffle_hash").join(blocks, ["source_index", "block"]).select("shard", "slot", "source_index", "pass", "block", text.alias("text"), parts.alias("parts"))


def drawn(spark: SparkSession, sources: list[Source], shard_slots: int, seed: int) -> DataFrame:
    """Multinomial counts: shard, source_index, n. A slot's source is the quota interval that its hash falls into."""
    bounds, at = [], 0
    for s in sources:
        at += s.quota
        bounds.append(at)
    slots = spark.range(at).select((F.col("id") / shard_slots).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(1, at))).alias("u"))
    return slots.select("shard", _place(F.col("u"), bounds).alias("source_index")).groupBy("shard", "source_index").agg(F.count("*").alias("n"))


def counted(draws: DataFrame) -> DataFrame:
    """draws, with k0: how many slots of its source the shards before have. Sums over spans of SPAN shards, then within a span, so no task has all shards of a source."""
    rows = draws.withColumn("span", (F.col("shard") / SPAN).cast("long"))
    sums = rows.groupBy("source_index", "span").agg(F.sum("n").alias("whole"))
    before = sums.select("source_index", "span", (F.sum("whole").over(Window.partitionBy("source_index").orderBy("span")) - F.col("whole")).alias("before"))
    near = Window.partitionBy("source_index", "span").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.sum("n").over(near))
    return upto.join(before, ["source_index", "span"]).select("shard", "source_index", "n", (F.col("before") + F.col("upto") - F.col("n")).alias("k0"))


def slots(draws: DataFrame, sources: list[Source], block_words: int, seed: int) -> DataFrame:
    """shard, slot, source_index, block, pass of every slot, after the correction to the quotas.

    source_index and block are never null, and say so (NONE stands for no value): a join on columns that could be null would filter
    them first by the whole expression they are made of, its parts repeated wherever they are used, hundreds of kilobytes of plan."""
    got = {r.source_index: r.n for r in draws.groupBy("source_index").agg(F.sum("n").alias("n")).collect()}  # one row per source
    got = [got.get(i, 0) for i in range(len(sources))]
    over, short = [max(0, g - s.quota) for g, s in zip(got, sources, strict=True)], [max(0, s.quota - g) for g, s in zip(got, sources, strict=True)]
    over_from, short_from = list(accumulate([0, *over]))[:-1], list(accumulate([0, *short]))[:-1]
    at = lambda xs, i: F.element_at(_values(xs), i + 1)
    in_shard = Window.partitionBy("shard").orderBy("source_index").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted(draws).repartition(max(1, sum(got) // TASK_SLOTS), "shard")
    one = placed.select("shard", "source_index", "n", "k0", (F.sum("n").over(in_shard) - F.col("n")).alias("slot0"))
    one = one.select("shard", "source_index", "k0", "slot0", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("shard", (F.col("slot0") + F.col("i")).alias("slot"), "source_index", (F.col("k0") + F.col("i")).alias("k"))
    i, k = F.col("source_index"), F.col("k")
    one = one.withColumn("z", F.when(k >= at([s.quota for s in sources], i), at(over_from, i) + k - at([s.quota for s in sources], i)))
    one = one.withColumn("to", F.when(F.col("z").isNotNull(), _place(F.col("z"), [a + b for a, b in zip(short_from, short, strict=True)])))
    one = one.withColumn("k", F.when(F.col("z").isNotNull(), at(got, F.col("to")) + F.col("z") - at(short_from, F.col("to"))).otherwise(k)).withColumn("source_index", F.coalesce("to", i, F.lit(NONE)))
    whole = at([s.passes * s.blocks for s in sources], i)
    blocks, singles = at([s.blocks for s in sources], i), at([s.size // block_words for s in sources], i)
    one = one.withColumn("pass", F.when(k < whole, F.floor(k / blocks)).otherwise(at([s.passes for s in sources], i)))
    one = one.withColumn("block", F.when(k < whole, k % blocks).otherwise(k - whole)).withColumn("n", F.when(k < whole, blocks).otherwise(singles))
    one = one.withColumn("key", F.xxhash64(F.lit(seed), i, F.col("pass")))
    return one.select("shard", "slot", "source_index", "pass", F.coalesce(permuted(F.col("block"), F.col("n"), F.col("key")), F.lit(NONE)).alias("block"))


@dataclass
class Mix:
    sources: list[Source]
    docs: DataFrame  # doc_id, source_index, size, start
    slots: DataFrame
    shards: DataFrame  # the mixed corpus, a row per slot: shard, slot, source_index, pass, block, text, parts


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most: int = MOST, seed: int = SEED) -> Mix:
    """docs: doc_id, text, source. Sources in code point order, null last, take the weights in turn.

    Rows of one id are documents of their own; a null text has no words and is never taken. Other columns are not read.
    `docs` is read twice (sizes, then texts) and has to give the same rows. Sizes, draws, pieces and the mixed shards are written to the
    shared folder once, so that reruns of lost tasks agree and the shuffle files of one step go before the next."""
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), words(text).alias("size"), F.xxhash64(text).alias("digest"))
    sizes = written(sized.drop("text"), "mix-sizes")
    sources = recipe(sizes, weights, block_words, most)
    draws = written(drawn(docs.sparkSession, sources, shard_slots, seed), "mix-draws")
    taking = slots(draws, sources, block_words, seed)
    cut = written(pieces(placed(sized, sizes, sources, seed), block_words), "mix-pieces", compression="zstd")
    return Mix(sources, placed(sizes, sizes, sources, seed), taking, written(joined(taking, packed(cut)), "mix-shards", compression="zstd"))


def taken(m: Mix) -> DataFrame:
    """doc_id, source_index, size, taken: a document's words in the rows of the mixed shards."""
    used = m.shards.select("source_index", F.explode("parts").alias("p")).groupBy("source_index", F.col("p.start").alias("start")).agg(F.sum("p.words").alias("taken"))
    some = m.docs.where("size > 0").join(used, ["source_index", "start"], "left").select("doc_id", "source_index", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return some.unionByName(m.docs.where("size = 0").select("doc_id", "source_index", "size", F.lit(0).cast("long").alias("taken")))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    m = mix(docs)
    table = docs.sparkSession.createDataFrame([(i, s.size, s.target) for i, s in enumerate(m.sources)], "source_index int, source_size long, target double")
    return taken(m).join(F.broadcast(table), "source_index").select("doc_id", "size", "source_size", "target", "taken")
