"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes: h = 2 h + gear[byte] in 16 bits, so it depends on the last 16 bytes alone. A
chunk ends where the hash's upper bits are zero (on average every 2^`mask_bits` bytes, only between characters), or
after `longest` bytes. The same passage is cut at the same places wherever it stands, so an insertion changes the
chunks next to it and no others.

Chunks are compared by a 128-bit digest of their bytes over the whole corpus (two longs, d1 and d2), so no two different chunks
are expected to coincide in 3e12 of them. The first occurrence (least doc_id, then position) is kept; later ones are repeats. Short
chunks repeat by chance, so repeats count only in runs: consecutive repeated chunks with `least_bytes` bytes or more together are removed.

A document is an id and a 63-bit hash of its text, `doc`; without an id the hash is negative and a second hash of 64 bits stands
for the id, so that the texts that have no id are told apart by 127 bits.

A digest that very many chunks have doesn't meet in one task: of `HOT` digests at most, those with more than a share of
1 / `HOT` of all chunks, the first occurrences are broadcast. The rest is joined by digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import by_bytes, utf8, written

MASK_BITS, LONGEST, LEAST_BYTES, SEED, HOT = 5, 1024, 96, 5, 20_000


def gear(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(text: np.ndarray, table: np.ndarray, mask_bits: int = MASK_BITS, longest: int = LONGEST) -> np.ndarray:
    """Ends of the chunks of a text (bytes as an array), the last one its length."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    h = table[text]
    for step in (1, 2, 4, 8):  # the sum over the last 2, 4, 8, 16 bytes; gear values of earlier bytes have been shifted out
        h[step:] += h[:-step] << np.uint16(step) if step < n else 0
    ends = np.flatnonzero(h[: n - 1] >> np.uint16(16 - mask_bits) == 0) + 1
    whole = np.ones(n + 1, bool)
    whole[:n] = (text & 0xC0) != 0x80  # no cut before a continuation byte
    ends = np.concatenate([ends[whole[ends]], [n]])
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > longest:
        more = [np.arange(s + longest, e, longest) for s, e in zip(starts, ends, strict=True) if e - s > longest]
        forced = []
        for at in np.concatenate(more).tolist():
            while not whole[at]:
                at -= 1
            forced.append(at)
        ends = np.unique(np.concatenate([ends, forced]).astype(np.int64))
    return ends


def chunks(docs: DataFrame, mask_bits: int = MASK_BITS, longest: int = LONGEST) -> DataFrame:
    """key and doc (which document), at (first byte), size, d1, d2 (digest) of each chunk of each text."""

    def run(batches):
        table = gear()
        for batch in batches:
            known = [batch.column(0), batch.column(1)]
            for first, texts in by_bytes(utf8(batch.column(2)), 1 << 20):
                rows, at, size, digest = [], [], [], []
                for i, text in enumerate(texts, first):
                    ends = cuts(np.frombuffer(text, np.uint8), table, mask_bits, longest)
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    rows.append(np.full(len(ends), i))
                    at.append(starts)
                    size.append(ends - starts)
                    digest += [xxhash.xxh3_128_digest(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                if digest:
                    halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                    places = [pa.array(np.concatenate(x), pa.int32()) for x in (at, size)]
                    own = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([*(x.take(own) for x in known), *places, pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["key", "doc", "at", "size", "d1", "d2"])

    texts = docs.select(*_names(docs["doc_id"], docs["text"]), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "key long, doc long, at int, size int, d1 long, d2 long")


def _names(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """key, doc: which document a row is."""
    text = text.cast("string")
    h = F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1))
    other = F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")
    return F.coalesce(doc_id.cast("long"), other, F.lit(0)).alias("key"), F.when(doc_id.isNull(), -1 - h).otherwise(h).alias("doc")


def _id(key: Column, doc: Column) -> Column:
    return F.when(doc >= 0, key)


def repeats(docs: DataFrame, mask_bits: int = MASK_BITS, longest: int = LONGEST, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Runs to remove: doc_id, key and doc (tell apart different texts of one id or without an id), start, end (bytes of the UTF-8 text), first_doc_id (the document where most of the run's bytes stand first).

    docs: doc_id, text. A null or empty text has no chunks. Rows of one id and text are taken for one document, which doesn't repeat
    itself; different texts of one id, or without an id, are different documents. A null id comes after all others. Other columns are not read."""
    every = written(chunks(docs, mask_bits, longest), "chunks")
    digest = ["d1", "d2"]
    first = F.min(F.struct((F.col("doc") < 0).alias("none"), "key", "doc", "at")).alias("first")
    several = every.groupBy(*digest).agg(F.count("*").alias("times"), first).where("times > 1")
    known = written(several.select(*digest, "times", F.col("first.key").alias("key1"), F.col("first.doc").alias("doc1"), F.col("first.at").alias("at1")), "chunks-known")
    many = F.col("times") * HOT > every.count()
    hot = F.broadcast(known.where(many).drop("times"))  # at most HOT rows, since the times add up to the count
    rare = every.join(hot.select(*digest), digest, "left_anti").join(known.where(~many).drop("times"), digest)
    own = (F.col("key") == F.col("key1")) & (F.col("doc") == F.col("doc1")) & (F.col("at") == F.col("at1"))
    again = every.join(hot, digest).unionByName(rare).where(~own).select("key", "doc", "at", "size", "key1", "doc1")
    order = Window.partitionBy("key", "doc").orderBy("at")
    marked = again.withColumn("starts", (F.col("at") > F.coalesce(F.lag(F.col("at") + F.col("size")).over(order), F.lit(-1))).cast("int"))
    runs = marked.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = runs.groupBy("key", "doc", "run", "key1", "doc1").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end"), F.sum("size").alias("bytes"))
    best = F.max_by(F.struct("key1", "doc1"), F.struct("bytes", F.col("doc1") >= 0, F.bitwise_not("key1"), "doc1")).alias("first")
    found = parts.groupBy("key", "doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), best)
    return found.where(F.col("end") - F.col("start") >= least_bytes).select(_id(F.col("key"), F.col("doc")).alias("doc_id"), "key", "doc", "start", "end", _id(F.col("first.key1"), F.col("first.doc1")).alias("first_doc_id"))


def removed(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs' own rows and columns, with the runs taken out of `text`."""

    spans = runs.groupBy(F.col("key").alias("_key"), F.col("doc").alias("_doc")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    raw = F.col("text").cast("binary")
    kept = F.aggregate(
        "_runs", F.struct(F.lit(0).alias("at"), F.lit(b"").cast("binary").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(raw, a["at"] + 1, s["start"] - a["at"])).alias("out")),
        lambda a: F.concat(a["out"], F.substr(raw, a["at"] + 1)),
    )
    key, doc = _names(docs["doc_id"], docs["text"])
    joined = docs.join(spans, (key == F.col("_key")) & (doc == F.col("_doc")), "left")
    return joined.withColumn("text", F.when(F.col("_runs").isNotNull(), kept.cast("string")).otherwise(F.col("text"))).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document that repeats something: doc_id, n_runs, removed_bytes, runs ("start:end" by comma), first_doc_ids (the documents that keep it)."""
    return repeats(docs).groupBy("doc_id", "key", "doc").agg(
        F.count("*").alias("n_runs"), F.sum(F.col("end") - F.col("start")).cast("long").alias("removed_bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("runs"),
        F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"),
    ).drop("key", "doc")
