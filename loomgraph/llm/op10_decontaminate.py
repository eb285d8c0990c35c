"""Benchmark decontamination by winnowing.

Both sides are cut into words. Hashes of k consecutive words are k-grams; in every window of w consecutive k-grams
the least hash is kept as a fingerprint, with k + w - 1 = `span`. A span of `span` words shared by a document and an
item is one whole window on both sides, so both keep the same fingerprint in it: no shared span of that length is
missed. Documents and items are joined on fingerprints, and every hit is extended to the left and right as far as the
words agree; a run of `span` words or more is an occurrence. An item with fewer words than `span` is fingerprinted as
one k-gram of its own length (w = 1).

As every window has a fingerprint of its own, a fingerprint travels with the words that can be in a window with it and
no others, and equal surroundings in one document travel once: the join never meets texts. Fingerprints of documents
that no item has are left out by a bitmap of 2^`bits` places, which is of one size for any benchmark; it only saves work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHash, by_bytes, grams, mixed, shared, utf8, written

SPAN, K, BITS = 10, 5, 27
#: Word characters are 0-9, a-z (A-Z lower-cased) and everything outside ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARK = "key long, near binary, off int"  # a fingerprint, the words around it (by space), and how many of them are before it


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def selected(h: np.ndarray, w: int) -> np.ndarray:
    """Which k-grams are the least of some window of w consecutive ones (equal hashes all count)."""
    n = len(h)
    if n < w:
        return np.zeros(n, bool)
    least = h[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, h[j : n - w + 1 + j], out=least)
    best = np.zeros(n, np.uint64)  # the greatest of the window minima over each k-gram
    for j in range(w):
        np.maximum(best[j : n - w + 1 + j], least, out=best[j : n - w + 1 + j])
    return best == h


def fingerprints(lists: list[list[bytes]], cache: WordHash, span: int, k: int, sizes: list[int], on: np.ndarray | None = None):
    """The fingerprints of several texts, as lists of words: (text, first word, key, words around it, how many are before it).

    sizes: lengths under `span` that are fingerprinted whole; on: a bitmap of keys, if others are not wanted."""
    ends = np.cumsum([len(x) for x in lists])
    words = cache.array([w for x in lists for w in x])
    for size, whole in [(k, False), *((n, True) for n in sizes)]:
        h = grams(words, size)
        keep = np.ones(len(h), bool) if whole else selected(h, span - size + 1)
        key = mixed(h ^ np.uint64(size)) if whole else h
        if on is not None:
            place = key >> np.uint64(64 - int(len(on) * 8).bit_length() + 1)
            keep &= (on[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(keep)
        for p, d, x in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist(), key[at].view(np.int64).tolist(), strict=True):
            own = lists[d]
            p -= int(ends[d]) - len(own)
            if p + size > len(own):
                continue
            first, last = (p, p + size) if whole else (max(0, p - span + size), p + span)
            yield d, p, x, b" ".join(own[first:last]), p - first


def marked_items(items: DataFrame, span: int, k: int) -> DataFrame:
    """item_id, need (words that an occurrence has at least) and the fingerprints of the items, each once."""

    def run(batches):
        cache = WordHash()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for first, texts in by_bytes(utf8(batch.column(1))):
                for i, words in enumerate(map(words_of, texts), first):
                    short = 0 < len(words) < span
                    rows += [(ids[i], len(words) if short else span, *x[2:]) for x in fingerprints([words], cache, span, k, [len(words)] if short else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32()), strict=True)], ["item_id", "need", "key", "near", "off"])

    some = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return some.mapInArrow(run, "item_id string, need int, " + _MARK).distinct()


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """2^bits places as bytes; those of the keys' upper bits are on."""
    place = F.shiftrightunsigned("key", 64 - bits)
    rows = keys.select(F.shiftright(place, 3).alias("byte"), F.expr("1L").alias("one"), (place % 8).cast("int").alias("bit")).groupBy("byte").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("on"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.toLocalIterator():
        out[r.byte] = r.on
    return out


def extended(near: bytes, off: int, other: bytes, at: int) -> tuple[int, int]:
    """How many words before and from the common fingerprint on agree."""
    a, b = near.split(), other.split()
    left = right = 0
    while left < min(off, at) and a[off - left - 1] == b[at - left - 1]:
        left += 1
    while right < min(len(a) - off, len(b) - at) and a[off + right] == b[at + right]:
        right += 1
    return left, right


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, n_words, n_hit, items (sorted as strings).

    A null or wordless text has no words and is not hit. An item without an id or words is passed over; items of one id
    count once. Every document row gives a row of its own, repeated ones and those without an id too, at every size of the
    benchmark. Other columns are not read. No items, or no documents: no hits, or no rows."""
    return keyed_hits(docs, items, span, k, bits)[1]


def keyed_hits(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The same; and a table of one row per row of docs before it: row (its number), doc_id, n_words."""
    marks = written(marked_items(items, span, k), "winnow-items")
    sizes = sorted(r.need for r in marks.select("need").distinct().collect() if r.need < span)  # less than span numbers
    sent = shared(docs.sparkSession, (_bitmap(marks, bits), sizes))

    def run(batches):
        on, sizes = sent()
        cache, row = WordHash(), TaskContext.get().partitionId() << 40
        for batch in batches:
            n_words, found = [], []
            for _, texts in by_bytes(utf8(batch.column(1))):
                lists = [words_of(t) for t in texts]
                here: list[dict] = [{} for _ in lists]
                for d, p, *mark in fingerprints(lists, cache, span, k, sizes, on):
                    here[d].setdefault(tuple(mark), []).append(p)
                n_words += [len(x) for x in lists]
                found += [[{"key": key, "near": near, "off": off, "at": at} for (key, near, off), at in x.items()] for x in here]
            rows, row = range(row, row + len(n_words)), row + len(n_words)
            kind = pa.list_(pa.struct([("key", pa.int64()), ("near", pa.binary()), ("off", pa.int32()), ("at", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, kind)], ["row", "doc_id", "n_words", "marks"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(texts.mapInArrow(run, "row long, doc_id long, n_words long, marks array<struct<key:long,near:binary,off:int,at:array<long>>>"), "winnow-docs", compression="zstd")
    hits = every.select("row", F.inline("marks")).join(marks.select("item_id", "need", "key", F.col("near").alias("other"), F.col("off").alias("other_off")), "key")

    def extend(batches):
        for batch in batches:
            rows, names, need, near, off, other, other_off, at = (batch.column(i).to_pylist() for i in range(8))
            out = []
            for i, (a, x, b, y) in enumerate(zip(near, off, other, other_off, strict=True)):
                left, right = extended(a, x, b, y)
                if left + right >= need[i]:
                    runs: list[dict] = []  # those that touch as one
                    for p in at[i]:
                        if runs and p - left <= runs[-1]["end"]:
                            runs[-1]["end"] = p + right
                        else:
                            runs.append({"start": p - left, "end": p + right})
                    out.append((rows[i], names[i], runs))
            types = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, types, strict=True)], ["row", "item_id", "runs"])

    runs = hits.select("row", "item_id", "need", "near", "off", "other", "other_off", "at").mapInArrow(extend, "row long, item_id string, runs array<struct<start:long,end:long>>")
    spans = F.array_sort(F.flatten(F.collect_list("runs")))
    words = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n")))["n"]
    found = runs.groupBy("row").agg(words.alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = every.select("row", "doc_id", "n_words")
    result = rows.join(found, "row", "left").select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows, result.drop("row")


def report(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) t(i)),
m AS (SELECT r, i, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM m), unnest(range(i, i + n)) t(p) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""
