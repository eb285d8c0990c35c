"""Periodic runs of words: stretches in which a phrase stands at least twice in a row.

Every run's repeating phrase has a rotation that is the longest Lyndon word at its place, under one of two opposite orders of
the words. So for both orders the longest Lyndon word at each place is found - it ends where the next smaller suffix starts,
as the stack of an algorithm scanning from right to left holds it - and extended to both sides while its period lasts. Suffixes
are compared, and words extended, by longest common extensions: a binary search over rolling hashes of words (two primes, so
about 62 bits). No suffix array is built. Every run found is verified word by word; should a verification fail, the
text is done again with other hashes.

The scan is done for all texts of a batch at once. Each place points to the place after it and jumps along the pointers until
a smaller suffix is reached; jumping over places that aren't settled yet is right as well, since what lies between is larger.
Chains that take more than `JUMPS` jumps are finished place by place from the right.

Time grows as n log n in the words of a text, memory is about 150 bytes a word of the batch (1 MB of texts, or one longer text).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import by_bytes, utf8

LEAST, JUMPS = 12, 64
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    size, factor = 1, base % prime
    while size < n:
        out[size : 2 * size] = out[: min(size, n - size)] * factor % prime
        size, factor = 2 * size, factor * factor % prime
    return out


class Extensions:
    """Longest common extensions in a sequence of word numbers; texts end with a 0, which no extension crosses."""

    def __init__(self, words: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        self.hashes = []
        for prime in _PRIMES:
            power = _powers(int(r.integers(1 << 20, prime)), prime, len(words) + 1)
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum((words + 1) % prime * power[:-1] % prime, out=sums[1:])  # below 2^31 times the words
            self.hashes.append((prime, power, sums % prime))

    def equal(self, i: np.ndarray, j: np.ndarray, size) -> np.ndarray:
        """Whether the `size` words from i on are those from j on; i < j."""
        same = np.ones(len(i), bool)
        for prime, power, sums in self.hashes:
            same &= (sums[i + size] - sums[i]) % prime * power[j - i] % prime == (sums[j + size] - sums[j]) % prime
        return same

    def longest(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i and j on are equal (back: before i and j), at most `most`."""
        got = np.zeros(len(i), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length() >> 1
        while step:
            at = np.flatnonzero(got + step <= most)
            shift = -got[at] - step if back else got[at]
            got[at[self.equal(i[at] + shift, j[at] + shift, step)]] += step
            step >>= 1
        return got


def _larger(words: np.ndarray, ends: np.ndarray, ext: Extensions, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the suffix at j is larger than the one at i; i < j in one text, j may be its end."""
    a, b = words[i], words[j]
    out = b > a
    at = np.flatnonzero(a == b)
    for shift in (1, 2, 3):  # most suffixes differ within a few words
        a, b = words[i[at] + shift], words[j[at] + shift]
        out[at] = b > a
        at = at[a == b]
    if len(at):
        x, y = i[at], j[at]
        size = ext.longest(x, y, ends[np.searchsorted(ends, y)] - y)
        out[at] = words[y + size] > words[x + size]
    return out


def next_smaller(words: np.ndarray, ends: np.ndarray, ext: Extensions) -> np.ndarray:
    """For each place the first later place with a smaller suffix, the text's end (a smaller, empty one) at the latest."""
    at = np.arange(1, len(words) + 1)
    open_ = np.flatnonzero(words)
    for _ in range(JUMPS):
        open_ = open_[_larger(words, ends, ext, open_, at[open_])]
        if not len(open_):
            return at
        at[open_] = at[at[open_]]
    for i in open_[::-1].tolist():
        j = int(at[i])
        while words[j] > words[i] or words[j] == words[i] and _larger(words, ends, ext, np.array([i]), np.array([j]))[0]:
            j = int(at[j])
        at[i] = j
    return at


def runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST, seed: int = 0) -> np.ndarray:
    """Rows (start, length, period), sorted, of all runs of at least `least` words. words: numbers from 1 on, texts one after the other with
    a 0 before, between and after them and three more 0 at either end; ends: the places of the 0 from the first on."""
    ext = Extensions(words, seed)
    near = min(3, (least + 3) // 4)  # a run extends its Lyndon word by half of `least` or more, and by half of that on one side
    found = []
    for order in (words, np.where(words > 0, words.max() + 1 - words, 0)):
        after = next_smaller(order, ends, ext)
        i = np.flatnonzero(words)
        j = after[i]
        ahead, behind = np.ones(len(i), bool), np.ones(len(i), bool)
        for k in range(near):
            ahead &= words[i + k] == words[j + k]
            behind &= words[i - 1 - k] == words[j - 1 - k]
        at = ahead | behind
        i, j = i[at], j[at]
        period = j - i
        here = np.searchsorted(ends, i)
        right, left = ends[here] - j, i - ends[here - 1] - 1
        half = (period + 1) // 2
        at = np.zeros(len(i), bool)
        for room, back in ((right, 0), (left, 1)):
            k = np.flatnonzero(room >= half)
            at[k] |= ext.equal(i[k] - back * half[k], j[k] - back * half[k], half[k])
        i, j, period, right, left = (x[at] for x in (i, j, period, right, left))
        ahead, behind = ext.longest(i, j, right), ext.longest(i, j, left, back=True)
        length = period + ahead + behind
        at = length >= np.maximum(least, 2 * period)
        found.append(np.stack([i - behind, length, period], axis=1)[at])
    out = np.unique(np.concatenate(found), axis=0)
    for s, n, p in out.tolist():
        e = s + n
        if not np.array_equal(words[s : e - p], words[s + p : e]) or words[s - 1] == words[s + p - 1] or words[e] == words[e - p]:
            return runs(words, ends, least, seed + 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own change: in one document of ten the words repeat with a period from some word on. Documents without an id stay."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def detect(docs: DataFrame, least: int = LEAST, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (each run cut down to
    its first period; the kept words joined by one space).

    One row for each row of docs, repeated rows too. A null, empty or blank text has no words, no runs and an empty `collapsed`. A null id
    stays null. Other columns are not read. change: gets id and words and gives the words to use instead."""

    def work(batches):
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in by_bytes(utf8(batch.column(1)), 1 << 20):
                words = [t.split() for t in texts]  # at ASCII white space alone
                if change:
                    words = [change(d, w) for d, w in zip(ids[first:], words, strict=False)]
                sizes = np.array([len(w) for w in words])
                ends = np.concatenate([[3], 3 + np.cumsum(sizes + 1)])
                codes = np.zeros(ends[-1] + 4, np.int64)
                numbers: dict[bytes, int] = {}
                place = np.ones(len(codes), bool)
                place[ends] = place[:3] = place[-3:] = False
                codes[place] = np.fromiter((numbers.setdefault(x, len(numbers) + 1) for w in words for x in w), np.int64, int(sizes.sum()))
                found = runs(codes, ends, least) if len(numbers) else np.empty((0, 3), np.int64)
                doc = np.searchsorted(ends, found[:, 0]) - 1
                change_at = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change_at, found[:, 0] + found[:, 2], 1)
                np.add.at(change_at, found[:, 0] + found[:, 1], -1)
                kept = np.cumsum(change_at) == 0
                hit = set(doc.tolist())
                texts = [b" ".join(compress(w, kept[ends[d] + 1 :].tolist()) if d in hit else w) for d, w in enumerate(words)]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(words)))])
                parts = [pa.array(x) for x in (found[:, 0] - ends[doc] - 1, found[:, 1], found[:, 2])]
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(words)], pa.int64()), pa.array(sizes, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def report(docs: DataFrame) -> DataFrame:
    """The digests of detect() over the documents with their planted repetitions: doc_id, n_words, n_runs, the longest run (ties: the first, then
    the one with the smallest period; nulls if there is none) as start, length, period, exponent_milli, and runs_sha256, collapsed_sha256."""
    found = detect(docs, change=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_words", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
