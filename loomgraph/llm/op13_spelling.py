"""Spelling variants: groups words that one inserted, deleted or replaced character takes to a much more frequent word.

Pairs of words that differ by one edit come from errata tries. A trie of words is taken apart into heavy paths. At a node, each
word of a light subtree gives errata: its character at that place skipped, replaced by any other (a wildcard) or by the heavy child's, or the
heavy child's put before it. Errata of the light subtrees are merged with each other and with the words below the node; terminals that
coincide are one edit apart. Two words part at one node and at most one of them on the heavy path there, so each pair is found, and once. A
word stands in at most log2(n) light subtrees (small-to-large), so a trie of n words gives about n log2(n) errata.

Words are dealt to tries by what an edit leaves alone: of two words a half of the shorter one is the same, at the start or else at
the end. A trie holds the words of one length (and one more) with one such half. Where more than `GROUP` words may share a half, they
are dealt by halves of what is left, and so on down to one place of the word; how many share it is counted for all words, in a table of
2^`COUNT_BITS` counters by hash, and a counter that is too large for its words only means smaller tries. So a trie holds about
`GROUP` words at most, whatever the words are, and every pair meets in exactly one.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, written

#: Fewest code points and occurrences of a word, how many times as frequent its form is, one run in how many loses a character.
LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
GROUP, COUNT_BITS, HELD = 50_000, 18, 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """docs (doc_id, text) -> word, n: letter runs of at least `least_length` characters and how often they occur, `least_count` times or more.

    A-Z are lower-cased. A run whose crc32 with its document's id is divisible by `every` loses a character (a planted misspelling). Each row counts,
    repeated ones too; a null text has no words, a null id is written as nothing in the crc32. Other columns are not read."""

    def work(batches):
        found: Counter[str] = Counter()

        def made():
            items = pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())
            found.clear()
            return pa.RecordBatch.from_arrays(list(items), ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    start = zlib.crc32(f"{doc_id.as_py()}:".encode() if doc_id.is_valid else b":")
                    for m in _RUN.finditer(text.as_py()):
                        if m.end() - m.start() < least_length:
                            continue
                        run = m[0].translate(_LOWER)
                        h = zlib.crc32(run.encode(), start)
                        if h % every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                        found[run] += 1
                        if len(found) >= HELD:
                            yield made()
        if found:
            yield made()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def errata(words: dict[str, object]) -> Iterator[tuple[str, str]]:
    """Pairs of words, each once, that differ by one character inserted, deleted or replaced. words: its keys, in code-point order."""
    names = list(words)
    todo = [(0, len(names))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        a, b = names[lo], names[hi - 1]
        depth, most = 0, min(len(a), len(b))
        step = most
        while step:  # length of the common prefix
            if depth + step <= most and a[depth : depth + step] == b[depth : depth + step]:
                depth += step
            else:
                step >>= 1
        stem, at, children = a[:depth], lo, []
        if len(a) == depth:
            at += 1
        while at < hi:
            c = names[at][depth]
            end = bisect_left(names, stem + chr(ord(c) + 1), at + 1, hi)
            children.append((end - at, at, end, c))
            at = end
        todo += [(s, e) for _, s, e, _ in children]
        heavy = max(children)
        if len(a) == depth and stem + heavy[3] in words:
            yield a, stem + heavy[3]
        wild: dict[str, list[str]] = {}
        for child in children:
            if child is heavy:
                continue
            for word in names[child[1] : child[2]]:
                tail = word[depth + 1 :]
                if tail[:1] != child[3] and stem + tail in words:  # skipped
                    yield word, stem + tail
                if (other := stem + heavy[3] + tail) in words:  # replaced
                    yield word, other
                if (other := stem + heavy[3] + word[depth:]) in words:  # the heavy character skipped on the other side
                    yield word, other
                same = wild.setdefault(tail, [])
                yield from ((word, other) for other in same)
                same.append(word)


def _keys(rows: DataFrame) -> DataFrame:
    """rows (word, n, m, lo, hi: of the shorter word's m characters those from lo to hi may be edited), each once with either half of them left alone."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))).alias("half")
    rows = rows.select("word", "n", "m", half).select("word", "n", "m", "half.lo", "half.hi")
    core = F.expr("substring(word, lo + 1, length(word) - m + hi - lo)")
    key = F.concat_ws("\u0001", "m", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("right(word, m - hi)"))
    return rows.withColumn("core", core).withColumn("trie", key).withColumn("h", F.xxhash64(key))


def tries(words: DataFrame, group: int = GROUP, count_bits: int = COUNT_BITS, shortest: int = 0) -> DataFrame:
    """words (word, n) of at least `shortest` characters -> rows dealt to tries: word, n, m, hi, core, trie, h."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).withColumn("lo", F.lit(0)).withColumn("hi", F.col("m")).where(F.col("m") >= shortest)
    out = None
    while True:
        rows = _keys(rows)
        place = F.pmod("h", F.lit(1 << count_bits)).alias("place")
        many = written(rows.groupBy(place).count().where(F.col("count") > group).select("place"), "spelling-many")
        if many.isEmpty():
            return rows if out is None else out.unionByName(rows)
        split = rows.withColumn("place", place).join(F.broadcast(many.withColumn("many", F.lit(True))), "place", "left").withColumn("many", F.col("many").isNotNull() & (F.col("hi") - F.col("lo") > 1))
        fine = split.where(~F.col("many")).select(rows.columns)
        out = fine if out is None else out.unionByName(fine)
        rows = written(split.where("many").select("word", "n", "m", "lo", "hi"), "spelling-split")
        if rows.isEmpty():
            return out


def pairs(words: DataFrame, group: int = GROUP, count_bits: int = COUNT_BITS, shortest: int = 0) -> DataFrame:
    """words (word, n), each word once -> word, near, near_n: for each word those that differ from it by exactly one inserted, deleted or replaced character."""
    dealt = tries(words, group, count_bits, shortest).select("h", "trie", "core", "word", "n", "m", "hi")

    def work(batches):
        now, held = None, []
        out: list[tuple[str, str, int]] = []

        def found():
            m, hi = held[0][3], held[0][4]
            words = {core: (word, n) for core, word, n, _, _ in held}
            for a, b in errata(words):
                (x, nx), (y, ny) = words[a], words[b]
                # two words of m + 1 characters meet as the shorter ones of another trie; two with one first half too, in the trie for that half
                if (len(x) == m or len(y) == m) and (hi == m or x[:hi] != y[:hi]):
                    out.extend(((x, y, ny), (y, x, nx)))

        def made():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64())], ["word", "near", "near_n"])

        for batch in batches:
            for trie, *row in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                if trie != now:
                    if len(held) > 1:
                        found()
                    now, held = trie, []
                held.append(row)
                if len(out) > 10_000:
                    yield made()
        if len(held) > 1:
            found()
        if out:
            yield made()

    return dealt.repartition("h").sortWithinPartitions("h", "trie", "core").mapInArrow(work, "word string, near string, near_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """forms (word, form) without cycles, chains of at most `most` links -> word, root: the end of the chain. Each round doubles what a row has followed."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, most))))):
        last = now
        now = written(last.join(last.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        forget(last)
    return now


def group_variants(words: DataFrame, times: int = TIMES, group: int = GROUP, count_bits: int = COUNT_BITS, shortest: int = 0) -> DataFrame:
    """words (word, n), each word once and of at least `shortest` characters -> word, n, n_near, form, form_n, root.

    form: the near word of largest n (ties: smallest in code-point order), if that n is at least `times` its own; else null. root: from the word along the
    forms to the last. No words: no rows. Forms grow by `times` a link, which bounds their chains."""
    words = words if hasattr(words, "_written_at") else written(words, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = pairs(words, group, count_bits, shortest).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), _form(F.col("best"), F.col("n"), times)), "spelling-forms")
    known = known.select("word", "n", "n_near", "form.near", (-F.col("form.n")).alias("form_n")).withColumnRenamed("near", "form")
    top = known.agg(F.max("n")).first()[0] or 1
    links = roots(known.where("form is not null").select("word", "form"), int(math.log(top, max(2, times))) + 1)
    return known.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _form(best: Column, n: Column, times: int) -> Column:
    return F.when(-best["n"] >= times * n, best).alias("form")


def report(docs: DataFrame) -> DataFrame:
    """The words of all documents with their planted misspellings, and their forms."""
    return group_variants(counts(docs), shortest=LEAST_LENGTH)
