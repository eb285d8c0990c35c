"""Many names sought in many texts in one pass: an automaton over the names finds, from left to right, the longest name at each
place, without overlaps; a name counts where no letter, digit or underscore adjoins it."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import settled

#: Names in one automaton, texts that one task scans with it.
BLOCK, TASK_TEXTS = 50_000, 1 << 20


class Automaton:
    """A trie of names with failure links."""

    def __init__(self, names: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.length = [0], [0]
        for name in names:
            at = 0
            for c in name:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.length.append(0)
                at = self.next[at][c]
            self.length[at] = len(name)
        #: The nearest shorter name that ends where this state does.
        self.shorter = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            back = self.fail[at]
            self.shorter[at] = back if self.length[back] else self.shorter[back]
            for c, to in self.next[at].items():
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                back = self.fail[at]
                todo.append(to)

    def longest(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the longest name at each place where one starts, by start."""
        found: dict[int, int] = {}
        at = 0
        for end, c in enumerate(text, 1):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            hit = at if self.length[at] else self.shorter[at]
            while hit:
                found[end - self.length[hit]] = end  # ends rise, so the longest stays
                hit = self.shorter[hit]
        return sorted(found.items())


def _clear(text: str, start: int, end: int) -> bool:
    word = lambda c: c == "_" or c.isascii() and c.isalnum()
    return not (start and word(text[start - 1])) and not (end < len(text) and word(text[end]))


def scan(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, bounded: bool = True, block: int = BLOCK) -> DataFrame:
    """key, start, end, name: one row for each name found in a text, leftmost first and longest first, without overlaps.

    texts have unique keys (longs). bounded: a find that adjoins an ASCII letter or digit or an underscore doesn't count (it still covers its characters).
    Places are counted in characters. Null and empty texts and names have no finds.

    Names are dealt by hash to automata of about `block` names. A task holds one, and texts stream through it: each text passes each
    automaton. What they find meets by key, sorted by place, and a find is taken where the last one taken has ended."""
    import pyarrow as pa

    names = settled(names.select(F.col(name).cast("string").alias("s")).where("s <> ''").distinct())
    texts = texts.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("s")).where("s <> ''")
    blocks = max(1, math.ceil(names.count() / block))
    spread = max(math.ceil(texts.count() / TASK_TEXTS), texts.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("long")
    left = names.select(F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int").alias("block"), every(spread).alias("part"), F.lit(0).alias("kind"), none.alias("k"), "s")
    right = texts.select(every(blocks).alias("block"), F.pmod(F.xxhash64("k"), F.lit(spread)).cast("int").alias("part"), F.lit(1).alias("kind"), "k", "s")

    def find(batches):
        now, held, automaton = None, [], None
        for batch in batches:
            out: list[tuple[int, int, int, bool, str]] = []
            for block_, part, kind, k, s in zip(*batch.columns, strict=True):
                block_, part, s = block_.as_py(), part.as_py(), s.as_py()
                if (block_, part) != now:
                    now, held, automaton = (block_, part), [], None
                if kind.as_py() == 0:
                    held.append(s)
                elif held or automaton:
                    if automaton is None:
                        automaton, held = Automaton(held), []
                    out += [(k.as_py(), a, b, _clear(s, a, b), s[a:b]) for a, b in automaton.longest(s)]
            yield _batch(out, ("k", "start", "end", "clear", "name"), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))

    def take(batches):
        now, at = None, 0
        for batch in batches:
            keep = []
            for i, (k, start, end) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if k != now:
                    now, at = k, 0
                if start >= at:
                    keep.append(i)
                    at = end
            yield batch.take(pa.array(keep, pa.int64()))

    def _batch(rows, columns, kinds):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], list(columns))

    both = left.unionByName(right).repartition(blocks * spread, "block", "part").sortWithinPartitions("block", "part", "kind")
    kinds = "k long, start int, end int, clear boolean, name string"
    spots = both.mapInArrow(find, kinds).repartition("k").sortWithinPartitions("k", "start", F.desc("end"))
    found = spots.mapInArrow(take, kinds)
    return (found.where("clear") if bounded else found).select(F.col("k").alias(key), "start", "end", F.col("name").alias(name))
