"""Transitive closure against plain Python, and what its steps hold."""

import random

import pytest

from loomgraph.operators import graph as G


def reached(pairs):
    out, after = set(), {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for a in after:
        met, left = set(), list(after[a])
        while left:
            if (x := left.pop()) not in met:
                met.add(x)
                left += after.get(x, ())
        out |= {(a, x) for x in met if x != a}
    return out


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def rings(n, size):
    """Rings of one size, each with a way into the next but one; the last ones lead nowhere."""
    return [(size * k + i, size * k + (i + 1) % size) for k in range(n) for i in range(size)] + [(size * k, size * (k + 2) + 3) for k in range(n - 2)]


def chains(n, size):
    """Chains in a circle, one of which is left in its middle as well, and two behind it that lead nowhere."""
    inner = [(size * k + i, size * k + i + 1) for k in range(n + 2) for i in range(size - 1)]
    return [*inner, *((size * k + size - 1, size * ((k + 1) % n)) for k in range(n)), (size // 2, size * n), (size * n + size - 1, size * (n + 1))]


@pytest.mark.parametrize("pairs", [chains(4, 9), [(random.Random(i).randrange(60), random.Random(-i - 1).randrange(60)) for i in range(130)], rings(12, 6), [(i, i + 1) for i in range(40)], [(None, 1), (1, 2), (2, 1), (2, None)]], ids=["chains", "random", "rings", "path", "nulls"])
def test_equals_searches(spark, monkeypatch, pairs):
    for name, value in (("SMALL", 0), ("DENSE", 1), ("PART", 4), ("TASK", 20)):
        monkeypatch.setattr(G, name, value)
    got = [tuple(r) for r in G.closure(edges_of(spark, pairs)).collect()]
    assert len(got) == len(set(got)) and set(got) == reached([p for p in pairs if None not in p])


def test_steps_dont_hold_all_pairs(spark, monkeypatch):
    """Where all nodes reach each other, joining all pairs with all pairs makes n^3 rows; the steps hold a part of the pairs only."""
    monkeypatch.setattr(G, "SMALL", 0, raising=False)
    r, sizes, settled = random.Random(1), [], G.settled

    def counted(df):
        sizes.append((out := settled(df)).count())
        return out

    monkeypatch.setattr(G, "settled", counted)
    pairs = [(i, (i + 1) % 300) for i in range(300)] + [(r.randrange(300), r.randrange(300)) for _ in range(300)]
    assert G.closure(edges_of(spark, pairs)).count() == 300 * 299
    assert max(sizes) < 300 * 299 // 2
