"""Operators 11 to 13 against brute force, over the small documents with every awkward case and over random data."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import op11_periodic, op12_graph_search, op13_spelling


# 11: periodic runs


def brute_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):  # smaller periods first: a stretch keeps its smallest
        s = 0
        while s + p < len(words):
            e = s
            while e + p < len(words) and words[e] == words[e + p]:
                e += 1
            if e + p - s >= max(least, 2 * p) and e > s:
                found.setdefault((s, e + p - s), p)
            s = max(e, s) + 1
    smallest = {k: p for k, p in found.items() if not any(q < p and words[k[0] : k[0] + k[1] - q] == words[k[0] + q : k[0] + k[1]] for q in range(1, p))}
    return sorted((s, n, p) for (s, n), p in smallest.items())


def brute_periodic(doc_id, text, change=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if change and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_periodic_report(docs, rows, none):
    got = op11_periodic.report(docs).drop("n_words")
    short = [r for r in rows if len(r[1] or "") < 20_000]
    want = Counter(brute_periodic(r[0], r[1]) for r in short)
    assert Counter(tuple(r) for r in got.collect() if r.doc_id != 205) == want and sum(x[1] > 0 for x in want) > 5
    long = got.where("doc_id = 205").first()
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 30000, 1)
    assert op11_periodic.report(none).count() == 0


@pytest.mark.parametrize("jumps", [1, 64])
def test_periodic_random(spark, jumps, monkeypatch):
    monkeypatch.setattr(op11_periodic, "JUMPS", jumps)
    r = random.Random(jumps)
    texts = []
    for i in range(150):
        words = [r.choice("abcde"[: r.randrange(1, 6)]) for _ in range(r.randrange(0, 70))]
        at, p = r.randrange(len(words) + 1), r.randrange(1, 9)
        tail = words[at : at + p]
        texts.append((i, " ".join(words[:at] + (tail * 70)[: len(words) - at])))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for least in (2, 4, 12):
        for row in op11_periodic.detect(df, least).collect():
            assert sorted((x.start, x.length, x.period) for x in row.runs) == brute_runs(texts[row.doc_id][1].split(), least), texts[row.doc_id]


def test_periodic_hard_orders():
    fibonacci, last = [1, 2], [1]
    while len(fibonacci) < 400:
        fibonacci, last = fibonacci + last, fibonacci
    for words in (fibonacci, list(range(300, 0, -1)), [1, *range(300, 1, -1)] * 2, [1, 2, 3] * 100, [1, 2, 2, 1, 2, 1, 1, 2] * 40):
        codes = np.array([0] * 4 + words + [0] * 4)
        found = op11_periodic.runs(codes, np.array([3, 4 + len(words)]))
        assert sorted((s - 4, n, p) for s, n, p in found.tolist()) == brute_runs(words)


def test_periodic_hash_coincidence(monkeypatch):
    """Hashes that fail give way to others; verification decides."""
    whole = op11_periodic.Extensions.longest
    monkeypatch.setattr(op11_periodic.Extensions, "longest", lambda self, i, j, most, back=False: np.minimum(whole(self, i, j, most, back) + self.broken, most))
    monkeypatch.setattr(op11_periodic.Extensions, "broken", 0, raising=False)
    init = op11_periodic.Extensions.__init__

    def seeded(self, words, seed=0):
        init(self, words, seed)
        self.broken = int(seed == 0)

    monkeypatch.setattr(op11_periodic.Extensions, "__init__", seeded)
    words = [9, 1, 2, 3] + [5, 6, 7] * 6 + [8, 4, 4]
    codes = np.array([0] * 4 + words + [0] * 4)
    assert op11_periodic.runs(codes, np.array([3, 4 + len(words)])).tolist() == [[8, 18, 3]]


# 12: graphs


def inner(v, w):
    """In order and without compensation, as sum() would have it."""
    total = 0.0
    for a, b in zip(v, w):
        total += a * b
    return total


def brute_nearest(vectors, k=20):
    known = {}
    for i, v in vectors:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            known.setdefault((i, tuple(c + 0.0 for c in v)), None)
    out = []
    for i, v in known:
        if i % 20 == 0:
            scored = sorted((-inner(v, w), j) for j, w in known if len(w) == len(v) and (i, v) != (j, w))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return out


def test_graph_small(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 6)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(1000 + i, x[40]) for i in range(50)] + [(3, x[3]), (40, x[40]), (60, x[61]), (400, None), (420, []), (440, [0.0] * 6), (460, [1.0, None, 1, 1, 1, 1]), (480, [float("nan")] * 6), (481, [float("inf"), 1, 1, 1, 1, 1]), (500, [1.0, 2.0, 3.0]), (501, [3.0, 2.0, 1.0]), (520, [1.0]), (540, [1e18] * 6), (None, x[5]), (-20, [-0.0, 0.5, 1, 1, 1, 1])]
    df = spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], 7, "q", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, query string, shard int").repartition(3)
    want = brute_nearest([(i, v and [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    graphs, plan = op12_graph_search.index(df, rows_per_shard=60)
    many = op12_graph_search.search(graphs, plan, df.where("vec_id % 20 = 0"))
    assert plan.agg({"shards": "sum"}).first()[0] > 8
    pair = lambda found: Counter((q, j, s) for q, _, j, s in found)
    for got in (op12_graph_search.report(df).collect(), many.collect()):
        assert Counter((q, rank) for q, rank, _, _ in got) == Counter((q, rank) for q, rank, _, _ in want)
        assert len(pair(want) & pair(got)) >= 0.97 * len(got)
        got = sorted(map(tuple, got))
        assert all(x[0] != y[0] or x[1] == y[1] or (-x[3], x[2]) < (-y[3], y[2]) for x, y in zip(got, got[1:]) if x[0] != 60)
    exact = lambda q: [x for x in sorted(map(tuple, got)) if x[0] == q] == [x for x in sorted(want) if x[0] == q]
    assert exact(500) and exact(40) and exact(540)
    assert op12_graph_search.report(df.limit(0)).count() == 0 and op12_graph_search.report(df.where("vec_id = 520")).count() == 0


@pytest.mark.parametrize("spread", [0.5, 3.0])
def test_graph_recall(spark, spread):
    r = np.random.default_rng(5)
    x = r.normal(size=(25, 32))[r.integers(0, 25, 3000)] + spread * r.normal(size=(3000, 32))
    x *= r.lognormal(0, 0.5, size=(3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in op12_graph_search.report(df).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    inner = x[::20] @ x.T
    inner[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    hits = [len(got[20 * i] & set(np.argsort(-inner[i])[:20].tolist())) for i in range(150)]
    assert sum(hits) >= 0.99 * 3000


def test_graph_reaches_every_point():
    r = np.random.default_rng(6)
    x = op12_graph_search.unit(np.vstack([r.normal(size=(500, 8)), 20 + 0.01 * r.normal(size=(300, 8)), [[1000.0] * 8]]))
    edges, entry = op12_graph_search.build(x, degree=4, width=8)
    seen, front = set(), {entry}
    while front:
        seen |= front
        front = {int(j) for i in front for j in edges[i] if j >= 0} - seen
    assert len(seen) == len(x) and (edges >= 0).sum(1).max() <= 4 + op12_graph_search.SPARE


def test_graph_search_works_in_small_batches():
    """What a search holds doesn't grow with the number of queries, and a query finds the same alone."""
    r = np.random.default_rng(7)
    x = op12_graph_search.unit(r.normal(size=(3000, 16)))
    queries = op12_graph_search.unit(r.normal(size=(2048, 16)))
    edges, entry = op12_graph_search.build(x)
    tracemalloc.start()
    found = op12_graph_search.beam_search(x, edges, entry, queries, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
    for i in range(0, 2048, 256):
        assert (op12_graph_search.beam_search(x, edges, entry, queries[i : i + 1], 32) == found[i]).all()


# 13: spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute_variants(words):
    nears = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: v for w in words if nears[w] and words[v := min(nears[w], key=lambda v: (-words[v], v))] >= 10 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, len(nears[w]), form.get(w), words.get(form.get(w)), root))
    return out


def test_spelling_report(spark, docs, rows, none):
    r = random.Random(8)
    base = ["mississippi", "aaaaaaaa", "straßenbahn", "château÷fort", "ÉcoLesÀ", "abcdefgh", "abababab"]
    texts = []
    for i in range(400):
        w = list(r.choice(base))
        for _ in range(r.randrange(3) if i % 3 == 0 else 0):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1])] = r.choice(["", "a", "b", "ÿ"])
        texts.append((i % 90, " ".join(["".join(w)] * r.randrange(1, 12)) + "Āx"))
    texts += [(None, "abcdefgh abcdefgh abcdefg"), (5, None), (6, ""), (7, "z" * 3000 + " " + "z" * 3001 + " " + "z" * 3000), (8, "z" * 3000 + "\n" + "z" * 3001)]
    texts += [(301, "Chainwords " * 300 + "chainword " * 20 + "chainwor " * 2)]
    mine = spark.createDataFrame(texts, "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang", "key", "n_chars").unionByName(mine, allowMissingColumns=True)
    words = brute_counts([(r[0], r[1]) for r in rows] + texts)
    want = brute_variants(words)
    assert {tuple(r) for r in op13_spelling.report(both).select("word", "n", "n_near", "form", "form_n", "root").collect()} == want
    assert sum(x[3] is not None for x in want) > 20 and any(x[3] and x[3] != x[5] for x in want)
    assert op13_spelling.report(none).count() == 0 and op13_spelling.report(docs.where("doc_id = 203")).count() == 0


@pytest.mark.parametrize("group", [1, 3, 20, 10**6])
def test_spelling_pairs(spark, group):
    """Dense words of few letters share most halves: tries are split down to single places, and each pair is found once."""
    r = random.Random(group)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(150)} | {"common" + "".join(r.choice("xyz") for _ in range(4)) for _ in range(60)})
    got = op13_spelling.pairs(spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long"), group, count_bits=4).collect()
    assert sorted((x.word, x.near, x.near_n) for x in got) == sorted((a, b, words.index(b) + 1) for a in words for b in words if near(a, b))


def test_errata_once():
    r = random.Random(1)
    for _ in range(200):
        words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(0, 7))) for _ in range(40)})
        found = list(op13_spelling.errata(dict.fromkeys(words)))
        assert len(found) == len({frozenset(x) for x in found})
        assert {frozenset(x) for x in found} == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_roots(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w3")]
    got = op13_spelling.roots(spark.createDataFrame(links, "word string, form string"), 13).collect()
    assert {r.root for r in got} == {"w13"} and len(got) == 14
