"""Each operator against a brute-force version, over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import op1_pii, op2_quality, op3_chat, op4_mixing, op5_chunks, op6_toxicity, op7_tiff, op8_jaccard, op9_language, op10_decontaminate
from loomgraph.llm.common import bounded_sample, threshold
from loomgraph.llm.components import components


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def labels(spark, rows):
    known = [(r[0], int(not ("###" in (r[1] or ""))), int("scum" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 200]
    return spark.createDataFrame([*known, (7, None, None)], "doc_id long, quality int, toxic int")


# 1: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PII = [
    "a@b.c_d@e.fr é x.y@z 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 4111111111111112 +1 (22) 333-4444-9 +1..", "𝄞 me@x.org, me@x.org", "+49 30 123456789 +1234567 +(1)", "1.2.3.4" * 300, "a@" * 5000, "." * 50000 + "@a.b", None, "",
    "9 " * 400, "5500 0000 0000 0004 5500 0000 0000 0004", "iban GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33", 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" and 9233A8ECF7C5B09FE5949719B6B82BC439E9329B', "ssn 123-45-6789, part 123-45-6780x 000-12-3456",
]


def test_pii(spark, docs, none):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PII)], "doc_id long, text string, pii string")
    for r in op1_pii.find(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in op1_pii.BASE] == base(PII[r.doc_id]), PII[r.doc_id][:60]
    got = {r.doc_id: [(s.kind, PII[r.doc_id][s.start : s.end]) for s in r.pii if s.kind not in op1_pii.BASE] for r in op1_pii.find(df).collect()}
    assert got[10] == [("iban", "GB82 WEST 1234 5698 7654 32")] and [k for k, _ in got[11]] == ["secret"] and got[12][0] == ("ssn", "123-45-6789")
    out = {r.doc_id: r for r in op1_pii.report(df).collect()}
    assert out[0].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base(PII[0])).encode()).hexdigest() and out[6].n_email == 0
    assert op1_pii.report(docs).count() == docs.count() and op1_pii.report(none).count() == 0
    hidden = {r.doc_id: r.text for r in op1_pii.mask(df).collect()}
    assert hidden[6] is None and hidden[1] == "𝄞 [EMAIL], [EMAIL]"
    masked = op1_pii.mask(docs)
    assert masked.columns == docs.columns and masked.exceptAll(docs).count() == 0


def test_iban_before_a_word(spark):
    texts = {1: "IBAN DE89370400440532013000 Please", 2: "IBAN DE89 3704 0044 0532 0130 00 Bitte", 3: "iban GB82WEST12345698765432 7 days", 4: "konto DE89370400440532013000X", 5: "IBAN DE89 3704 0044 0532 0130 01 Bitte"}
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.pii if s.kind == "iban"] for r in op1_pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: ["DE89370400440532013000"], 2: ["DE89 3704 0044 0532 0130 00"], 3: ["GB82WEST12345698765432"], 4: [], 5: []}


# 2, 6: classifiers


def test_quality(docs, labels, none):
    got = op2_quality.report(docs, labels).join(labels.dropna().distinct(), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9 and all(0 <= r.score <= 1 for r in got)
    assert op2_quality.report(docs, labels).count() == docs.count()
    assert {round(r.score, 9) for r in op2_quality.report(docs, labels.limit(0)).collect()} == {0.3} and op2_quality.report(none, labels).count() == 0
    held = {r.doc_id: r.held_out for r in op2_quality.report(docs, labels).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(90)) and held[None] is False


def test_bradley_terry():
    r = np.random.default_rng(0)
    x, w = r.normal(size=(4000, 3)), np.array([2.0, -1.0, 0.0])
    a, b = x[:2000], x[2000:]
    first = r.random(2000) < 1 / (1 + np.exp(-(a - b) @ w))
    assert np.abs(op2_quality.bradley_terry(np.where(first[:, None], a, b), np.where(first[:, None], b, a)) - w).max() < 0.3


def test_toxicity(docs, labels, none):
    got = op6_toxicity.report(docs, labels)
    assert got.count() == docs.count()
    joined = got.select("doc_id", F.col("toxic").alias("said"), "score").join(labels.dropna().distinct(), "doc_id").collect()
    assert np.mean([r.said == (r.toxic == 1) for r in joined]) > 0.95
    assert {round(r.score, 3) for r in op6_toxicity.report(docs, labels.limit(0)).collect()} == {0.5} and op6_toxicity.report(none, labels).count() == 0


# 3: chat


def test_pii_many_matches(spark):
    """More matches than a block has, contexts that reach over several of them, and spans that overlap or lie at the parts' ends."""
    text = "mail " + " ".join(f"+1234567{i % 10}" for i in range(700)) + " call" + "x" * 4000 + " a@b.co " + "é" * 8180 + " c@d.org 4111 1111 1111 1111 123-45-6789"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = op1_pii.find(rows).collect()[0].pii
    at = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)]
    assert [(s.start, s.end) for s in spans if s.kind == "phone"] == [x for x in at if 8 <= sum(c.isdigit() for c in text[slice(*x)]) <= 15]
    many = " | ".join(f"+1234567{i % 10}" for i in range(700))
    got = op1_pii.find(spark.createDataFrame([(1, many)], "doc_id long, text string")).collect()[0].pii
    assert [(s.start, s.end) for s in got] == [(12 * i, 12 * i + 9) for i in range(700)]
    near = {s.start: s.score for s in op1_pii.find(spark.createDataFrame([(1, "call " + "+1 2345678 | " * 6)], "doc_id long, text string")).collect()[0].pii}
    assert [near[5 + 13 * i] for i in range(6)] == [0.9, 0.9, 0.9, 0.7, 0.7, 0.7]
    masked = op1_pii.mask(spark.createDataFrame([(1, "x" * 4090 + " me@home.org " + "y" * 9000 + " a@b.co")], "doc_id long, text string")).collect()[0].text
    assert masked == "x" * 4090 + " [EMAIL] " + "y" * 9000 + " [EMAIL]"


def test_pii_masks_long_texts_beyond_the_basic_plane(spark):
    """Code points of two UTF-16 units anywhere, matches across the parts' ends, and texts of exactly so many parts."""
    r = random.Random(3)
    part = op1_pii.PART
    texts = ["𝄞" + "x" * 8180 + " a@b.co " + "y" * 20000 + " c@d.org, e", "x" * 20000 + "𝄞" + "y" * 3000 + " a@b.co z", "𝄞" * (2 * part - 7) + " a@b.co", "x" * (2 * part - 7) + " a@b.co", "x" * (part - 3) + "\n\r\n a@b.co " + "𝄞é" * part]
    texts += ["".join(r.choice(["word ", "𝄞", "é", "\r\n", " me@home.org ", " 1.2.3.4 ", " 123-45-6789 ssn "]) * r.randrange(1, 60) for _ in range(n)) for n in (40, 60, 90, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row.doc_id: row.pii for row in op1_pii.find(df).collect()}
    for row in op1_pii.mask(df).collect():
        text, out, reached = texts[row.doc_id], [], 0
        for s in sorted(found[row.doc_id], key=lambda s: (s.start, -s.end, s.kind)):
            if s.start >= reached:
                out += [text[reached : s.start], f"[{s.kind.upper()}]"]
            reached = max(reached, s.end)
        assert found[row.doc_id] and row.text == "".join(out) + text[reached:], row.doc_id


def test_pii_masks_texts_with_broken_utf8(spark):
    """Bytes that aren't UTF-8, which Spark's length and Java's strings count differently, cost no text after them."""
    raw = [b"\xf0 one " * n + b"write me@home.org " + b"\xf0\x9f end" * n for n in (1, 3, 2000)]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(raw)], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    for row in op1_pii.mask(df).collect():
        assert row.text == raw[row.doc_id].decode("utf-8", "replace").replace("me@home.org", "[EMAIL]"), row.doc_id


def test_chat_round_trip(spark):
    texts = ["", "\\", "</turn>", "### user: x</turn>\n### assistant: y", "\\e\\m\\b\\c", "</turn", "#### ", "a\n\n", "𝄞 é", None, "\\</turn>\\"]
    data = [(1 + i // 4, i, ("user", "assistant", "sys:tem", None)[i % 4], t, "z") for i, t in enumerate(texts)] + [(None, 0, "assistant", "q", "z"), (9, None, "assistant", "b", "z"), (9, 1, "assistant", "a", "z"), (9, 1, "assistant", "a", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, turns string")
    want = collections.defaultdict(list)
    for c, n, role, text, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    want[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in op3_chat.report(df).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert [r.conv_id for r in op3_chat.report(df.limit(0)).collect()] == [-7]


def test_chat_roles_as_they_stand(spark, monkeypatch):
    """Roles that other layouts have further names for; every conversation takes several layouts in turn, some are too long for JSON, and '{"messages":[]}' has no turns."""
    data = [(c, t, role, f"{role} says {t}") for c in range(40) for t, role in enumerate(("human", "bot", "user", "assistant")[c % 3 :][: 2 + c % 2])]
    df = spark.createDataFrame([*data, *((100 + c, t, role, "x" * 10) for c in range(20) for t, role in enumerate(("user", "assistant")))], "conv_id long, turn long, role string, text string")
    layouts = {r.keys for r in op3_chat.exported(op3_chat.gathered(df)).select(F.array_join(F.json_object_keys("record"), ",").alias("keys")).collect()}
    assert layouts == {"prompt,completion", "conversations", "messages", "turns"}
    want = collections.defaultdict(list)
    for r in sorted(df.collect()):
        want[r.conv_id].append((r.role, r.text))
    for most in (op3_chat.JSON_CHARS, 15):
        monkeypatch.setattr(op3_chat, "JSON_CHARS", most)
        for r in op3_chat.report(df).where("conv_id >= 0").collect():
            turns, learned = want[r.conv_id], "".join(t for role, t in want[r.conv_id] if role == "assistant")
            assert (r.n_turns, r.loss_chars) == (len(turns), len(learned)) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    none = spark.createDataFrame([('{"messages":[]}',), ('{"conversations":[]}',)], "j string").select(F.size(op3_chat.canonical_json(F.col("j")))).collect()
    assert [r[0] for r in none] == [0, 0]


def test_chat_layouts(spark):
    texts = ['{"messages":[{"role":"human","content":"hi"},{"content":"yo","role":"gpt"}]}', '{"prompt":"a","completion":"b"}', '{"output":"y","instruction":"x","input":""}', "nope", None, '{"other":1}', '{"question":"q","answer":null}']
    got = [r[0] and [tuple(t) for t in r[0]] for r in spark.createDataFrame([(t,) for t in texts], "j string").select(op3_chat.canonical_json(F.col("j"))).collect()]
    assert got == [[("user", "hi"), ("assistant", "yo")], [("user", "a"), ("assistant", "b")], [("user", "x"), ("assistant", "y")], None, None, None, [("user", "q")]]
    assert len({op3_chat.fingerprint(op3_chat._schema(m.ddl)) for m in op3_chat.MAPPINGS}) == len(op3_chat.MAPPINGS)
    with pytest.raises(ValueError):
        op3_chat.canonical(spark.createDataFrame([((1,),)], "r struct<zzz:int>"), "r")


# 4: mixing


def test_place(spark):
    for n in (1, 5, 33, 700):
        bounds = sorted(np.random.default_rng(n).integers(0, 500, n).tolist())
        got = [r[0] for r in spark.range(-1, 502).select(op4_mixing._place(F.col("id"), bounds)).collect()]
        assert got == [sum(b <= x for b in bounds) for x in range(-1, 502)]


def test_targets():
    sizes, weights = [100, 1000, 10, 5000], [1, 2, 3, 1]
    got = op4_mixing.targets(sizes, weights)
    want, capped = [0.0] * 4, set()
    while True:  # reshare until none is above
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(4) if i not in capped)
        want = [3.0 * sizes[i] if i in capped else left * weights[i] / w for i in range(4)]
        more = {i for i in range(4) if want[i] > 3 * sizes[i]}
        if not more:
            break
        capped |= more
    assert np.allclose(got, want) and abs(sum(got) - sum(sizes)) < 1e-6
    assert op4_mixing.targets([], []) == [] and op4_mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_permutation(spark):
    for n in (1, 2, 3, 10, 257):
        got = [r[0] for r in spark.range(n).select(op4_mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_shards_are_counted_by_spans(spark, monkeypatch):
    monkeypatch.setattr(op4_mixing, "SPAN", 3)
    draws = [(shard, source, 1 + (7 * shard + source) % 5) for shard in range(11) for source in (0, 2) if (shard, source) != (4, 2)]
    got = {(r.shard, r.source_index): (r.n, r.k0) for r in op4_mixing.counted(spark.createDataFrame(draws, "shard long, source_index int, n long")).collect()}
    assert got == {(shard, source): (n, sum(m for s, o, m in draws if o == source and s < shard)) for shard, source, n in draws}


def test_no_bucket_holds_all_documents_without_an_id(spark, monkeypatch):
    """Documents without an id, or of one id, are dealt over buckets by their texts; their places don't overlap."""
    monkeypatch.setattr(op4_mixing, "BUCKET_DOCS", 10)
    docs = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("word"), "id").alias("text"), F.lit("s").alias("source"))
    found = op4_mixing.mix(docs).docs
    assert sorted((r.start, r["size"]) for r in found.collect()) == [(2 * i, 2) for i in range(400)]
    order = [r.doc_id for r in sorted(found.collect(), key=lambda r: r.start)]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) > 50  # one bucket for each id would give one change


def test_mixing(docs, none, rows):
    got = op4_mixing.report(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert sum(r["size"] for r in got) == sum(size.values()) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sorted((r.doc_id or -1, r["size"], r.taken) for r in op4_mixing.report(docs.repartition(5)).collect()) == sorted((r.doc_id or -1, r["size"], r.taken) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.target, r.source_size].append(r.taken)
    assert all(abs(sum(v) - t) <= op4_mixing.BLOCK_WORDS for (t, _), v in by.items())
    m = op4_mixing.mix(docs)
    slots = m.slots.collect()
    assert len({(s.shard, s.slot) for s in slots}) == len(slots) == sum(s.quota for s in m.sources)
    assert op4_mixing.report(none).count() == 0


def test_mixed_shards(docs, none, rows):
    m = op4_mixing.mix(docs, block_words=16, shard_slots=8)
    shards = m.shards.collect()
    assert {(r.shard, r.slot, r.source_index, r.block, r["pass"]) for r in shards} == {(s.shard, s.slot, s.source_index, s.block, s["pass"]) for s in m.slots.collect()}
    assert len(shards) == sum(s.quota for s in m.sources) and max(r.slot for r in shards) == 7
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r[0], r[3]].append(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    whole = {i: [] for i in range(len(m.sources))}
    for d in sorted(m.docs.collect(), key=lambda d: d.start):
        if d["size"]:
            found = texts[d.doc_id, m.sources[d.source_index].name]
            whole[d.source_index] += found.pop(next(i for i, w in enumerate(found) if len(w) == d["size"]))
    for r in shards:
        assert r.text.split(" ") == whole[r.source_index][16 * r.block : 16 * r.block + 16] and sum(p.words for p in r.parts) == len(r.text.split(" "))
    assert sum(r.taken for r in op4_mixing.taken(m).collect()) == sum(len(r.text.split(" ")) for r in shards)
    assert op4_mixing.mix(none).shards.count() == 0
    assert not any(s.source_index == op4_mixing.NONE or s.block == op4_mixing.NONE for s in m.slots.collect())


def test_slots_plan_is_small(spark):
    sources = [op4_mixing.Source(f"s{i}", 16 * i, i, 24.0 * i, i, 1, i // 2) for i in range(1, 20)]
    slots = op4_mixing.slots(op4_mixing.written(op4_mixing.drawn(spark, sources, 8, 1), "draws"), sources, 16, 1)
    plan = slots.join(slots.select("source_index", "block").distinct(), ["source_index", "block"])._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, plan.split("\n"))) < 10_000


# 5: substring repeats


def test_cuts():
    table, r = op5_chunks.gear(), np.random.default_rng(1)
    text = r.integers(32, 127, 5000, dtype=np.uint8)
    h, want = 0, []
    for i, b in enumerate(text.tolist()):
        h = (2 * h + int(table[b])) & 0xFFFF
        if h >> 11 == 0 and i < len(text) - 1:
            want.append(i + 1)
    assert op5_chunks.cuts(text, table, 5, 10**6).tolist() == [*want, 5000]
    moved = op5_chunks.cuts(np.concatenate([text[:2500], r.integers(32, 127, 7, dtype=np.uint8), text[2500:]]), table)
    assert {e - 7 for e in moved if e > 2600} == {e for e in op5_chunks.cuts(text, table) if e > 2593}
    accents = np.frombuffer(("é" * 3000).encode(), np.uint8)
    assert all(e % 2 == 0 for e in op5_chunks.cuts(accents, table).tolist()) and len(op5_chunks.cuts(accents[:0], table)) == 0


def test_repeats(docs, none, rows):
    text = {r[0]: r[1] for r in rows}
    runs = op5_chunks.repeats(docs).collect()
    assert all(text[r.doc_id].encode()[r.start : r.end].decode() for r in runs)
    assert any(r.doc_id == 40 and r.first_doc_id == 10 and r.end - r.start > 200 for r in runs)
    assert {50, 51, 52} >= {r.doc_id for r in runs if r.first_doc_id == 20} >= {50, 52}
    assert not {r.doc_id for r in runs} & {0, 2, 4, 5, 6, 10, 200, 201, 202, 203, 204}
    again = op5_chunks.removed(docs, op5_chunks.repeats(docs))
    left = {r.doc_id: r.text for r in again.collect()}
    assert again.columns == docs.columns and again.count() == docs.count() and left[50] == "" and left[200] is None and left[3] == text[3]
    for r in runs:
        assert text[r.doc_id].encode()[r.start : r.end].decode() not in left[r.doc_id] or r.doc_id == 205
    assert op5_chunks.report(none).count() == 0 and {r.doc_id for r in op5_chunks.report(docs).collect()} == {r.doc_id for r in runs}


def test_repeats_against_brute_force(spark):
    """Each chunk of each text by the dictionary of all chunks that came before it; texts without an id, and several of one id, stay apart."""
    r, table = np.random.default_rng(11), op5_chunks.gear()
    words = [bytes(r.integers(97, 123, r.integers(2, 9), dtype=np.uint8)).decode() for _ in range(400)]
    said = lambda n: " ".join(words[i] for i in r.integers(0, len(words), n))
    passages = [said(60) for _ in range(3)]
    texts = [(i % 40 if i % 3 else None, " ".join([said(r.integers(0, 80)), passages[i // 2 % 3], said(r.integers(0, 80))]) if i % 2 else said(120)) for i in range(120)]
    texts += [texts[1], (None, ""), (None, None), (7, ""), (-5, texts[3][1]), (-(1 << 63), "x" * 3000), ((1 << 63) - 1, "x" * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = docs.select("doc_id", "text", *op5_chunks._names(docs["doc_id"], docs["text"])).distinct().collect()
    assert len({(x.key, x.doc) for x in rows}) == len(set(texts))
    first, found = {}, {}
    for x in sorted(rows, key=lambda x: (x.doc < 0, x.key, x.doc)):
        raw = (x.text or "").encode()
        ends = op5_chunks.cuts(np.frombuffer(raw, np.uint8), table).tolist()
        last = None
        for s, e in zip([0, *ends], ends, strict=False):
            if first.setdefault(raw[s:e], (x.key, x.doc, s)) == (x.key, x.doc, s):
                continue
            at = found.setdefault((x.key, x.doc), [])
            if last == s:
                at[-1][1] = e
            else:
                at.append([s, e])
            last = e
    want = {(k, d, s, e) for (k, d), at in found.items() for s, e in at if e - s >= op5_chunks.LEAST_BYTES}
    runs = op5_chunks.repeats(docs).collect()
    assert len(runs) == len(want) > 50 and {(x.key, x.doc, x.start, x.end) for x in runs} == want
    assert {x.doc_id for x in runs if x.doc >= 0} == {x.key for x in runs if x.doc >= 0} and {x.doc_id for x in runs if x.doc < 0} == {None}


# 7: media


def test_tiff_report(docs, none, rows):
    got = {r.doc_id: r for r in op7_tiff.report(docs).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        data = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        g = got[r[0]]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert op7_tiff.report(docs).count() == len(rows) and op7_tiff.report(none).count() == 0


def test_tiff_checksum_alone_picks():
    from loomgraph.llm import tiff

    r = np.random.default_rng(7)
    for size in (640, 6400, 200_000):
        data = next(d for d in (r.integers(97, 123, size, dtype=np.uint8).tobytes() for _ in range(200)) if zlib.crc32(d) % 8 == 1)
        page, = tiff.pages(op7_tiff.stored(data.ljust(-(-size // 64) * 64, b"\0")))
        assert page.compression == tiff.LZW and page.pixels.tobytes() == data, size


def test_tiff_pages(spark):
    from loomgraph.llm import tiff

    two = tiff.write([np.zeros((3, 4), np.uint8), np.ones((2, 2, 3), np.uint16)], tiff.LZW)
    df = spark.createDataFrame([(1, bytearray(two)), (2, None), (3, bytearray(b"junk")), (4, bytearray(two[:60]))], "doc_id long, media binary")
    got = op7_tiff.read_pages(df, "media", ("doc_id",)).collect()
    assert [(r.page, r.width, r.height, r.samples) for r in got if r.doc_id == 1] == [(0, 4, 3, 1), (1, 2, 2, 3)]
    three, damaged = tiff.write([np.full((4, 4), i, np.uint8) for i in range(3)], tiff.DEFLATE), None
    strip = list(tiff.directories(three))[1][1][tiff.STRIP_OFFSETS][0]
    damaged = bytearray(three[:strip] + b"\xff\xff" + three[strip + 2 :])
    some = op7_tiff.read_pages(spark.createDataFrame([(1, damaged)], "doc_id long, media binary"), "media").collect()
    assert [(r.page, r.error is None) for r in some] == [(0, True), (None, False), (2, True)]
    assert not [r for r in got if r.doc_id == 2] and all(r.error for r in got if r.doc_id in (3, 4))
    with pytest.raises(ValueError):
        op7_tiff.read_pages(df.withColumn("page", F.lit(1)), "media", ("page",))


# 8: Jaccard join


def brute_classes(rows, k, percent):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r[1]))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 62), r[0])
    return collections.Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("k,percent,extra", [(3, 90, {}), (5, 80, {"group": 2, "block": 2}), (2, 30, {"group": 3, "block": 4, "order_bits": 8})])
def test_jaccard(docs, rows, k, percent, extra):
    got = collections.Counter(tuple(r) for r in op8_jaccard.classes(docs, k, percent, **extra).collect())
    assert got == brute_classes(rows, k, percent)


@pytest.mark.parametrize("extra", [{}, {"group": 3, "block": 8, "order_bits": 10}, {"group": 6, "block": 4, "most_l": 1}])
def test_jaccard_families(spark, extra, monkeypatch):
    """Families with members that are far from most of the others, some of which only links to others bring in; pairs come in several portions."""
    monkeypatch.setattr(op8_jaccard, "PORTION", 20)
    r, rows = random.Random(8), []
    for family in range(3):
        base = [f"w{r.randrange(400)}" for _ in range(60)]
        text = base
        for i in range(45):
            text = list(base if i % 4 else text)
            for _ in range(r.choice([0, 1, 1, 2, 4, 9])):
                text[r.randrange(60)] = f"x{r.randrange(9)}"
            rows.append((1000 * family + i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(x) for x in op8_jaccard.classes(docs, 3, 70, **extra).collect())
    assert got == brute_classes(rows, 3, 70)


def test_overlaps():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 60 if i % 2 else 3000, draw.integers(1, 80)).astype(np.uint64)) for i in range(40)]
    left = np.array([1, 4, 39])
    got, want = op8_jaccard.overlaps(sets, left), np.array([[len(np.intersect1d(sets[i], x)) for x in sets] for i in left])
    other = left[:, None] != np.arange(40)
    assert (got[other] == want[other]).all()


def test_batches_of_texts_are_bounded(spark):
    """What goes to Python at a time doesn't grow with the length of texts; a session's own limit stays."""
    limit, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 20_000).alias("text"), F.lit("en").alias("lang"))
    for use in (lambda: op8_jaccard.classes(docs), lambda: op9_language.identify(docs, op9_language.Model([], np.zeros((2, 0)), np.zeros((2, 0))), 0.4)):
        spark.conf.unset(limit)
        use()
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 5 << 20
    spark.conf.set(limit, "8m")
    use()
    assert spark.conf.get(limit) == "8m"
    spark.conf.unset(limit)


def test_tables_of_counts_need_little_memory():
    counts = np.random.default_rng(4).poisson(3, 1 << 20).astype(np.int32)
    counts[7], total, large = 2**31 - 1, np.zeros(1 << 20, np.int64), np.array([2**62 + 5, 0, 255, 256])
    tracemalloc.start()
    op8_jaccard._add(total, op8_jaccard._packed(counts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (total == counts).all() and peak < 24 << 20  # less than three tables of 8 MB
    twice = large.copy()
    op8_jaccard._add(twice, op8_jaccard._packed(large - 1))
    assert (twice == 2 * large - 1).all()


def test_meetings_need_little_memory():
    draw, n = np.random.default_rng(5), 2048
    rows = pd.DataFrame({"shingle": 1, "i": 0, "j": 1, "part": np.arange(n) // 1024, "a": np.arange(n), "n": draw.integers(5, 99, n), "label": draw.integers(0, 9, n), "firsts": [[1]] * n})
    tracemalloc.start()
    got = op8_jaccard._to_compare(rows, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size, label, part = (rows[x].to_numpy() for x in ("n", "label", "part"))
    near = 100 * np.minimum.outer(size, size) >= 80 * np.maximum.outer(size, size)
    assert (got == (near & (label[:, None] != label) & (part[:, None] != part))).all() and peak < 48 << 20


def test_jaccard_short(spark):
    """Sets too small to link with any but their equals are no candidates, however many share a shingle."""
    df = spark.range(32_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("all rights reserved x"), F.floor(F.col("id") / 2)).alias("text"))
    got = op8_jaccard.report(df).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, 2, i - i % 2) for i in range(32_000)}


def test_bounded_sample(spark):
    """The whole hash is compared: at 10^11 rows the share is still right."""
    for n in (50_000, 10**11, 10**15):
        share = (threshold(20_000, n) + (1 << 63)) / (1 << 64)
        assert abs(share * n - 20_000) < 1
    assert threshold(5, 5) == (1 << 63) - 1
    got = bounded_sample(spark.range(100_000).withColumnRenamed("id", "doc_id"), "doc_id", 1000, 3).count()
    assert 850 < got < 1150


def test_jaccard_empty(none):
    assert op8_jaccard.report(none).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 3), (7, 8), (9, 8), (20, 21), (None, 4), *((i, i + 1) for i in range(100, 140))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7, 21: 20, **{i: 100 for i in range(101, 141)}}


# 9: language


def test_language(docs, none, rows):
    got = op9_language.report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[r[0]].lang_pred == r[2] for r in rows[:90]]) > 0.95
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (200, 201, 202, 204)) and by[206].lang_pred in ("en", "de", "fr")
    assert op9_language.report(none).count() == 0 and {r.lang_pred for r in op9_language.identify(docs, op9_language.fit(none)).collect()} == {"und"}
    kept = op9_language.identify(docs, op9_language.fit(docs), 0.4)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and not {200, 201, 202, 204} & {r.doc_id for r in kept.collect()}


def test_language_spans(docs):
    from tests.llm.conftest import prose

    model = op9_language.fit(docs.where("doc_id < 90"))
    (lang, score, spans), = op9_language.predict(model, [(prose("en", 60, 1) + " " + prose("de", 40, 2)).encode()])
    assert lang == "en" and 0.4 < score < 0.8 and [a for a, _ in spans] == ["en", "de"] and abs(spans[0][1] - 60) <= 2


def test_language_without_letters(docs):
    model = op9_language.fit(docs.where("doc_id < 90"))
    assert not model.scripts[op9_language.OTHER].any()
    for text in ("\u2014", "\U0001f600 \U0001f600", "\u2500\u2502\u2500 12 \u2022", "\u20ac 5", "\u00bd \u00b2", "\u2460\u2461", "\u2177"):
        assert op9_language.predict(model, [text.encode()]) == [("und", 0.0, [])], text
    learned = docs.sparkSession.createDataFrame([(1, "\u10d0\u10d1\u10d2 \u10d3\u10d4 " * 20, "ka"), (2, "the river under the stone " * 20, "en")], "doc_id long, text string, lang string")
    assert op9_language.predict(op9_language.fit(learned), ["\u10d0\u10d1\u10d2 \u2014".encode()])[0][:2] == ("ka", 1.0)
    georgian, mixed = op9_language.predict(model, ["\u10d0\u10d1\u10d2 \u10d3\u10d4".encode(), "the river \u2014 under the stone".encode()])
    assert georgian[:2] == (model.langs[0], 0.0) and mixed[:2] == ("en", 1.0)


def test_viterbi():
    import itertools

    r = np.random.default_rng(4)
    scores, sizes = r.normal(size=(12, 3)) * 2, np.array([5, 0, 1, 6])
    got = op9_language.viterbi(scores, sizes, 1.5)
    at = 0
    for n in sizes:
        value = lambda path: sum(scores[at + i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        if n:
            assert abs(value(got[at : at + n]) - max(value(p) for p in itertools.product(range(3), repeat=int(n)))) < 1e-9
        at += n


# 10: decontamination


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_hits(text, items):
    w, hit, names = words10(text), set(), set()
    for name, item in items:
        x = words10(item)
        n = min(10, len(x))
        if n == 0 or name is None:
            continue
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(name)
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("bits", [27, 6])
def test_decontaminate(spark, docs, rows, none, bits):
    from tests.llm.conftest import PASSAGE, prose

    items = [("10", PASSAGE), ("9", " ".join(PASSAGE.split()[20:29])), ("8", "WORD, word. word"), ("7", None), ("6", "?!"), (None, "the of"), ("5", prose("en", 30, 1)), ("4", "word " * 40), ("3", rows[20][1].upper())]
    table = spark.createDataFrame(items, "item_id string, text string")
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in op10_decontaminate.decontaminate(some, table, bits=bits).collect()}
    assert got == {r[0]: brute_hits(r[1], items) for r in rows if r[0] is not None}
    every = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in op10_decontaminate.decontaminate(docs, table, bits=bits).collect())
    assert every == collections.Counter((r[0], n, h, tuple(x)) for r in rows for n, h, x in [brute_hits(r[1], items)])
    assert op10_decontaminate.decontaminate(none, table).count() == 0 and not [r for r in op10_decontaminate.decontaminate(docs, table.limit(0)).collect() if r.n_hit]


@pytest.mark.parametrize("bits", [27, 6])
def test_decontaminate_rows(spark, bits):
    from tests.llm.conftest import PASSAGE, prose

    items = [("1", PASSAGE), ("2", prose("de", 50, 7)), ("3", prose("fr", 50, 8))]
    parts = [" ".join(x.split()[:20]) for _, x in items]
    data = [(i, t) for i in (None, 4) for t in (*parts, parts[0], prose("en", 20, 5))] + [(None, None), (None, ""), (None, None)]
    table, docs = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(data, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in op10_decontaminate.decontaminate(docs, table, bits=bits).collect())
    assert got == collections.Counter((i, n, h, tuple(x)) for i, (n, h, x) in ((i, brute_hits(t, items)) for i, t in data))


def test_winnowing_misses_nothing():
    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = r.integers(0, 6, 60).astype(np.uint64), r.integers(0, 6, 60).astype(np.uint64)
        at, to = r.integers(0, 50, 2)
        b[to : to + 10] = a[at : at + 10]
        x, y = ([str(w).encode() for w in side] for side in (a, b))
        marks = [list(op10_decontaminate.fingerprints([side], op10_decontaminate.WordHash(), 10, 5, [])) for side in (x, y)]
        hit = np.zeros(60, bool)
        for _, _, key, near, off in marks[0]:
            for _, p, same, other, other_off in marks[1]:
                left, right = op10_decontaminate.extended(other, other_off, near, off)
                if key == same and left + right >= 10:
                    hit[p - left : p + right] = True
        assert hit[to : to + 10].all()
