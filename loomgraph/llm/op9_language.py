"""Language ID: script ranges narrow the candidates of every word, then Viterbi over per-word scores with a penalty for
switching labels spans, so that texts of several languages come apart.

The model has log probabilities of byte trigrams (hashed to `buckets`) for each language, and the scripts that each
language was seen in (by code points; a word has the last of its characters' scripts in the table's order). A word's score for a language is the sum over its trigrams; a language without the word's script
is no candidate for it. A word that no language is a candidate for takes its neighbours' label and no weight. The
Viterbi recursion runs over many documents at once.

It is fitted on at most about `fit_docs` labelled documents; everything else reads all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_sample, by_bytes, crc_mod, shared, small_batches, utf8

FIT_DOCS, BUCKETS, PENALTY, SMOOTH = 20_000, 1 << 15, 12.0, 0.5
#: Work array bytes per chunk of text and language.
CHUNK_BYTES = 16 << 20
#: Scripts and their letters' Unicode ranges (first and last). What is in none has no script.
SCRIPTS = {
    "Latin": "0041-005A 0061-007A 00AA-00AA 00BA-00BA 00C0-00D6 00D8-00F6 00F8-02AF 1E00-1EFF 2C60-2C7F A722-A7FF FB00-FB06 FF21-FF3A FF41-FF5A",
    "Greek": "0370-0373 0376-037D 0386-0386 0388-03FF 1F00-1FFF",
    "Cyrillic": "0400-0481 048A-052F 1C80-1C8F A640-A69F",
    "Armenian": "0531-0556 0561-0587",
    "Hebrew": "05D0-05F2 FB1D-FB4F",
    "Arabic": "0620-0669 066E-06D3 06FA-06FF 0750-077F 08A0-08FF FB50-FDFF FE70-FEFC",
    "Devanagari": "0900-0963 0966-097F",
    "Bengali": "0980-09FF",
    "Gurmukhi": "0A00-0A7F",
    "Gujarati": "0A80-0AFF",
    "Oriya": "0B00-0B7F",
    "Tamil": "0B80-0BFF",
    "Telugu": "0C00-0C7F",
    "Kannada": "0C80-0CFF",
    "Malayalam": "0D00-0D7F",
    "Sinhala": "0D80-0DFF",
    "Thai": "0E01-0E3A 0E40-0E4E",
    "Lao": "0E80-0EDF",
    "Tibetan": "0F00-0FFF",
    "Myanmar": "1000-109F",
    "Georgian": "10A0-10FF 1C90-1CBF 2D00-2D2F",
    "Hangul": "1100-11FF 3131-318E AC00-D7A3",
    "Ethiopic": "1200-137F",
    "Khmer": "1780-17D3",
    "Kana": "3041-3096 3099-309F 30A1-30FA 30FC-30FF FF66-FF9D",
    "Han": "3005-3007 3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF",
}
OTHER, N_SCRIPTS = 0, len(SCRIPTS) + 1
_RANGES = sorted((*(int(x, 16) for x in r.split("-")), i) for i, ranges in enumerate(SCRIPTS.values(), 1) for r in ranges.split())
_FIRST, _LAST, _OF = (np.array(x) for x in zip(*_RANGES, strict=True))
_ASCII = np.zeros(256, np.uint8)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = 1
_BLANK = bytes(c if c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages
    scripts: np.ndarray  # scripts x languages: is it a candidate?
    penalty: float = PENALTY


def _folded(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode("utf-8").translate(_BLANK)


def scripts_of(a: np.ndarray) -> np.ndarray:
    """The script of the character that begins at each byte of UTF-8 text; OTHER at continuation bytes and what is no letter."""
    out = _ASCII[a]
    at = np.flatnonzero(a >= 0xC0)
    if len(at):
        lead = a[at].astype(np.int64)
        wide = np.concatenate([a, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
        two, three = (lead & 0x1F) << 6 | wide[at + 1], (lead & 0x0F) << 12 | wide[at + 1] << 6 | wide[at + 2]
        four = (lead & 0x07) << 18 | wide[at + 1] << 12 | wide[at + 2] << 6 | wide[at + 3]
        point = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
        near = np.searchsorted(_FIRST, point, side="right") - 1
        out[at] = np.where((near >= 0) & (point <= _LAST[near]), _OF[near], OTHER)
    return out


def _laid(texts: list[bytes], buckets: int):
    """The texts as one array: trigram bucket of each byte, which bytes are in words, where words start, and each word's text."""
    joined = b" " + b" ".join(texts) + b" "
    a = np.frombuffer(joined, np.uint8)
    wide = a.astype(np.uint32)
    gram = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int32)
    inside = a[1:-1] != 32
    starts = np.flatnonzero(inside & (a[:-2] == 32))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return a[1:-1], bucket, inside, starts, np.searchsorted(ends, starts, side="right")


def counts(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts and script counts of the texts."""
    a, bucket, inside, _, _ = _laid([_folded(t) for t in texts], buckets)
    return np.bincount(bucket[inside], minlength=buckets), np.bincount(scripts_of(a)[inside], minlength=N_SCRIPTS)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """scores: words x languages, document after document; sizes: words of each. The best path's label of each word."""
    label = np.zeros(len(scores), np.int32)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return label
    first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    came = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    most = int(size[0])
    active = np.searchsorted(-size, -np.arange(most), side="left")  # documents with more words than t
    v = scores[first].copy()
    for t in range(1, most):
        k = active[t]
        before = v[:k]
        top = before.argmax(1)
        switch = before[np.arange(k), top] - penalty
        rows = first[:k] + t
        change = before < switch[:, None]
        came[rows] = np.where(change, top[:, None].astype(np.int16), own)
        v[:k] = np.where(change, switch[:, None], before) + scores[rows]
    now = v.argmax(1).astype(np.int32)
    label[first + size - 1] = now
    for t in range(most - 1, 0, -1):
        k = active[t]
        rows = first[:k] + t
        now[:k] = came[rows, now[:k]]
        label[rows - 1] = now[:k]
    return label


def word_scores(scores: np.ndarray, bucket: np.ndarray, inside: np.ndarray, starts: np.ndarray, most: int = CHUNK_BYTES) -> np.ndarray:
    """Sums of the trigrams' scores for each word and language, a slice of the bytes after the other, so that a long text or word needs no more memory."""
    word = np.zeros((len(starts), scores.shape[1]), np.float32)
    step = max(1 << 10, most // (4 * max(1, scores.shape[1])))
    for lo in range(int(starts[0]), len(inside), step):
        hi = min(lo + step, len(inside))
        each = scores[bucket[lo:hi]]
        each[~inside[lo:hi]] = 0
        first, last = np.searchsorted(starts, [lo, hi - 1], side="right") - 1
        word[first : last + 1] += np.add.reduceat(each, np.concatenate([[0], starts[first + 1 : last + 1] - lo]), axis=0)
    return word


def predict(model: Model, texts: list[bytes]) -> list[tuple[str, float, list[tuple[str, int]]]]:
    """(language, share of the letters' bytes that carry it, runs of (language, words)) for each text."""
    folded = [_folded(t) for t in texts]
    n = len(model.langs)
    if not n:
        return [("und", 0.0, [])] * len(texts)
    a, bucket, inside, starts, doc = _laid(folded, len(model.scores))
    sizes = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    if len(starts):
        word = word_scores(model.scores, bucket, inside, starts)
        long = np.add.reduceat(inside, starts, dtype=np.int64)
        allowed = model.scripts[np.maximum.reduceat(scripts_of(a), starts)]
        known = allowed.any(1)
        word = np.where(allowed, word, word.min(1, keepdims=True) - 50.0)
        word[~known] = 0
        label = viterbi(word, sizes, model.penalty)
        weight = np.bincount(doc * n + label, weights=long * known, minlength=len(texts) * n).reshape(-1, n)
    else:
        label, weight = np.zeros(0, np.int32), np.zeros((len(texts), n))
    best, total = weight.argmax(1), weight.sum(1)
    cuts = np.flatnonzero(np.diff(label) != 0) + 1
    ends = np.cumsum(sizes)
    out = []
    for d, text in enumerate(texts):
        if not any(map(str.isalpha, text.decode("utf-8", "replace"))):  # Unicode's letters; numerals such as ½ or ⅷ are none
            out.append(("und", 0.0, []))
            continue
        lo, hi = int(ends[d] - sizes[d]), int(ends[d])
        edge = [lo, *cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, hi, "left")].tolist(), hi]
        runs = [(model.langs[label[s]], e - s) for s, e in zip(edge, edge[1:], strict=False) if e > s]
        out.append((model.langs[best[d]], float(weight[d, best[d]] / total[d]) if total[d] else 0.0, runs))
    return out


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, buckets: int = BUCKETS, penalty: float = PENALTY) -> Model:
    """labelled: doc_id, text, lang. Rows with null lang, text or id are passed over; no rows: a model without languages."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = bounded_sample(rows.dropna(), "doc_id", fit_docs, 9)

    def count(batches):
        trigrams, scripts = {}, {}
        for batch in batches:
            texts, langs = list(utf8(batch.column(1))), batch.column(2).to_pylist()
            for lang in set(langs):
                for _, some in by_bytes(t for t, x in zip(texts, langs, strict=True) if x == lang):
                    g, s = counts(some, buckets)
                    trigrams[lang] = trigrams.get(lang, 0) + g
                    scripts[lang] = scripts.get(lang, 0) + s
        keys = sorted(trigrams)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([trigrams[k].astype(np.int64).tobytes() for k in keys], pa.binary()), pa.array([scripts[k].astype(np.int64).tobytes() for k in keys], pa.binary())], ["lang", "grams", "scripts"])

    total: dict[str, list] = {}
    for r in rows.mapInArrow(count, "lang string, grams binary, scripts binary").toLocalIterator():  # languages x 8 rows
        x = total.setdefault(r.lang, [0, 0])
        x[0], x[1] = x[0] + np.frombuffer(r.grams, np.int64), x[1] + np.frombuffer(r.scripts, np.int64)
    langs = sorted(total)
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), penalty)
    g = np.array([total[x][0] for x in langs], float).T + SMOOTH
    s = np.array([total[x][1] for x in langs], float).T
    scripts = s >= 0.01 * s[OTHER + 1 :].sum(0).clip(1)
    scripts[OTHER] = False  # continuation bytes and symbols tell nothing about a language
    return Model(langs, np.log(g / g.sum(0)).astype(np.float32), scripts, penalty)


def identify(docs: DataFrame, model: Model, keep: float | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, spans; with `keep`, docs' own rows that have a language and this score at least.

    A null or letterless text is `und` with score 0. Texts with letters of no learned script get the first language and
    score 0. Repeated rows each give a row. Other columns are not read (with `keep`: passed through)."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = shared(spark, model)
    text_at = docs.columns.index("text") if keep is not None else 1
    most = max(1 << 16, CHUNK_BYTES // max(1, len(model.langs)))

    def run(batches):
        model = sent()
        for batch in batches:
            found = [x for _, texts in by_bytes(utf8(batch.column(text_at).cast(pa.string())), most) for x in predict(model, texts)]
            if keep is not None:
                yield batch.filter(pa.array([x[0] != "und" and x[1] >= keep for x in found], pa.bool_()))
                continue
            spans = pa.array([[{"lang": a, "words": b} for a, b in x[2]] for x in found], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    if keep is not None:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,words:long>>")


def learned_rows() -> Column:
    return crc_mod("doc_id", 4) != 2


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns. A null id is not held out (and not learned from)."""
    found = identify(docs, fit(docs.where(learned_rows())))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
