"""A small table of documents with every awkward case, and columns whose names clash with the operators' own."""

import random

import pytest

WORDS = {
    "en": "the of and that with river stone under morning people always house little water".split(),
    "de": "der und nicht über schön straße mädchen zwischen große wasser häuser morgen".split(),
    "fr": "le une être avec château très forêt garçon après où eau maison petit".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, score double, digest string, prefix string, features string"


def prose(lang: str, n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "", str(r.randrange(50))]) for _ in range(n))


PASSAGE = prose("en", 60, 999)


@pytest.fixture(scope="session")
def rows():
    out = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(lang, 40 + i, i)
        if i % 9 == 1:
            text += " | ".join(["###", "&&&"] * 30)
        if i % 10 == 3:
            text = text + " moron scum trash " + text[:40]
        out.append([i, text, lang, "s" + str(i % 4)])
    out[10][1] = PASSAGE + " " + out[10][1]
    out[40][1] = out[40][1] + " " + PASSAGE
    out[50][1] = out[20][1]
    out[51][1] = out[20][1].replace(" ", "  ")
    out[52][1] = out[20][1] + " tail"
    out += [[200, None, "en", "s0"], [201, "", None, None], [202, " \n\t ", "en", None], [203, "x", "en", "s1"], [204, "12 34 !!", "en", "s2"], [205, "word " * 30000, "en", "s0"], [206, "𝄞 é \x00 nul", "fr", "é"], [None, "no id here at all", "en", "s0"]]
    out += [out[5], out[5], [None, "no id here at all", "en", "s0"]]
    return [(*r, None if i % 7 == 0 else len(r[1] or ""), 1, "k", 0.5, "d", "p", "f") for i, r in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
