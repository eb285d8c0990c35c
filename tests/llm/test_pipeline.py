"""The pipeline's stages on a small folder of tables."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import PASSAGE
from tests.llm.test_operators import brute_classes, brute_hits


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder, docs):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, after = now.collect(), stage(spark, now, folder)
        if name != "mixing":
            assert after.columns == docs.columns
        rows = after.collect()
        ids = {r.doc_id for r in rows}
        if name == "language_id":
            assert not {200, 201, 202, 204} & ids and set(range(90)) <= ids
        if name == "near_duplicates":
            keep = [(a, b) for (a, _, b), _ in brute_classes([(r.doc_id, r.text) for r in before], 5, 80).items()]
            assert ids == {a for a, b in keep if a == b or a is None} and len(rows) == len({(r.doc_id, r.text) for r in rows})
        if name == "decontamination":
            assert {r.doc_id for r in before} - ids == {r.doc_id for r in before if brute_hits(r.text, [("1", PASSAGE)])[1]}
        if name == "personal_data":
            assert len(rows) == len(before)
        if name == "mixing":
            assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in before)
        now = spark.createDataFrame(rows, after.schema)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert set(got.columns) == {"doc_id", "size", "source_size", "target", "taken"} and got.count() > 50
