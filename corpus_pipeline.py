"""A corpus pipeline: language ID, near duplicates, decontamination, personal data, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`, for the rows that they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import op1_pii, op4_mixing, op8_jaccard, op9_language, op10_decontaminate
from loomgraph.llm.common import forget, table, written

#: A document goes if less than this share of its letters is in the language that most of them are in.
LEAST_SCORE = 0.4


#: Numbered copies that earlier stages have read.
_COPIES: list[DataFrame] = []


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written once: ids can be null or repeated, and what is decided about one row isn't about another."""
    _COPIES.append(written(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows"))
    return _COPIES[-1]


def _clear(docs: DataFrame) -> None:
    """Deletes the copies of earlier stages, whose results have been written by now: all but those that docs itself is read from."""
    files = docs.inputFiles() if _COPIES else []
    for copy in [c for c in _COPIES if not any(c._written_at.rsplit("/", 1)[-1] in f for f in files)]:
        forget(copy)
        _COPIES.remove(copy)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_row").alias("doc_id"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts of no main language. The model is learned from the documents' own labels."""
    return op9_language.identify(docs, op9_language.fit(docs.where(op9_language.learned_rows())), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the row with the least doc_id stays (one without an id only if none has one); texts without words stay."""
    _clear(docs)
    rows = _numbered(docs)
    found = op8_jaccard.classes(_texts(rows)).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    keep = found.join(rows.select("_row", "doc_id"), "_row").groupBy("_group").agg(first).select(F.col("first._row").alias("_row"))
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row with a benchmark item (or the whole of a shorter one)."""
    _clear(docs)
    rows = _numbered(docs)
    found = op10_decontaminate.decontaminate(_texts(rows), table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("_row"))
    return rows.join(found, "_row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; no document goes."""
    _clear(docs)
    return op1_pii.mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken."""
    _clear(docs)
    return op4_mixing.report(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]

#: Viterbi labels, near duplicates and hash permutations aren't expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
