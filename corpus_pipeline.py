"""Corpus pipeline: documents in, tokenised clean documents out.

Each stage applies one operator to all rows its predecessor kept; between stages the rows are written as Parquet to the
shared folder and read again. All but the last stage return the columns of ``documents``.

| stage | what goes |
| --- | --- |
| toxicity | documents scored 0.5 or more |
| ngram_jaccard_join | all but the smallest doc_id of each group of near copies; rows equal in doc_id and text count once |
| suffix_dedup | bytes covered by a 50-byte string of a document with a smaller doc_id (rows stay, even if empty) |
| decontamination | documents of which 5 % of the words or more lie in benchmark windows |
| bpe | nothing; texts become token counts and digests |

Null texts stay null up to the last stage, where they count as empty; a row without doc_id is never a near copy and
loses no byte; an empty table passes through; extra columns are dropped by the last stage and kept by the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from echolens.llm import bpe, decontaminate, parity_join, suffix_dedup, toxicity
from echolens.llm.frames import checked, table, written


BASE = ("doc_id", "text", "lang", "source", "n_chars")


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Other columns under names that no operator uses, and the way back."""
    names = [c if c in BASE else f"extra_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = aside(docs)
    model = toxicity.learned(spark, sf_dir, rows)
    return back(toxicity.score(rows, model).filter("predicted = 0"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(parity_join.similar_groups(docs), "groups")
    gone = written(found.filter("doc <> component").select(F.col("doc").alias("doc_id")).distinct(), "copies")
    kept = docs.join(checked(gone, F.lit(8)), "doc_id", "left_anti").select(*docs.columns)
    again = written(found.filter("doc IS NOT NULL").groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("doc_id")), "repeated")
    if again.limit(1).count() == 0:
        return kept
    again = checked(again, F.lit(8))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(
        kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = aside(docs)
    found = suffix_dedup.deduplicated(rows)
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))}
    return back(found.withColumns(new))


def without_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = aside(docs)
    return back(decontaminate.contamination(rows, table(spark, sf_dir, "benchmark")).filter("NOT contaminated"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs.select(*BASE), bpe.word_bpe()).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("suffix_dedup", without_repeated_passages),
    ("decontamination", without_contamination),
    ("bpe", tokenised),
]

# The toxicity model has no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
