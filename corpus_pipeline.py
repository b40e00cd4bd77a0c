"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, personal data, packing.

Every stage reads what its predecessor wrote. All but the last return the columns of documents, so stages can be left out or
reordered. A stage sees all rows that its predecessor kept; an empty table passes through all of them. Columns beside doc_id,
text and lang are carried along whatever their names.

Nulls, ties and repeated rows: quality_rules rejects a null or empty text, which has no words; where other stages meet one, it
equals other empty texts, is linked with nothing, holds no personal data and is a single end token. Rows of one doc_id and one
text all stay if that id is the smallest of its group. A row without an id goes if its text also stands in a row that has one;
no near duplicate without an id goes. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.llm import common, divergence_rules, exact_dedup, heavy_light_join, pii_spans, squares_packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the divergence rules reject; null and empty texts fail the base rule."""
    return divergence_rules.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the rows of the smallest id; a null text counts as empty."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; rows without an id or a word stay."""
    dropped = heavy_light_join.ngram_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the kind of data, and their lengths; a null text stays null."""
    masked = pii_spans.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null text is the end token alone."""
    return squares_packing.squares_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("personal_data", private),
    ("packing", packed),
]

#: SQL has no tokenizer and no packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
