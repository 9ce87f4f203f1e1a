"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes the documents that its predecessor kept and returns documents
with the same columns; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dealbook.llm.common import table, written
from dealbook.llm.language_id import known_language_documents
from dealbook.llm.mixing import KEPT_SHARE, mixed_documents
from dealbook.llm.ngram_join import one_per_group
from dealbook.llm.packing import pack
from dealbook.llm.toxicity import clean_documents

#: Near-duplicates: word n-grams of this width, and the least Jaccard similarity in percent.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays near chance."""
    return known_language_documents(docs, docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    return clean_documents(docs, docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates."""
    return one_per_group(docs, NEAR_WIDTH, NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their target weights."""
    return mixed_documents(docs, share=KEPT_SHARE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL: the first two stages are learned classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
