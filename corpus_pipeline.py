"""The corpus pipeline: five stages over documents, each written as a table and read again as the next one's input.

Part of the subpackage llm: whoever deletes that deletes this file too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import decontam, lines, neardup, packing, toxicity
from grainmill.llm.common import drop, only
from grainmill.llm.registry import table, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score stays below their language's threshold."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with one line of each group of alike lines in the corpus; those left without any line go."""
    return lines.clean(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("lines", lines_stage),
    ("neardup", neardup_stage),
    ("decontam", decontam_stage),
    ("packing", packing_stage),
]

#: A trained classifier, MinHash components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents. Of the tables that a stage and those before it have written, its result alone is left."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        new = only(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if docs is not before:
            drop(docs)
        docs = new
    return docs
