"""Corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows its predecessor kept, and its decisions take
effect: rejected documents and copies are gone, personal data is masked, and
what is left is packed. All stages but the last return the columns of
``documents``. Nulls, empty texts, repeated rows, empty tables and further
columns are handled as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import ngram_join, packing, pii, quality_rules
from pagelake.llm.common import written

#: Near copies of the stage; op 7's contract has values of its own.
NEAR = ngram_join.Similarity(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 rejects go."""
    return quality_rules.filter_stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id."""
    return ngram_join.first_of_each(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text, and ``n_chars`` follows it."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality_rules", quality), ("ngram_join", near_copies), ("pii", personal_data), ("best_fit_packing", pack)]

#: Components of links, masking and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
