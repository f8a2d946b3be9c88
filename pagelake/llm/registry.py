"""Queries of the operators, by name, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import (bpe, class_lm, fingerprints, ngram_join, packing, periodic_runs, pii, prefix_trie, quality_rules,
                          sharding, token_counts, token_files, vector_dedup)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def _over_docs(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _over_docs(quality_rules.op1),
    "op2_pii": _over_docs(pii.op2),
    "op3_token_counts": _over_docs(token_counts.op3),
    "op4_vector_dedup": lambda spark, sf_dir: vector_dedup.op4(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")),
    "op5_bpe": _over_docs(bpe.op5),
    "op6_best_fit_packing": _over_docs(packing.op6),
    "op7_ngram_join": _over_docs(ngram_join.op7),
    "op8_class_lm": _over_docs(class_lm.op8),
    "op9_token_files": _over_docs(token_files.op9),
    "op10_hilbert_shards": _over_docs(sharding.op10),
    "op11_fingerprints": _over_docs(fingerprints.op11),
    "op12_prefix_trie": lambda spark, sf_dir: prefix_trie.op12(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")),
    "op13_periodic_runs": _over_docs(periodic_runs.op13),
}

ORACLES: dict[str, str] = {"op1_quality_rules": quality_rules.ORACLE}
