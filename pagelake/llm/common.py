"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import ensure_checkpoint_dir

#: Bytes of a word: everything but these separates nothing. Fixed by contract.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row. Catalyst inlines
    a plain alias into every use, and into every turn of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, so that other columns never clash."""
    return docs.select("doc_id", "text")


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    return docs.schema[column].dataType.simpleString()


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the
    lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
