"""Page snapshots (A3): stored fetch results instead of live requests.

Schema: ``url STRING, status INT, content_type STRING, body BINARY|STRING,
etag STRING, last_modified STRING, fetched_at TIMESTAMP``. Status 200 is
content, 304 is "not modified", any other status is an error row (never an
exception). A fetcher's body limit can be asked for (``max_body_bytes``);
cut bodies are marked ``truncated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH_BODY_BYTES = 20 * 1024 * 1024  # what a fetcher keeps of a body, for max_body_bytes


def read_snapshots(spark: SparkSession, path: str, fmt: str = "parquet", max_body_bytes: int = 0) -> DataFrame:
    return prepare_snapshots(spark.read.format(fmt).load(path), max_body_bytes)


def prepare_snapshots(df: DataFrame, max_body_bytes: int = 0) -> DataFrame:
    """Adds ``truncated``, ``not_modified``, ``error`` and ``error_kind``
    (upstream for non-200/304 statuses). Bodies are whole unless
    ``max_body_bytes`` > 0."""
    body = F.col("body").cast("binary")
    long = F.coalesce(F.octet_length(body) > max_body_bytes, F.lit(False)) if max_body_bytes > 0 else F.lit(False)
    cut = F.when(long, F.substring(body, 1, max_body_bytes)).otherwise(body) if max_body_bytes > 0 else body
    status = F.col("status")
    err = F.when(~status.isin(200, 304), F.format_string("HTTP %d for %s", status, F.col("url")))
    return (df.withColumn("truncated", long).withColumn("body", cut)
            .withColumn("not_modified", status == 304)
            .withColumn("error", err)
            .withColumn("error_kind", F.when(err.isNotNull(),
                                             F.when(status == 404, F.lit("not_found")).otherwise(F.lit("upstream")))))


def snapshots_from_pages(pages: DataFrame) -> DataFrame:
    """The driver's ``pages`` table as 200 OK HTML snapshots."""
    return pages.select(
        "page_id", "url", F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("html").alias("body"), F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("timestamp").alias("fetched_at"))
