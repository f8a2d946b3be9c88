"""Operator 10, sharding: Hilbert-curve ordering.

Several metadata dimensions are quantised into 2^BITS bins at their own
quantiles, each document gets the index of its cell on a Hilbert curve, the
documents are sorted by that index, and the order is cut into runs of equal
row counts (law ``rows``: at most one apart). A run holds neighbours in every
dimension, so the ranges of the dimensions per file prune well.

The order is total (curve index, id, size, checksum): one range shuffle of
narrow rows sorts it whatever share a cell or an id has, since ids split a hot
cell. Equal texts of one source and language are neighbours in size and share
a cell; the law decides where a run is cut.

The quantiles come from ``percentile_approx`` over all rows: 2^BITS - 1 cut
points a dimension reach the driver, no more.

Defined results: a null text has size 1 and checksum 0; null metadata sorts
first; repeated rows get a place each; an empty table gives an empty result;
columns beside the dimensions are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import written

BITS = 6
DIMENSIONS = ("lang", "source", "size")


def hilbert_index(axes: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below
    2^bits, by Skilling's transform (AIP Conf. Proc. 707, 2004), on arrays."""
    x = [np.array(a, np.int64) for a in axes]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            flip = (x[i] >> b) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | (((a ^ turn) >> b) & 1)
    return out


def _number(column: str, kind: T.DataType, shared: int) -> Column:
    """A number in the order of the column. Strings: the six bytes after the
    prefix that all values share; longer ones tie, which costs pruning only."""
    if not isinstance(kind, T.StringType):
        return F.col(column).cast("double")
    digits = F.substring(F.rpad(F.hex(F.expr(f"substring(`{column}`, {shared + 1}, 6)")), 12, "0"), 1, 12)
    return F.conv(digits, 16, 10).cast("double")


def curve_order(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``curve``, the Hilbert index of its quantised dimensions."""
    kinds = {d: df.schema[d].dataType for d in dimensions}
    texts = [d for d, k in kinds.items() if isinstance(k, T.StringType)]
    shared = dict.fromkeys(texts, 0)
    if texts:
        ends = df.agg(*(f(d).alias(f"{n}_{i}") for i, d in enumerate(texts) for n, f in (("lo", F.min), ("hi", F.max)))).first()
        shared = {d: len(os.path.commonprefix([ends[f"lo_{i}"] or "", ends[f"hi_{i}"] or ""])) for i, d in enumerate(texts)}
    names = [f"_d{i}" for i in range(len(dimensions))]
    numbered = df.withColumns({n: _number(d, kinds[d], shared.get(d, 0)) for n, d in zip(names, dimensions)})
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = numbered.agg(*(F.percentile_approx(n, shares, 10_000).alias(n) for n in names)).first()
    edges = [np.array(cuts[n] or [], np.float64) for n in names]

    @F.arrow_udf("bigint")
    def index(*axes: pa.Array) -> pa.Array:
        bins = [np.where(a.is_null().to_numpy(zero_copy_only=False), 0,
                         np.searchsorted(e, a.fill_null(0).to_numpy(zero_copy_only=False), "left"))
                for a, e in zip(axes, edges)]
        return pa.array(hilbert_index(bins, bits), pa.int64())

    return numbered.withColumn("curve", index(*names)).drop(*names)


def numbered_order(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """``df`` with ``rank`` from 0 in the order of ``keys``, and the row count.
    Sorted runs are numbered in place and written; only one row per run is
    ever brought together to add the offsets."""
    schema = T.StructType([*df.schema.fields, T.StructField("_run", T.IntegerType()), T.StructField("_at", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, run), pa.int32()), pa.array(np.arange(at, at + b.num_rows), pa.int64())],
                names=schema.names)
            at += b.num_rows

    runs = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema))
    counts = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_run", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    total = counts.agg(F.sum("_c")).first()[0] or 0
    ranked = runs.join(offsets, "_run").withColumn("rank", F.col("_before") + F.col("_at"))
    return ranked.drop("_run", "_at", "_before"), total


def hilbert_shards(docs: DataFrame, n_shards: int = 8, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """One row per document: id, size, checksum, the dimensions, its place on
    the curve, its shard and its slot there."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    meta = [d for d in dimensions if d != "size"]
    base = written(docs.select("doc_id", (F.octet_length(whole) + 1).cast("bigint").alias("size"),
                               F.crc32(whole.cast("binary")).alias("text_crc32"), *meta))
    ranked, n = numbered_order(curve_order(base, dimensions, bits), ("curve", "doc_id", "size", "text_crc32"))
    first = lambda s: F.expr(f"({s} * {n}L + {n_shards - 1}) div {n_shards}")
    placed = ranked.withColumn("shard", F.expr(f"(rank * {n_shards}) div {max(n, 1)}L").cast("int"))
    return placed.withColumn("slot", F.col("rank") - first("shard")).drop("rank")


def shard_ranges(sharded: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Per shard the rows and the range of every dimension: what a reader needs
    to skip files."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *(
        f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))))


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """The documents as Parquet, a folder per shard, in curve order. Ids must
    be unique."""
    places = sharded.select("doc_id", "shard", "slot")
    (docs.join(places, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op10(docs: DataFrame) -> DataFrame:
    return hilbert_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")
