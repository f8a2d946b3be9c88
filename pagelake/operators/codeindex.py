"""A trigram index for code search.

``build`` writes a files table as it is partitioned, each partition a block,
and beside it postings: for a trigram and a block, the numbers of the files in
it that hold the trigram. A search looks up the trigrams that its term (or its
pattern's required text) must contain, takes the rarest few, and reads only the
blocks that hold a file with all of them; ``grep_code`` then decides on the
texts. The index only ever names too many files, never too few, so the answers
are those of a scan. A term without three ASCII characters in a row has no
trigram, and is searched by a scan.

    root/schema             no rows
    root/files/block=…      the files, all columns, and their number in the block
    root/postings/bucket=…  gram, block, files
    root/counts             gram, n
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import required_literal, term_grams
from ..session import spread
from . import codegrep as CG

#: Folders that the postings are dealt to.
BUCKETS = 64
#: A search intersects at most this many of its trigrams, the rarest.
LOOKUPS = 6
#: Pairs of a file and a trigram that are gathered before they are written.
PAIRS = 4_000_000

_POSTINGS = "gram int, block long, files array<int>"
_COUNTS = "gram int, n long, bucket int"


def _bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def _code(gram: str) -> int:
    """Three ASCII characters as 21 bits."""
    a, b, c = gram.encode("ascii")
    return a << 14 | b << 7 | c


def _codes(text: bytes) -> np.ndarray:
    """Distinct codes of the ASCII trigrams of a UTF-8 text."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    x = raw.astype(np.int64)
    code = x[:-2] << 14 | x[1:-1] << 7 | x[2:]
    plain = raw < 128
    if not plain.all():
        code = code[plain[:-2] & plain[1:-1] & plain[2:]]
    return np.unique(code)


def _grouped(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """A row for each block and trigram of some files."""
    sizes = [len(codes) for _, _, codes in found]
    blocks, at = np.unique(np.array([b for b, _, _ in found], np.int64), return_inverse=True)
    key = np.repeat(at.astype(np.int64) << 21, sizes) | np.concatenate([codes for _, _, codes in found])
    numbers = np.repeat(np.array([n for _, n, _ in found], np.int32), sizes)
    order = np.argsort(key, kind="stable")
    key, numbers = key[order], numbers[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    lists = pa.ListArray.from_arrays(np.append(starts, len(key)).astype(np.int32), pa.array(numbers, pa.int32()))
    first = key[starts]
    return pa.RecordBatch.from_arrays(
        [pa.array((first & (1 << 21) - 1).astype(np.int32)), pa.array(blocks[first >> 21]), lists], ["gram", "block", "files"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of ``block, file, low``; what is held at a time is bounded by
    ``PAIRS`` and the trigrams of one file (2^21 at most)."""
    found, held = [], 0
    for batch in batches:
        for block, number, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            codes = _codes(low.as_buffer()) if low.is_valid else np.empty(0, np.int64)
            if len(codes):
                found.append((block, number, codes))
                held += len(codes)
            if held >= PAIRS:
                yield _grouped(found)
                found, held = [], 0
    if found:
        yield _grouped(found)


def build(files: DataFrame, root: str) -> None:
    """Index ``files(repo, path, language, text, …)`` under the folder ``root``,
    which must not exist. Files of null or short text are kept and have no
    trigrams; very long ones are read whole. Columns named ``block`` or
    ``file`` are not allowed. A block is a partition of ``files``, so its size
    is that of a split of the scan."""
    clash = {"block", "file"} & set(files.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the index's own")
    spark = files.sparkSession
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = files.select("*", number.cast("int").alias("file"), F.spark_partition_id().cast("long").alias("block"))
    dealt.limit(0).write.parquet(f"{root}/schema")   # of tables without a row, too
    dealt.write.partitionBy("block").parquet(f"{root}/files")
    # numbers are read back, so that a task that ran twice can't give two
    stored = spread(_files(spark, root).select("block", "file", F.lower("text").alias("low")))
    rows = stored.mapInArrow(_postings, _POSTINGS).withColumn("bucket", _bucket(F.col("gram")))
    # a bucket of frequent trigrams is split by the rebalance; a row's list is short
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{root}/postings")
    written = spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{root}/postings")
    counts = written.groupBy("gram", "bucket").agg(F.sum(F.size("files")).alias("n")).select("gram", "n", "bucket")
    counts.write.parquet(f"{root}/counts")   # 2^21 narrow rows at most


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{root}/schema").schema).parquet(f"{root}/files")


def candidates(spark: SparkSession, root: str, literal: str) -> DataFrame | None:
    """``block, file`` of the files that may contain the text (in lower case);
    None if it has no trigram, so that all may. What reaches the driver is a
    count for each trigram of the parameter."""
    grams = [_code(g) for g in term_grams(literal, 3)]
    if not grams:
        return None
    counts = {r.gram: r.n for r in spark.read.schema(_COUNTS).parquet(f"{root}/counts").where(F.col("gram").isin(grams)).collect()}
    if len(counts) < len(grams):   # one of them is in no file
        return _files(spark, root).select("block", "file").limit(0)
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:LOOKUPS]
    rows = spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{root}/postings").where(
        F.col("bucket").isin(sorted({g % BUCKETS for g in rarest})) & F.col("gram").isin(rarest))
    held = rows.select("block", F.explode("files").alias("file")).groupBy("block", "file").agg(F.count("*").alias("n"))
    return held.where(F.col("n") == len(rarest)).select("block", "file")   # a file is once in a trigram's lists


def search(spark: SparkSession, root: str, term: str, regexp: bool = False, **options) -> DataFrame:
    """``codegrep.grep_code`` over the indexed files; ``options`` are its own
    (``lang``, ``limit``, ``include_archived``, ``include_forks``)."""
    files = _files(spark, root)
    found = candidates(spark, root, required_literal(term) if regexp else term.lower())
    if found is not None:
        files = files.join(found, ["block", "file"], "left_semi")
    return CG.grep_code(files, term, regexp=regexp, **options)
