"""Count sketches of fixed size: sums of cell counts over all partitions.

The driver and the tasks get CELLS numbers whatever the input's size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Cells are the top bits of a 64-bit hash.
CELL_BITS = 20
CELLS = 1 << CELL_BITS
_CHUNK = CELLS >> 4
_SALTS = 16
SCHEMA = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("salt", T.IntegerType()),
                       T.StructField("data", T.BinaryType())])


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes.astype(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _rows(chunks: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (chunk, salt), counts in chunks.items():
        data = pa.compress(counts.astype("<u8").tobytes(), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())],
                                         names=["chunk", "salt", "data"])


def counted(hashes: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One partition's cell counts, as rows of SCHEMA."""
    counts = np.zeros(CELLS, np.int64)
    held, n = [], 0
    for h in hashes:
        held.append(h)
        n += len(h)
        if n >= CELLS:
            counts += np.bincount(cell(np.concatenate(held)), minlength=CELLS)
            held, n = [], 0
    if held:
        counts += np.bincount(cell(np.concatenate(held)), minlength=CELLS)
    salt = TaskContext.get().partitionId() % _SALTS
    parts = {(k, salt): counts[k * _CHUNK:(k + 1) * _CHUNK] for k in range(CELLS // _CHUNK)}
    yield from _rows({k: v for k, v in parts.items() if v.any()})


def total(parts: DataFrame) -> np.ndarray:
    """Sum over all partitions, in two steps so that no task reads them all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for chunk, salt, data in zip(*(c.to_pylist() for c in b.columns)):
                counts = np.frombuffer(pa.decompress(data, 8 * _CHUNK, codec="zstd", asbytes=True), "<u8")
                key = (chunk, salt)
                sums[key] = sums[key] + counts if key in sums else counts
        yield from _rows(sums)

    salted = parts.repartition("chunk", "salt").mapInArrow(add, SCHEMA)
    out = np.zeros(CELLS, np.uint64)
    for r in salted.collect():  # at most 16 chunks of 16 salts
        out[r.chunk * _CHUNK:(r.chunk + 1) * _CHUNK] += np.frombuffer(
            pa.decompress(bytes(r.data), 8 * _CHUNK, codec="zstd", asbytes=True), "<u8")
    return out
