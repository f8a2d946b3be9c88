"""Operator 6, best-fit packing: vector best fit.

Documents become pieces of at most ``tokens`` ids; a sequence (bin) has three
capacities: tokens, documents, and attention cost (sum of squared lengths).
Pieces are taken from the largest down. Each goes to the bin, among those
with room under every constraint, with the smallest weighted norm of what
would be left (``norm``) or the largest weighted dot product of piece and room
(``dot``); if none has room, to a new one. A constraint weighs as much as the
pieces of the group ask of it on average; one that cannot bind before the
tokens do weighs nothing.

Full pieces are sequences by themselves. The others are dealt at random into
groups of about GROUP_SEQUENCES sequences' worth of tokens and at most about
GROUP_PIECES pieces, packed apart: a task's memory is bounded by these. The
sequences a group leaves under FULL of every capacity that binds are opened
again, and their pieces of all groups are dealt into fewer groups, and so on
until one group is left, or until most sequences stay open because their pieces
fit no better in any group. Groups are dealt over written tables of numbered
pieces, so a lost executor changes nothing.

Defined results: a null or empty text is one piece that holds the end id
alone; repeated rows and null ids are packed row by row; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import doc_texts, written
from pagelake.llm.tokens import ID, default_path, encoder

GROUP_SEQUENCES, GROUP_PIECES = 1024, 1 << 16

#: A sequence filled to this share is not opened again; another round is worth
#: its shuffle while it takes at most SHRINK as many groups.
FULL, SHRINK = 0.98, 0.8


@dataclass(frozen=True)
class Limits:
    """What one sequence holds. ``attention`` 0: the square of ``tokens``."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 0

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention or self.tokens**2], np.float64)

    def binding(self) -> np.ndarray:
        return np.array([True, self.documents < self.tokens, 0 < self.attention < self.tokens**2])


def pieces(docs: DataFrame, limits: Limits = Limits(), path: str | None = None, end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked
    for, its ids as little-endian unsigned 32-bit integers."""
    path = path or default_path("word_bpe_49k.json")
    size = limits.tokens
    if limits.attention:
        size = min(size, math.isqrt(limits.attention))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t()) for n, t in (
        ("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids_crc32", T.LongType)))])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "word")
        for b in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(enc.encode(b.column("text").to_pylist())):
                whole = np.append(np.frombuffer(raw, ID), ID.type(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(whole), size)):
                    part = whole[at:at + size]
                    data = part.tobytes()
                    rows.append(k), piece.append(p), start.append(at), length.append(len(part))
                    crc.append(zlib.crc32(data))
                    if with_ids:
                        ids.append(data)
            out = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                   *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names=schema.names)

    return doc_texts(docs).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, limits: Limits = Limits(), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length."""
    cap = limits.vector()
    item = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64)**2], 1) / cap
    if (item > 1 + 1e-12).any():
        raise ValueError("a piece is larger than a sequence")
    weight = np.where(limits.binding(), item.mean(0) if len(item) else 1.0, 0.0)
    order = np.lexsort((np.arange(len(lengths)), -(item * weight).sum(1)))
    whole = np.stack([lengths, np.ones(len(lengths), np.int64), lengths * lengths], 1).astype(np.int64)
    room = np.empty((max(1, len(lengths)), 3), np.int64)
    top = cap.astype(np.int64)
    open_bins = np.empty(0, np.int64)
    used, place, offset = 0, np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        left = room[open_bins] - whole[i]
        fits = np.flatnonzero((left >= 0).all(1))
        if len(fits):
            if rule == "norm":
                score = (left[fits] / cap) ** 2 @ weight
            else:
                score = -((room[open_bins[fits]] / cap) * item[i] @ weight)
            at = fits[np.argmin(score)]
            b = open_bins[at]
        else:
            b, at = used, len(open_bins)
            room[b] = top
            open_bins = np.append(open_bins, b)
            used += 1
        place[i], offset[i] = b, limits.tokens - room[b, 0]
        room[b] -= whole[i]
        if (room[b] <= 0).any():
            open_bins = np.delete(open_bins, at)
    return place, offset


def _open(lengths: np.ndarray, place: np.ndarray, limits: Limits) -> np.ndarray:
    """Of each piece, whether its bin is under FULL of all that can bind."""
    parts = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64)**2], 1) / limits.vector()
    filled = np.zeros((int(place.max(initial=-1)) + 1, 3))
    np.add.at(filled, place, parts)
    return (filled[:, limits.binding()].max(1) < FULL)[place]


def pack(cut: DataFrame, limits: Limits = Limits(), rule: str = "norm", group_pieces: int = GROUP_PIECES,
         group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    table = written(cut.withColumn("_n", F.monotonically_increasing_id()))
    full = F.col("length") == limits.tokens
    out = table.where(full).select(
        *cut.columns, (-1 - F.col("_n")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("_open", T.BooleanType())])

    def needed(rows: DataFrame) -> int:
        n, tokens = rows.agg(F.count(F.lit(1)), F.sum("length")).first()
        return max(-(-n // group_pieces), -(-(tokens or 0) // (group_sequences * limits.tokens)))

    def fitted(rows: DataFrame, groups: int, base: int) -> DataFrame:
        def fit(key: tuple, rows: pa.Table) -> pa.Table:
            lengths = rows.column("length").to_numpy()
            place, offset = best_fit(lengths, limits, rule)
            return (rows.drop_columns(["_g"])
                    .append_column("sequence_id", pa.array(((base + int(key[0].as_py())) << 32) + place, pa.int64()))
                    .append_column("offset", pa.array(offset, pa.int64()))
                    .append_column("_open", pa.array(_open(lengths, place, limits))))

        dealt = rows.withColumn("_g", F.pmod(F.xxhash64("_n", F.lit(base)), F.lit(groups)))
        return written(dealt.groupBy("_g").applyInArrow(fit, schema))

    rest, base = table.where(~full), 0
    groups = max(1, needed(rest))
    while True:
        placed = fitted(rest, groups, base)
        fewer = needed(placed.where("_open")) if groups > 1 else 0
        last = not 0 < fewer <= max(SHRINK * groups, 1)
        out = out.unionByName((placed if last else placed.where("NOT _open")).select(*out.columns))
        if last:
            return out
        rest, base, groups = placed.where("_open").select(*table.columns), base + groups, fewer


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids of each (pieces made ``with_ids``), in
    order of offset. A sequence is bounded by its capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("length"))
            .select("sequence_id", "length", F.aggregate(
                "p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))


def op6(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
