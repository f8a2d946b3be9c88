"""Operator 9, token-id files: an adaptive context-mixing range coder.

A file holds segments, one per row of a Parquet table (Spark's writer commits
whole files, so a lost executor leaves no half-written one). A segment codes
the ids of consecutive documents in blocks of BLOCK ids. Blocks are reset and
checksummed on their own: each can be read without the others.

The model of an id mixes three predictions. Order 2 and order 1 each name the
id that last followed the two ids, or the one id, before, with a confidence
that grows by hits and falls by misses. Adaptive weights, chosen by the two
confidences, tell "as order 2 says", "as order 1 says" and "neither"; then
order 0, the segment's own id frequencies, codes the id. All drive one range
coder of 62 bits with 32-bit output; carries are settled when a segment ends.

All blocks of a segment are coded in step, one id of each at a time, so the
work is array operations over up to SEGMENT blocks.

Layout of a segment, little-endian: header (magic, ids, ids a block, blocks,
distinct ids, checksum of the rest of the head); distinct ids and their
frequencies out of 2^16; per block its 32-bit words and the crc32 of its ids as
32-bit integers; the blocks' words.

Defined results: a null or empty text is its end id alone; rows that repeat an
id follow each other in order of their text, rows with a null id come first;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import doc_texts, scratch
from pagelake.llm.tokens import ID, default_path, encoder

BLOCK = 2048
SEGMENT = 4096

#: Units a worker remembers beside the coder's own arrays (about 100 MB).
CACHE_UNITS = 400_000

#: Bytes of text encoded at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 22

_MAGIC = b"TID2"
_HEAD = struct.Struct("<4sQIIII")
#: Size of the coder's state, and what an interval must keep for an id's two
#: steps (_BITS and 16 bits). A word put out leaves it larger than that, so a
#: block puts out one word an id at most.
_STATE, _WORD, _LEAST = 62, 32, 1 << 30
_SLOTS, _BITS = 1 << 16, 14
_KEPT, _SPARE = _STATE - _WORD, 2 * _WORD - _STATE
WORD = np.dtype("<u4")

#: Cells of the order-1 and order-2 tables of a block, as bits; the largest
#: confidence; by which share the weights follow what was seen (a power of two).
_CELLS = 11
_SURE = 7
_RATE = 5

#: By confidence * 2 + hit: how the confidence of an entry moves; _NEW: another takes its place.
_NEW = -_SURE - 1
_MOVES = np.array([[-(s + 1 >> 1) if s > 1 else _NEW, s < _SURE if s else _NEW] for s in range(_SURE + 1)], np.int32).ravel()

#: Where two weights end, in one number: "as order 2 says", 16 bits higher, and
#: "as order 2 or order 1 says", out of 2^_BITS. What each outcome adds keeps
#: the first above 0, the second above the first, and both below 2^_BITS.
_NONE = np.int32(1)
_ONE = np.int32((1 << _BITS >> _RATE) - 2)
_BOTH = np.int32(_ONE - 1 << 16 | _ONE)
_FALL = np.int32(((1 << _BITS >> _RATE) - 1) * 0x10001)
_CONTEXTS = 2 * (_SURE + 1) ** 2

#: Steps whose places and order-0 shares are looked up at once.
_STEPS = 32

_HASH2, _HASH1, _HASH3 = (np.uint32(k) for k in (0x85EBCA6B, 0x9E3779B1, 0xC2B2AE35))
_SHIFT = np.uint32(32 - _CELLS)


def _places(ids: np.ndarray, before: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cells of the order-2 and order-1 tables for the ids before (as uint32),
    along a new axis ahead of the last one."""
    at = np.empty((*ids.shape[:-1], 2, ids.shape[-1]), np.intp)
    np.add(ids * _HASH2 + before * _HASH3 >> _SHIFT, cells[0], out=at[..., 0, :])
    np.add(ids * _HASH1 >> _SHIFT, cells[1], out=at[..., 1, :])
    return at


def _first_weights() -> np.ndarray:
    """By context: confidences of order 2 and 1, and whether they say the same."""
    two, one, same = np.ogrid[:_SURE + 1, :_SURE + 1, :2]
    a = 1 + (1 << _BITS) * two // (two + 6 + one * (1 - same))
    b = 2 + (1 << _BITS) * (two + one) // (two + one + 6)
    return (a << 16 | np.maximum(a + 1, b)).astype(np.int32).ravel()


_START = _first_weights()


class _Model:
    """Predictions of ``n`` blocks in step; entries are id * 8 + confidence,
    those of order 2 before those of order 1."""

    def __init__(self, n: int):
        lane = np.arange(n)
        self.cells = np.stack([lane, lane + n]) << _CELLS
        self.contexts = lane * _CONTEXTS
        self.table = np.zeros(2 * n << _CELLS, np.int32)
        self.weights = np.tile(_START, n)

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the blocks whose cells are given: ids of orders 2 and 1, and
        where the weights of order 2 and of both end."""
        self.at, self.e = at, self.table.take(at)
        ids, self.sure = self.e >> 3, (self.e & _SURE) << 1
        two, one = self.sure
        self.ctx = self.contexts[:at.shape[1]] + (two << 3 | one | (ids[0] == ids[1]))
        self.w = self.weights.take(self.ctx)
        return ids, self.w >> 16, self.w & 0xFFFF

    def learn(self, x: np.ndarray, hit: np.ndarray, known: np.ndarray) -> None:
        """hit: the id is that of order 2, of order 1; known: of one of them."""
        w = self.w
        self.weights[self.ctx] = w - (w >> _RATE & _FALL) + np.where(known, np.where(hit[0], _BOTH, _ONE), _NONE)
        move = _MOVES.take(self.sure | hit)
        self.table[self.at] = np.where(move == _NEW, x << 3 | 1, self.e + move)


def _settled(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Blocks that put a word out, as their interval is too small to go on."""
    return (size < _LEAST).nonzero()[0]


class _Writer:
    def __init__(self, n: int):
        self.low, self.size = np.zeros(n, np.int64), np.full(n, (1 << _STATE) - 1, np.int64)
        self.lane = np.uint16 if n <= _SLOTS else np.int32  # the shorter one is sorted by digits
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def put(self, start: np.ndarray, share: np.ndarray, bits: int) -> None:
        """Narrow the intervals of the first blocks to shares of 2^bits."""
        low, size = self.low[:len(start)], self.size[:len(start)]
        size >>= bits
        low += size * start
        size *= share

    def settle(self, k: int) -> None:
        low, size = self.low[:k], self.size[:k]
        out = _settled(low, size)
        top = low.take(out)
        self.lanes.append(out.astype(self.lane))
        self.words.append(top >> _KEPT)
        low[out] = (top & (1 << _KEPT) - 1) << _WORD
        size[out] = size.take(out) << _WORD

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all blocks, block by block; number of words of each)."""
        every = np.arange(len(self.low), dtype=self.lane)
        for word in (self.low >> _KEPT, (self.low & (1 << _KEPT) - 1) << _SPARE):
            self.lanes.append(every)
            self.words.append(word)
        lanes = np.concatenate(self.lanes)
        words = np.concatenate(self.words)[np.argsort(lanes, kind="stable")]
        # what went beyond a word is carried to the one before; a block's first has none
        while (over := words >> _WORD).any():
            words &= (1 << _WORD) - 1
            words[:-1] += over[1:]
        return words.astype(WORD), np.bincount(lanes, minlength=len(every))


class _Reader:
    """``code`` is where the words stand above the interval's low end."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        wide = np.append(words.astype(np.int64), [0, 0])
        # the 32 bits from each word's last ones on: what a settled block reads next
        self.words, self.next = (wide[:-1] << _KEPT & (1 << _WORD) - 1) | wide[1:] >> _SPARE, first + 1
        self.code = wide[first] << _KEPT | wide[first + 1] >> _SPARE
        self.size = np.full(len(first), (1 << _STATE) - 1, np.int64)

    def settle(self, k: int) -> None:
        code, size = self.code[:k], self.size[:k]
        out = _settled(code, size)
        at = self.next.take(out)
        code[out] = code.take(out) << _WORD | self.words.take(at, mode="clip")
        size[out] = size.take(out) << _WORD
        self.next[out] = at + 1


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their shares of 2^16, none of them 0."""
    n = np.bincount(ids)
    distinct = np.flatnonzero(n)
    n = n[distinct]
    share = 1 + n * (_SLOTS - len(distinct)) // max(1, n.sum())
    if len(share):
        share[np.argmax(share)] += _SLOTS - share.sum()
    return distinct.astype(np.int64), share.astype(np.int64)


def _crcs(ids: np.ndarray, block: int) -> list[int]:
    wide = ids.astype("<u4")
    return [zlib.crc32(wide[k:k + block]) for k in range(0, len(ids), block)]


def compress(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of 16-bit ids."""
    n = -(-len(ids) // block)
    distinct, share = _frequencies(ids)
    shares, starts = np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int64)
    shares[distinct], starts[distinct] = share, np.cumsum(share) - share
    last = len(ids) - block * (n - 1) if n else 0
    grid = np.zeros((block + 2, n), ID)  # two ids 0 ahead
    grid[2:] = np.pad(ids, (0, n * block - len(ids))).reshape(n, block).T
    model, out = _Model(n), _Writer(n)
    for t in range(min(block, len(ids))):
        k, step = n - (t >= last), t % _STEPS
        if not step:
            some = grid[t:t + _STEPS + 2].astype(np.int32)
            at = _places(some[1:-1].view(np.uint32), some[:-2].view(np.uint32), model.cells)
            some = some[2:]
            start0, share0 = starts.take(some), shares.take(some)
        x = some[step, :k]
        said, a, b = model.predict(at[step, :, :k])
        hit = said == x
        known = hit[0] | hit[1]
        start = np.where(known, np.where(hit[0], 0, a), b)
        out.put(start, np.where(known, np.where(hit[0], a, b), 1 << _BITS) - start, _BITS)
        out.put(np.where(known, 0, start0[step, :k]), np.where(known, _SLOTS, share0[step, :k]), 16)
        out.settle(k)
        model.learn(x, hit, known)
    words, sizes = out.finish() if n else (np.empty(0, WORD), np.empty(0, np.int64))
    tables = (distinct.astype(ID).tobytes() + (share - 1).astype(ID).tobytes()
              + np.stack([sizes, _crcs(ids, block)], 1).astype("<u4").tobytes() if n else b"")
    return _HEAD.pack(_MAGIC, len(ids), block, n, len(distinct), zlib.crc32(tables)) + tables + words.tobytes()


def decompress(data: bytes, blocks: np.ndarray | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks (ascending numbers)."""
    magic, size, block, n, m, crc = _HEAD.unpack_from(data)
    head = _HEAD.size + 4 * m + 8 * n
    if magic != _MAGIC or zlib.crc32(data[_HEAD.size:head]) != crc:
        raise ValueError("not a token segment, or its head is damaged")
    distinct = np.frombuffer(data, ID, m, _HEAD.size).astype(np.int64)
    share = np.frombuffer(data, ID, m, _HEAD.size + 2 * m).astype(np.int64) + 1
    sizes, crcs = np.frombuffer(data, "<u4", 2 * n, _HEAD.size + 4 * m).reshape(n, 2).T.astype(np.int64)
    words = np.frombuffer(data, WORD, offset=head)
    starts = np.cumsum(share) - share
    slot = np.repeat(np.arange(m), share)
    lengths = np.full(n, block)
    if n:
        lengths[-1] = size - block * (n - 1)
    first = np.cumsum(sizes) - sizes
    chosen = np.arange(n) if blocks is None else np.asarray(blocks)
    lengths, first, crcs, n = lengths[chosen], first[chosen], crcs[chosen], len(chosen)
    if not n:
        return np.empty(0, ID)
    if len(words) != sizes.sum():
        raise ValueError("a token segment is cut short")
    grid = np.zeros((block, n), ID)
    x = before = np.zeros(n, np.int32)
    # one more entry for ids told by order 2 or 1: all of the interval
    starts, share, distinct = np.append(starts, 0), np.append(share, _SLOTS), np.append(distinct, 0).astype(np.int32)
    model, read = _Model(n), _Reader(words, first)
    for t in range(lengths.max()):
        k = n - (t >= lengths[-1])
        said, a, b = model.predict(_places(x[:k].view(np.uint32), before[:k].view(np.uint32), model.cells[:, :k]))
        code, size = read.code[:k], read.size[:k]
        size >>= _BITS
        a, b = size * a, size * b
        hit2, known = code < a, code < b
        start = np.where(known, np.where(hit2, 0, a), b)
        code -= start
        size <<= _BITS
        size[:] = np.where(known, np.where(hit2, a, b), size) - start >> 16
        at = np.where(known, m, slot.take(code // size, mode="clip"))
        code -= size * starts.take(at)
        size *= share.take(at)
        before, x = x, np.where(known, np.where(hit2, said[0], said[1]), distinct.take(at))
        read.settle(k)
        grid[t, :k] = x
        model.learn(x, said == x, known)
    out = np.ascontiguousarray(grid.T)
    for k in range(n):
        if zlib.crc32(out[k, :lengths[k]].astype("<u4")) != crcs[k]:
            raise ValueError(f"block {chosen[k]} of a token segment is damaged")
    return out.ravel()[:lengths.sum()]


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents in ascending id over the partitions. The hash of the text
    takes part in the order so that one id, or none, can't fill a partition."""
    keyed = doc_texts(docs).withColumn("h", F.xxhash64("text"))
    return keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows that are encoded at once, with about CHUNK_BYTES of text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2,
              segment_ids: int = BLOCK * SEGMENT) -> None:
    """Encode the texts and write their ids to ``path`` in order of doc_id."""
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("before", T.LongType()),
                           T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())),
                           T.StructField("segment", T.BinaryType())])
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, run, before = encoder(tokenizer, "byte", CACHE_UNITS), TaskContext.get().partitionId(), 0
        doc_ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [pa.array([run], pa.int32()), pa.array([before], pa.int64()), one(pa.concat_arrays(doc_ids)),
                 one(pa.array(np.concatenate(counts), pa.int64())),
                 pa.array([compress(np.concatenate(parts))], pa.binary())], names=schema.names)

        for b in batches:
            for some in _chunks(b):
                ids, n = enc.batch(some.column("text"))
                doc_ids.append(some.column("doc_id"))
                counts.append(n + 1)
                parts.append(np.insert(ids, np.cumsum(n), end_id))
                size += len(parts[-1])
                if size >= segment_ids:
                    yield segment()
                    before += size
                    doc_ids, counts, parts, size = [], [], [], 0
        if parts:
            yield segment()

    _ordered(docs).mapInArrow(encode, schema).write.option("compression", "none").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """The documents of a file: doc_id, start (ids before it) and ids (16-bit)."""
    files = spark.read.parquet(path)
    totals = files.groupBy("run").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                ids = decompress(row.column("segment")[0].as_py())
                lengths = row.column("lengths").flatten().to_numpy()
                cut = np.cumsum(lengths) - lengths
                start = row.column("offset")[0].as_py() + row.column("before")[0].as_py() + cut
                parts = [ids[c:c + n].tobytes() for c, n in zip(cut, lengths)]
                whole = pa.RecordBatch.from_arrays(
                    [row.column("doc_ids").flatten(), pa.array(start, pa.int64()), pa.array(parts, pa.binary())], names=schema.names)
                for at in range(0, whole.num_rows, 1000):
                    yield whole.slice(at, 1000)

    return files.join(offsets, "run").select("offset", "before", "doc_ids", "lengths", "segment").mapInArrow(decode, schema)


def op9(docs: DataFrame) -> DataFrame:
    """Write the file, read it back, and check sums of what was read."""
    path = scratch(docs.sparkSession)
    write_ids(docs, path)
    back = read_ids(docs.sparkSession, path)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x.as_py(), ID) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), pa.array(map(len, ids), pa.int64()),
                 pa.array([zlib.crc32(i.astype("<u4")) for i in ids], pa.int64())], names=schema.names)

    return back.mapInArrow(digest, schema)
