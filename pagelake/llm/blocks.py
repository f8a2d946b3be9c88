"""Texts as blocks of word places: what operators 5 and 8 join words with.

A block is a stretch of one input partition (about BLOCK_CHARS characters).
``block_words`` has one row per distinct word of a block, with its place in
the block's word list (commonest first); ``block_texts`` has one row per block
with, for each document, the places of its words in order. A per-word result
joins back to the texts by (block, place): the rows shuffled are the distinct
words of blocks, not the words of the corpus, and even the commonest word has
one row a block. ``at`` holds block and place in one number, as narrow rows
are what the shuffle's size hangs on.

Both read the documents by themselves, which is cheaper than writing word
places. They must see the same rows in the same partitions, also when a task is
run again, so ``docs`` has to go through ``stable`` first: anything but a scan
of files could come in another order from behind a shuffle. ``restore`` also
raises if a block's words and texts differ in number; it can't see texts that
changed in place and kept their number of words.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import doc_texts, written

BLOCK_CHARS = 32_000_000

#: Bits of ``at``: the place, the block's number in its partition; the
#: partition has the rest.
PLACE_BITS, NUMBER_BITS = 27, 14

def stable(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` as every task reads them again: ``docs`` where it is
    a scan of files with projections and filters, a written copy otherwise."""
    texts = doc_texts(docs)
    nodes = [texts._jdf.queryExecution().optimizedPlan()]
    if not nodes[0].deterministic():
        return written(texts)
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation") or "Relation [" not in node.toString():
            return written(texts)
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return texts


#: Splits a text into words; the words are bytes.
Split = Callable[[str], list[bytes]]


class _Block:
    def __init__(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.texts: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.chars = 0

    def add(self, words: list[bytes]) -> None:
        self.texts.append(np.fromiter(map(self.index.__getitem__, words), np.uint32, len(words)))

    def order(self) -> np.ndarray:
        """The words, commonest first; ties by checksum, so that the order of
        the documents doesn't matter."""
        times = np.bincount(np.concatenate(self.texts), minlength=len(self.index))
        return np.lexsort((np.fromiter(map(zlib.crc32, self.index), np.uint32, len(self.index)), -times))


def _blocks(batches: Iterator[pa.RecordBatch], split: Split, chars: int) -> Iterator[tuple[int, _Block]]:
    """(key, block); the key is the partition and a number in it."""
    first, n, block = TaskContext.get().partitionId() << NUMBER_BITS, 0, _Block()
    for b in batches:
        ids, start = b.column("doc_id"), 0
        for k, text in enumerate(b.column("text")):
            text = text.as_py() or ""
            block.add(split(text))
            block.chars += len(text) + 1
            if block.chars >= chars:
                block.ids.append(ids[start:k + 1])
                yield first + n, block
                start, n, block = k + 1, n + 1, _Block()
                if n >> NUMBER_BITS:
                    raise ValueError("a partition has too many blocks: use more partitions")
        if start < b.num_rows:
            block.ids.append(ids[start:])
    if block.texts:
        yield first + n, block


def block_words(docs: DataFrame, split: Split, counted: Callable[[pa.Array], np.ndarray] | None = None,
                chars: int = BLOCK_CHARS, about: Callable[[list[bytes], list[np.ndarray]], pa.Array] | None = None) -> DataFrame:
    """at, word and, with ``counted`` (ids to a mask of documents), n: how
    often the word stands in those documents; then, with ``about``, a binary
    of each word from the block's words and the places in those documents."""
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("word", T.BinaryType())])
    if counted:
        schema = schema.add("n", T.LongType())
    if about:
        schema = schema.add("about", T.BinaryType())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _blocks(batches, split, chars):
            order = block.order()
            words = list(map(list(block.index).__getitem__, order.tolist()))
            n = len(words)
            if n >> PLACE_BITS:
                raise ValueError("a text has too many distinct words")
            cols = [pa.array((key << PLACE_BITS) + np.arange(n), pa.int64()),
                    pa.array(words, pa.binary())]
            if counted:
                mask = np.concatenate([counted(i) for i in block.ids])
                chosen = [t for t, m in zip(block.texts, mask) if m]
                times = np.bincount(np.concatenate(chosen), minlength=n) if chosen else np.zeros(n, np.int64)
                cols.append(pa.array(times[order], pa.int64()))
                if about:
                    place = np.empty(n, np.uint32)
                    place[order] = np.arange(n, dtype=np.uint32)
                    cols.append(about(words, [place[t] for t in chosen]))
            whole = pa.RecordBatch.from_arrays(cols, names=schema.names)
            for at in range(0, n, 50_000):
                yield whole.slice(at, 50_000)

    return doc_texts(docs).mapInArrow(emit, schema)


#: Places below ONE take a byte, the next TWO * 256 two, the others five.
_ONE, _TWO = 200, 55


def _packed(places: np.ndarray) -> bytes:
    one = places < _ONE
    two = ~one & (places < _ONE + _TWO * 256)
    rest = places[~one & ~two] - np.uint32(_ONE + _TWO * 256)
    pair = places[two] - np.uint32(_ONE)
    lead = np.where(one, places, 255).astype("u1")
    lead[two] = _ONE + (pair >> 8)
    planes = rest.astype("<u4").view("u1").reshape(-1, 4).T
    return pa.compress(lead.tobytes() + (pair & 255).astype("u1").tobytes() + planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), "u1")
    lead = raw[:n]
    out = lead.astype(np.uint32)
    two, rest = (lead >= _ONE) & (lead < 255), lead == 255
    k = int(two.sum())
    out[two] = _ONE + ((out[two] - _ONE) << 8) + raw[n:n + k]
    planes = np.ascontiguousarray(raw[n + k:].reshape(4, -1).T)
    out[rest] = planes.view("<u4").ravel() + np.uint32(_ONE + _TWO * 256)
    return out


def _packed_size(places: np.ndarray) -> int:
    return len(places) + int(((places >= _ONE) & (places < _ONE + _TWO * 256)).sum()) + 4 * int((places >= _ONE + _TWO * 256).sum())


def block_texts(docs: DataFrame, split: Split, chars: int = BLOCK_CHARS) -> DataFrame:
    """block, ids of the documents, their word counts, the number of distinct
    words, and the packed places with their unpacked size."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
                           T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("words", T.LongType()),
                           T.StructField("size", T.LongType()), T.StructField("places", T.BinaryType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _blocks(batches, split, chars):
            place = np.empty(len(block.index), np.uint32)
            place[block.order()] = np.arange(len(place), dtype=np.uint32)
            places = place[np.concatenate(block.texts)]
            ids = pa.concat_arrays(block.ids)
            lengths = pa.array([len(t) for t in block.texts], pa.int64())
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), one(ids), one(lengths), pa.array([len(place)], pa.int64()),
                 pa.array([_packed_size(places)], pa.int64()), pa.array([_packed(places)], pa.binary())], names=schema.names)

    return doc_texts(docs).mapInArrow(emit, schema)


#: Rows that ``bundled`` brings together before it sorts them by block.
BUNDLE_ROWS = 300_000
BUNDLE = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.LongType()),
                       T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())])


def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (at, ids) as a few compressed rows per block (BUNDLE), since
    a shuffled row costs more than the few bytes of a word's ids."""
    held: list[pa.RecordBatch] = []

    def bundle() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("at")
        at, ids = rows.column("at").to_numpy(), pa.concat_arrays(rows.column("ids").chunks)
        size = pc.binary_length(ids).to_numpy().astype("<u4")
        starts = np.flatnonzero(np.diff(at >> PLACE_BITS, prepend=-1))
        out: list[list] = [[], [], [], []]
        for a, b in zip(starts, np.append(starts[1:], len(at))):
            step = np.diff(at[a:b] & ((1 << PLACE_BITS) - 1), prepend=0).astype("<u4")
            raw = step.tobytes() + size[a:b].tobytes() + b"".join(ids[a:b].to_pylist())
            for col, x in zip(out, (int(at[a]) >> PLACE_BITS, b - a, len(raw), pa.compress(raw, codec="zstd", asbytes=True))):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                          names=BUNDLE.names)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BUNDLE_ROWS:
            yield bundle()
            held = []
    if sum(x.num_rows for x in held):
        yield bundle()


def _unbundled(rows: pa.Table) -> pa.Table:
    at, ids = [np.empty(0, np.int64)], []
    for block, n, size, data in zip(*(rows.column(c).to_pylist() for c in BUNDLE.names)):
        raw = pa.decompress(data, size, codec="zstd", asbytes=True)
        step, length = np.frombuffer(raw, "<u4", 2 * n).reshape(2, n).astype(np.int64)
        at.append((block << PLACE_BITS) + np.cumsum(step))
        ends = 8 * n + np.cumsum(length)
        ids += [raw[a:b] for a, b in zip((ends - length).tolist(), ends.tolist())]
    return pa.table({"at": np.concatenate(at), "ids": pa.array(ids, pa.binary())})


#: Gets (rows of the block's words in order of place, ids, word counts, places).
Use = Callable[[pa.Table, pa.Array, np.ndarray, np.ndarray], pa.Table]


def _block_of(at: str) -> Column:
    return F.shiftright(at, PLACE_BITS).alias("block")


def restore(words: DataFrame, texts: DataFrame, use: Use, schema: T.StructType) -> DataFrame:
    """``use`` on every block, with its words' rows and its texts together.
    ``words`` has rows with ``at``, or what ``bundled`` made of them."""
    bundles = "block" in words.columns

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _unbundled(left) if bundles else left
        n = left.num_rows
        if right.num_rows == 1 and right.column("words")[0].as_py() == n:
            ids, lengths = (right.column(c).chunk(0).flatten() for c in ("ids", "lengths"))
            lengths = lengths.to_numpy()
            places = _unpacked(right.column("places")[0].as_py(), right.column("size")[0].as_py(), int(lengths.sum()))
            left = left.sort_by("at")
            if not n or (left.column("at")[n - 1].as_py() & ((1 << PLACE_BITS) - 1)) == n - 1:
                return use(left, ids, lengths, places)
        raise RuntimeError("the documents changed between two reads; write them to a table first")

    return words.groupBy("block" if bundles else _block_of("at")).cogroup(texts.groupBy("block")).applyInArrow(joined, schema)
