"""Operator 5, BPE encoding and decoding: a distinct-word table.

Spark splits the texts into words, the distinct words are encoded once each
(``word_table``: sorted by word, a run of equal words is encoded at its head),
and the ids go back to the texts by position (``blocks``). Words are the
stretches between blanks, whose ids don't depend on their neighbours for this
kind of file; special strings inside them are the library's business.

Decoding looks every id up in the id-to-piece table. That table is bounded by
the vocabulary (49,408 rows) and goes to every task; its join is by position.

Defined results: a null or empty text has no ids and decodes to nothing;
repeated rows and null ids are encoded row by row; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelake.llm.blocks import BUNDLE, block_texts, block_words, bundled, restore, stable
from pagelake.llm.tokens import ID, default_path, encoder, loaded

_BLANKS = bytes.maketrans(b"\n\t\r", b"   ")

#: Words whose ids are gathered at once.
CHUNK = 500_000

#: Gets ids of documents and their token ids; returns rows of the result.
Finish = Callable[[pa.Array, list[np.ndarray]], pa.Table]


def split(text: str) -> list[bytes]:
    """``word_units`` on bytes, which split faster; blanks are ASCII."""
    return text.encode().translate(_BLANKS).split(b" ")


def word_table(words: DataFrame, path: str, bundle: bool = False) -> DataFrame:
    """``at`` and ``ids`` (two little-endian bytes each) of rows of ``at`` and
    ``word``; each distinct word is encoded once. ``bundle``: in bundles."""
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "word")
        last: dict[bytes, bytes] = {}
        for b in batches:
            coded = b.column("word").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = [w for w in distinct if w not in last]
            done = last | {w: enc.unit(w.decode()) for w in new}
            yield pa.RecordBatch.from_arrays(
                [b.column("at"), pa.array([done[w] for w in distinct], pa.binary()).take(coded.indices)], names=schema.names)
            last = {w: done[w] for w in distinct[-1:]}

    by_word = words.repartition("word").sortWithinPartitions("word")
    if bundle:
        return by_word.mapInArrow(lambda batches: bundled(encode(batches)), BUNDLE)
    return by_word.mapInArrow(encode, schema)


def _restored(docs: DataFrame, path: str, finish: Finish, schema: T.StructType) -> DataFrame:
    docs = stable(docs)

    def gather(rows: pa.Table, doc_ids: pa.Array, lengths: np.ndarray, places: np.ndarray) -> pa.Table:
        column = pa.concat_arrays(rows.column("ids").chunks) if rows.num_rows else pa.array([], pa.binary())
        size = pc.binary_length(column).to_numpy().astype(np.int64) // ID.itemsize
        data = np.frombuffer(b"".join(column.to_pylist()), ID)
        start, ends = np.cumsum(size) - size, np.cumsum(lengths)
        out, k = [], 0
        while k < len(lengths):
            base = ends[k] - lengths[k]
            stop = max(k + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            at = places[base:ends[stop - 1]]
            n = size[at]
            found = data[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            cut = np.concatenate([[0], np.cumsum(n)])[ends[k:stop] - base]
            out.append(finish(doc_ids[k:stop], np.split(found, cut[:-1])))
            k = stop
        return pa.concat_tables(out)

    words = word_table(block_words(docs, split), path, bundle=True)
    return restore(words, block_texts(docs, split), gather, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (two little-endian bytes each) of every text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    return _restored(docs, path or default_path("word_bpe_49k.json"), lambda doc_ids, ids: pa.table(
        {"doc_id": doc_ids, "ids": pa.array([i.tobytes() for i in ids], pa.binary())}), schema)


def pieces(path: str) -> np.ndarray:
    """The id-to-piece table: place i holds the piece of id i."""
    tok = loaded(path)
    n = max(tok.get_vocab(with_added_tokens=True).values()) + 1
    return np.array([tok.id_to_token(i) or "" for i in range(n)], object)


def joined(ids: np.ndarray, piece: np.ndarray) -> str:
    """Pieces of ids, joined by blanks as a file without a decoder has it."""
    return " ".join(piece[ids].tolist())


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``."""
    path = path or default_path("word_bpe_49k.json")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [joined(np.frombuffer(x.as_py() or b"", ID), piece) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(join, schema)


def op5(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the text decoded from them, made where the ids
    are put together."""
    path = default_path("word_bpe_49k.json")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    tables: dict[str, np.ndarray] = {}

    def digest(doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.Table:
        if not tables:
            tables["piece"] = pieces(path)
            tables["number"] = np.array([str(i) for i in range(len(tables["piece"]))], object)
        sha = lambda i, table: hashlib.sha256(joined(i, tables[table]).encode()).hexdigest()
        return pa.table({"doc_id": doc_ids, "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                         "ids_sha256": pa.array([sha(i, "number") for i in ids], pa.string()),
                         "decoded_sha256": pa.array([sha(i, "piece") for i in ids], pa.string())})

    return _restored(docs, path, digest, schema)
