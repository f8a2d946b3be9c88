"""Operator 13, periodic run detection by block convolution.

A run is a maximal stretch of words with smallest period q whose length is at
least max(MIN_LENGTH, MIN_REPEATS * q). A run of period q holds, at the scale
B = 2^k <= q < 2B, a block of B words that starts at a multiple of B and stands
again q words later. So at each dyadic scale every block is convolved with the
window that follows it: the sums of squared differences of word numbers at the
distances B to 2B - 1, by an exact integer number-theoretic transform. A zero
is an occurrence without mismatch, and its distance seeds an extension to both
sides.

What keeps this near linear, and drops nothing:

* a block is convolved only if each of its words stands again less than 2B
  words later, and if the window isn't inside one run that smaller scales have
  found: by Fine and Wilf's theorem all its seeds would repeat that run;
* seeds are extended by binary search over prefix hashes, so a seed costs
  log(n) steps however long its run; what is reported is compared word by word.

A zero modulo the prime that is no zero is discarded by the extension. Batches of
many documents are worked through as one array, a long document by itself; a task holds
one batch. Documents never meet each other, so there is no shuffle.

Defined results: a null or empty text has no words and no runs; repeated rows
and null ids are taken row by row; an empty table gives an empty one; further
columns are ignored. A very long text takes n log^2 n steps and memory in
proportion to it; up to 2^28 words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelake.llm.common import doc_texts

MIN_LENGTH, MIN_REPEATS = 6, 4

#: 15 * 2^27 + 1, with a primitive root: transforms of up to 2^27 numbers.
PRIME, ROOT, TWOS = 2013265921, 31, 27

#: Words worked through as one array, and numbers in one pass of transforms.
BATCH_WORDS, PASS_NUMBERS = 500_000, 1 << 20

#: Moduli and bases of the prefix hashes.
HASHES = ((2147483647, 1103515245), (2147483629, 1664525))

Words = list[bytes]


@dataclass(frozen=True)
class Runs:
    """Runs of a document by start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    """1, base, base^2, ... modulo the prime."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have:have + step] = out[:step] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += step
    return out[:n]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long)."""
    m, n = rows.shape
    p = np.uint64(PRIME)
    if n > 1 << TWOS:
        raise ValueError("a text has too many words")
    root = pow(ROOT, (PRIME - 1) // n, PRIME)
    twiddle = _powers(pow(root, PRIME - 2, PRIME) if inverse else root, max(n // 2, 1), PRIME)
    # Stockham's order: each pass halves the length and doubles the stride, and
    # no bits have to be reversed
    a, half, stride = rows, n // 2, 1
    while half:
        a = a.reshape(m, 2 * half, stride)
        top, low = a[:, :half], a[:, half:]
        out = np.empty((m, half, 2, stride), np.uint64)
        out[:, :, 0] = (top + low) % p
        out[:, :, 1] = (top + (p - low)) % p * twiddle[::stride][None, :half, None] % p
        a, half, stride = out, half // 2, stride * 2
    a = a.reshape(m, n)
    return a * np.uint64(pow(n, PRIME - 2, PRIME)) % p if inverse else a


def _padded(values: np.ndarray, at: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` values from ``at`` on; zeros from ``end`` on."""
    place = at[:, None] + np.arange(width)
    return np.where(place < end[:, None], values[np.minimum(place, len(values) - 1)], np.uint64(0))


class _Text:
    """Documents as one array of word numbers (from 1), with what the scales need."""

    def __init__(self, numbers: np.ndarray, ends: np.ndarray) -> None:
        n = len(numbers)
        self.numbers, self.ends = numbers, ends
        self.starts = np.concatenate(([0], ends[:-1]))
        self.doc = np.repeat(np.arange(len(ends)), ends - self.starts)
        self.squares = np.concatenate(([0], np.cumsum(numbers * numbers % np.uint64(PRIME)))).astype(np.uint64)
        order = np.argsort(numbers, kind="stable")
        again = (numbers[order[1:]] == numbers[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        #: words until the same one comes again in its document
        self.gap = np.full(n, np.iinfo(np.int64).max)
        self.gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
        self._hashes: list | None = None

    def hashes(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        if self._hashes is None:
            self._hashes = []
            for prime, base in HASHES:
                power = _powers(base, len(self.numbers) + 1, prime)
                terms = self.numbers * power[:-1] % np.uint64(prime)
                self._hashes.append((np.concatenate(([0], np.cumsum(terms))).astype(np.uint64), power, prime))
        return self._hashes

    def _same(self, at: np.ndarray, gap: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``at`` stand again ``gap`` later."""
        ok = np.ones(len(at), bool)
        for sums, power, prime in self.hashes():
            p = np.uint64(prime)
            here = (sums[at + size] - sums[at]) % p * power[gap] % p
            ok &= here == (sums[at + gap + size] - sums[at + gap]) % p
        return ok

    def _reach(self, at: np.ndarray, gap: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) repeat after ``gap``."""
        have = np.zeros(len(at), np.int64)
        step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step:
            more = np.minimum(have + step, most)
            ok = (more > have) & self._same(at - more if left else at, gap, more)
            have = np.where(ok, more, have)
            step //= 2
        return have

    def extend(self, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal stretches [start, end) with that period around the words at ``at``."""
        doc = self.doc[at]
        right = self._reach(at, gap, self.ends[doc] - gap - at, left=False)
        back = self._reach(at, gap, at - self.starts[doc], left=True)
        return at - back, at + right + gap


def _block_starts(text: _Text, size: int) -> np.ndarray:
    """Starts of the whole blocks of all documents that have room for a run."""
    count = np.where(text.ends - text.starts >= MIN_REPEATS * size, (text.ends - text.starts) // size, 0)
    first = np.repeat(text.starts, count)
    return first + size * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))


def _seeds(text: _Text, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks, and distances of size to 2 * size - 1, without mismatch."""
    p = np.uint64(PRIME)
    width, each = 2 * size, max(PASS_NUMBERS // (2 * size), 1)
    for k in range(0, len(at), each):
        b = at[k:k + each]
        end = text.ends[text.doc[b]]
        window = transform(_padded(text.numbers, b + size, end, width))
        block = np.zeros((len(b), width), np.uint64)
        place = np.arange(size)
        block[:, -place % width] = text.numbers[b[:, None] + place]
        products = transform(transform(block) * window % p, inverse=True)[:, :size]
        of = lambda a, z: text.squares[z] - text.squares[a]
        gap = size + place
        from_, to = np.minimum(b[:, None] + gap, end[:, None]), np.minimum(b[:, None] + gap + size, end[:, None])
        sums = (of(b, b + size)[:, None] + of(from_, to)) % p
        rows, found = np.nonzero(sums == 2 * products % p)
        yield b[rows], found + size


def _verified(text: _Text, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
    x = text.numbers
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        if not np.array_equal(x[s:e - q], x[s + q:e]):
            raise ArithmeticError("two different stretches of words have the same hashes")


def _found(text: _Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of all runs, by start, then period."""
    n = len(text.numbers)
    none = np.empty(0, np.int64)
    runs = [(none, none, none)]
    reach = np.zeros(n, np.int64)        # least end that a run from here or before has
    size = 1
    longest = int((text.ends - text.starts).max(initial=0))
    while MIN_REPEATS * size <= longest:
        at = _block_starts(text, size)
        # the maximum over the aligned blocks, document by document
        if len(at):
            edges = np.stack([at, np.minimum(at + size, n)], axis=1).ravel()
            worst = np.maximum.reduceat(np.append(text.gap, 0), edges)[::2]
            at = at[(worst < 2 * size) & (reach[at] < np.minimum(at + 3 * size - 1, text.ends[text.doc[at]]))]
        new = []
        for b, gap in _seeds(text, at, size):
            fresh = reach[b] < b + gap + size
            b, gap = b[fresh], gap[fresh]
            inside = b + gap + size <= text.ends[text.doc[b]]
            b, gap = b[inside], gap[inside]
            if not len(b):
                continue
            start, end = text.extend(b, gap)
            long = end - start >= np.maximum(MIN_LENGTH, MIN_REPEATS * gap)
            new.append(np.unique(np.stack([start[long], end[long], gap[long]], axis=1), axis=0))
        if new:
            s, e, q = np.unique(np.concatenate(new), axis=0).T
            # a stretch has its smallest period first; those of smaller scales are known
            first = np.ones(len(s), bool)
            first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
            old = np.concatenate([r[0] for r in runs]) * (n + 1) + np.concatenate([r[1] for r in runs])
            first &= ~np.isin(s * (n + 1) + e, old)
            s, e, q = s[first], e[first], q[first]
            _verified(text, s, e, q)
            runs.append((s, e, q))
            np.maximum.at(reach, s, e)
            reach = np.maximum.accumulate(reach)
        size *= 2
    start, end, period = (np.concatenate([r[k] for r in runs]) for k in range(3))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(docs: list[Words]) -> list[Runs]:
    """The runs of each document (a list of words)."""
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = lambda: len(index) + 1
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    numbers = np.empty(int(sizes.sum()), np.uint64)
    for d, end in zip(docs, ends.tolist()):
        numbers[end - len(d):end] = np.fromiter(map(index.__getitem__, d), np.uint64, len(d))
    if not len(numbers):
        return [Runs(*(np.empty(0, np.int64),) * 3) for _ in docs]
    text = _Text(numbers, ends)
    start, end, period = _found(text)
    cut = np.searchsorted(start, np.append(text.starts, len(numbers)))
    return [Runs(start[a:z] - first, (end - start)[a:z], period[a:z])
            for a, z, first in zip(cut[:-1].tolist(), cut[1:].tolist(), text.starts.tolist())]


def dropped(runs: Runs, n: int) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.start + runs.length, -1)
    return np.cumsum(edge[:-1]) > 0


def split_words(text: str | None) -> Words:
    """Words between blanks, tabs, and line, page and carriage breaks."""
    return (text or "").encode().split()


#: Maps (doc_id, words) to the words to search.
Prepare = Callable[[int | None, Words], Words]


def runs_of(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, runs (arrays of start, length
    and period, by start, then period) and the text without repeats: kept words
    joined by one blank."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("start", "length", "period")],
                           T.StructField("collapsed", T.StringType())])

    def rows(ids: list, texts: list[Words], kind: pa.DataType) -> pa.RecordBatch:
        found = find_runs(texts)
        kept = []
        for words, r in zip(texts, found):
            if len(r.start):
                words = [w for w, gone in zip(words, dropped(r, len(words)).tolist()) if not gone]
            kept.append(b" ".join(words))
        lists = ([getattr(r, c) for r in found] for c in ("start", "length", "period"))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()),
             *[pa.array(x, pa.list_(pa.int64())) for x in lists],
             pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        kind = pa.int64()
        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                doc_id = doc_id.as_py()
                words = split_words(text.as_py())
                words = prepare(doc_id, words) if prepare else words
                if texts and held + len(words) > BATCH_WORDS:
                    yield rows(ids, texts, kind)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
        if texts:
            yield rows(ids, texts, kind)

    return doc_texts(docs).mapInArrow(emit, schema)


def periodic_tail(doc_id: int | None, words: Words) -> Words:
    """The contract's change: a tenth of the documents get a repeating tail."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


_DIGEST = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")])


def op13(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    schema = T.StructType([docs.schema["doc_id"], *_DIGEST.fields])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in _DIGEST.fields]
            for s, length, q, text in zip(*(b.column(c).to_pylist() for c in ("start", "length", "period", "collapsed"))):
                top = min(zip([-x for x in length], s, q), default=None)
                best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
                lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, length, q))
                shas = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, text))
                for col, value in zip(out, (len(s), *best, *shas)):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:5]], *[pa.array(c, pa.string()) for c in out[5:]]],
                names=schema.names)

    return runs_of(docs, periodic_tail).mapInArrow(digest, schema)
