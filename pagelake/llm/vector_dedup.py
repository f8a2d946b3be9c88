"""Operator 4, embedding near-dedup: cross-polytope hashing after fast
Hadamard rotations, multiprobe buckets, verified pairs.

Vectors with equal components form one class, hashed and compared once. In
each of ``tables`` tables a class falls into the bucket named by ``hashes``
cross-polytope hashes (the nearest of the 2 D signed axes after three rounds of
random signs and a Hadamard transform), and into the ``probes`` - 1 buckets
next best. Two classes that share a bucket are compared by their cosine in
double precision; only verified pairs link. A pair that meets in several
buckets counts in the first of them.

A bucket is compared in blocks of at most ``block`` classes, one task for each
two blocks, so no task holds an unbounded bucket. Tasks return a number of
links per class and a spanning forest of what they linked, never pairs, so the
rows stay in proportion to the classes in buckets even for large groups.

``Settings.for_size`` sets hashes and tables from the number of classes: the
expected bucket stays bounded and the chance to miss a pair at the threshold
stays the same at every size.

Defined results: a vector that is null, zero, or holds null or non-finite
components links with nothing and is its own component; vectors of different
lengths don't link; rows that repeat an id are separate vectors, rows with a
null id count as vectors but have a null component where nothing else does;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import written
from pagelake.llm.components import components, forest

#: Measured chance that two vectors at cosine 0.95 share a bucket of a table, to
#: the power 1 / hashes: 0.89 at 64 dimensions and 0.83 at 384 with two hashes,
#: 0.85 and 0.77 with three.
SHARE = 0.78
MISS = 1e-5


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    hashes: int = 2
    tables: int = 13
    probes: int = 3
    block: int = 1024
    seed: int = 20240

    @staticmethod
    def for_size(classes: int, dimension: int, threshold: float = 0.95) -> Settings:
        axes = 2 * _power(dimension)
        hashes = max(1, math.ceil(math.log(max(classes, 2) / 64) / math.log(axes)))
        tables = math.ceil(math.log(MISS) / math.log(1 - SHARE**hashes))
        return Settings(threshold, hashes, tables)


def _power(n: int) -> int:
    return 1 << max(1, (n - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, whose length is a power of 2."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def bucket_keys(x: np.ndarray, s: Settings) -> np.ndarray:
    """Keys of unit rows: an array of (rows, tables, probes). The table is part
    of a key. ``probes`` buckets are the combinations of each hash's two best
    axes that lose least."""
    n, dim = x.shape
    d = _power(dim)
    if not n:
        return np.empty((0, s.tables, s.probes), np.int64)
    rng = np.random.default_rng(s.seed + dim)
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    choices = np.array(list(itertools.product((0, 1), repeat=s.hashes)))
    out = np.empty((n, s.tables, min(s.probes, len(choices))), np.int64)
    for t in range(s.tables):
        axes, loss = np.empty((n, s.hashes, 2), np.int64), np.zeros((n, s.hashes, 2))
        for h in range(s.hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            best = np.argpartition(-size, 1, axis=1)[:, :2] if d > 2 else np.argsort(-size, axis=1)[:, :2]
            value = np.take_along_axis(size, best, 1)
            swap = value[:, 0] < value[:, 1]
            best[swap], value[swap] = best[swap, ::-1], value[swap, ::-1]
            axes[:, h] = 2 * best + (np.take_along_axis(y, best, 1) < 0)
            loss[:, h, 1] = (value[:, 0] - value[:, 1]) ** 2
        lost = sum(loss[:, h, choices[:, h]] for h in range(s.hashes))
        order = np.argsort(lost, axis=1, kind="stable")[:, :out.shape[2]]
        key = np.full((n, len(choices)), t, np.uint64)
        for h in range(s.hashes):
            key = key * np.uint64(0x9E3779B97F4A7C15) + axes[:, h][:, choices[:, h]].astype(np.uint64)
            key ^= key >> np.uint64(31)
        key = (key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(9) | np.uint64(t) << np.uint64(55)
        out[:, t] = np.take_along_axis(key, order, 1).astype(np.int64)
    return out


def _unit(lists: pa.Array) -> np.ndarray:
    """Unit vectors of valid vectors of one length."""
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    x = flat / np.abs(flat).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _classes(vectors: DataFrame, column: str) -> DataFrame:
    """One row per different valid vector: class, size, members' least id."""
    v = F.col(column)
    whole = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    found = vectors.where(v.isNotNull() & whole).groupBy(v.alias("embedding")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    return written(found.withColumn("class", F.monotonically_increasing_id()))


def _buckets(classes: DataFrame, s: Settings) -> DataFrame:
    """bucket, class: rows of buckets that two classes or more share."""

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, ids = b.column("embedding"), b.column("class")
            for dim in np.unique(lists.value_lengths().to_numpy()):
                same = np.flatnonzero(lists.value_lengths().to_numpy() == dim)
                for at in range(0, len(same), 2000):
                    rows = pa.array(same[at:at + 2000])
                    x = _unit(lists.take(rows))
                    keys = bucket_keys(x, s)
                    each = keys.shape[1] * keys.shape[2]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(ids.take(rows).to_numpy(), each))], names=["bucket", "class"])

    return classes.select("class", "embedding").mapInArrow(hash_rows, "bucket long, class long").distinct()


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least key that rows of a and b (pairs, tables, probes) share."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(a.shape[1]):
        same = a[:, t, :, None] == b[:, t, None, :]
        key = np.where(same, a[:, t, :, None], np.iinfo(np.int64).max).min((1, 2))
        out = np.minimum(out, key)
    return out


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside each run of rows."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = sizes[row] - at - 1
    i = np.repeat(starts[row] + at, later)
    return i, i + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)


def _close(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run with at least this cosine. Short runs go
    together, pair by pair; long ones by a product each."""
    out: list[list[np.ndarray]] = [[], []]
    for a, n in zip(starts[sizes > 48], sizes[sizes > 48]):
        part = x[a:a + n]
        i, j = np.nonzero(np.triu(part @ part.T >= threshold, 1))
        out[0].append(a + i), out[1].append(a + j)
    starts, sizes = starts[sizes <= 48], sizes[sizes <= 48]
    for at in range(0, len(sizes), 500):
        i, j = _pairs(starts[at:at + 500], sizes[at:at + 500])
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        out[0].append(i[near]), out[1].append(j[near])
    none = [np.empty(0, np.int64)]
    return np.concatenate(out[0] + none), np.concatenate(out[1] + none)


def _compare(rows: pa.Table, s: Settings) -> pa.Table:
    """Links of whole runs of rows of equal (bucket, lo, hi, length)."""
    lists = pa.concat_arrays(rows.column("embedding").chunks)
    ids, own, copies, bucket, lo, hi, dim = (
        rows.column(c).to_numpy() for c in ("class", "own", "copies", "bucket", "lo", "hi", "dim"))
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(bucket) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0) | (np.diff(dim) != 0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(ids)))
    node, links, ends = [], [], [[], []]
    for d in np.unique(dim):
        here = np.flatnonzero(dim == d)
        x = np.zeros((len(ids), d))
        x[here] = _unit(lists.take(pa.array(here)))
        of_d = dim[starts] == d
        i, j = _close(x, starts[of_d], sizes[of_d], s.threshold)
        keep = (lo[i] == hi[i]) | (own[i] != own[j])
        i, j = i[keep], j[keep]
        linked, which = np.unique(np.concatenate([i, j]), return_inverse=True)
        different, row = np.unique(ids[linked], return_index=True)
        keys = bucket_keys(x[linked[row]], s)
        key_of = np.searchsorted(different, ids)
        first = np.empty(len(i), bool)
        for at in range(0, len(i), 20_000):
            p = slice(at, at + 20_000)
            first[p] = _first_shared(keys[key_of[i[p]]], keys[key_of[j[p]]]) == bucket[i[p]]
        i, j = np.searchsorted(different, ids[i[first]]), np.searchsorted(different, ids[j[first]])
        size = np.empty(len(different), np.int64)
        size[key_of[linked]] = copies[linked]
        count = np.bincount(i, size[j], len(different)) + np.bincount(j, size[i], len(different))
        some = np.flatnonzero(count)
        node.append(different[some])
        links.append(count[some].astype(np.int64))
        for out, k in zip(ends, forest(len(different), i, j)):
            out.append(different[k])
    none = [np.empty(0, np.int64)]
    node, links, a, b = (np.concatenate(part + none) for part in (node, links, *ends))
    return pa.table({"node": np.concatenate([node, a]), "links": np.concatenate([links, np.zeros(len(a), np.int64)]),
                     "other": pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(b, pa.int64())])})


def _linked(classes: DataFrame, buckets: DataFrame, s: Settings) -> DataFrame:
    """node, links, other: parts of link counts, and edges of spanning forests
    (other is null on rows of counts)."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    run = ["bucket", "lo", "hi", "dim"]
    rows = (buckets.join(sizes, "bucket").withColumn("blocks", blocks)
            .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", "class", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
            .join(classes.select("class", "embedding", "copies", F.size("embedding").alias("dim")), "class"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            last = np.ones(rows.num_rows, bool)  # the last run may go on in the next batch
            for c in run:
                last &= rows.column(c).to_numpy() == rows.column(c)[-1].as_py()
            whole = rows.num_rows - int(last[::-1].cumprod().sum())
            if whole:
                yield from _compare(rows.slice(0, whole), s).to_batches()
            held = rows.slice(whole)
        if held is not None:
            yield from _compare(held, s).to_batches()

    dealt = rows.repartition("bucket", "lo", "hi").sortWithinPartitions(*run)
    return written(dealt.mapInArrow(compare, "node long, links long, other long"))


def near_duplicates(vectors: DataFrame, settings: Settings | None = None, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    vectors = vectors.select("vec_id", F.col(column).alias("embedding"))
    classes = _classes(vectors, "embedding")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    s = settings or Settings.for_size(size.n, size.d or 1)
    found = _linked(classes, written(_buckets(classes, s)), s)
    counts = found.where("other IS NULL").groupBy(F.col("node").alias("class")).agg(F.sum("links").alias("links"))
    joined = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_class = (classes.join(counts, "class", "left").join(joined, F.col("class") == F.col("node"), "left")
                .withColumn("k", F.coalesce("component", "class")))
    least = of_class.groupBy("k").agg(F.min("first_id").alias("component_id"))
    named = of_class.join(least, "k").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = vectors.join(named, "embedding", "left")
    component = F.coalesce("component_id", "vec_id").alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component,
                      (F.col("vec_id") == component).alias("kept"))


def op4(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
