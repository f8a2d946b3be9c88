"""Operator 7, n-gram Jaccard join: the grouped prefix join.

A document's set holds the 64-bit hashes of its shingles. Two sets of the
wanted similarity share a shingle in their prefixes of n - ceil(t n) + 1
shingles under any one order of all shingles. The order here: first the
shingles of the low HEAD of the hash range, rare ones first by their exact
count over all documents, then the others by hash. As HEAD is a little more
than 1 - t, a prefix lies within the head for nearly every set, so only the
head's shingles are ever shuffled and counted. So:

1. documents with equal sets are one class, and only classes are paired;
2. head shingles that one class alone holds come first in every order and are
   dropped; each class keeps the others within its prefix, rare ones first, each
   with its place in the class's order. These make lists of classes;
3. two classes are a candidate only if for some list both places leave room for
   the overlap that their sizes ask for (the first shingle that they share does),
   and near only if their heads, or small sets as a whole, differ in no more
   shingles, by short codes, than the sets may;
4. long lists are joined by stars first: each class with the head of its step of
   size, the one of the least place, so the one with the fewest shingles of its
   own. Then all candidates of all lists whose ends are not joined yet are taken,
   very long lists in block pairs, and go through bitmaps first. Near pairs join classes to clusters: all links
   lie within clusters, and a passage or a phrase that texts share joins nothing;
5. a cluster's classes are dealt into blocks of bounded text, by steps of size if
   it is large. Block pairs that pass the size filter are verified as a whole, each
   in one task: the sizes of all intersections are a product of its shingle matrix.
   A task returns a spanning forest of the links it found, so rows grow with the
   members and not with the pairs of near copies;
6. links become components.

Defined results: without words or text the set is empty, and the document is
its own component; rows with a null id link with nothing and have a null
component; rows that repeat an id are separate documents; an empty table gives
an empty result; other columns of the input are ignored. Sets are taken for
equal when size and two 64-bit sums of their hashes agree.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm import sketch
from pagelake.llm.common import doc_texts, free_name, written
from pagelake.llm.components import components, forest

#: Shingles of the classes in one block, and what a class counts for besides
#: its shingles: they bound a task's memory (a longer text is a block by itself).
BLOCK_SHINGLES, CLASS_COST = 200_000, 200

#: Classes in one block of a long list, and candidates looked at in one go.
BLOCK_CLASSES, AT_ONCE = 2048, 1 << 20

#: Lists of more classes are joined by stars before their pairs are taken.
STAR = 4

#: Sets of up to so many shingles are compared whole by short codes, larger ones by their heads.
WHOLE = 256

#: Bits of a set's (its head's) bitmap, and how many shingles it may stand for to decide alone.
BITS, SHARP = 512, 256

#: Steps of size for each factor e; a step is 5 %.
STEPS = 20

#: What names a set.
SET = ("f1", "f2", "n_shingles")

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_CODE = np.uint64(0x7FFF)


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words, linked at ``percent`` per cent or more."""

    words: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1 if n else 0

    def least(self, both: Column | np.ndarray) -> Column | np.ndarray:
        """Shingles that two linked sets share at least, by the sum of their sizes."""
        up = self.percent * both + 99 + self.percent
        return F.floor(up / (100 + self.percent)) if isinstance(both, Column) else up // (100 + self.percent)

    def head(self) -> np.uint64:
        """Hashes below it are the head: a quarter more than a prefix's share."""
        return np.uint64((100 - self.percent) * 125 * ((1 << 64) - 1) // 10_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return x ^ (x >> _SHIFT)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mixed(out + h[j:len(h) - k + 1 + j])
    return np.unique(_mixed(out))


def _bitmap(codes: np.ndarray) -> bytes:
    marked = np.zeros(BITS, bool)
    marked[codes & (BITS - 1)] = True
    return np.packbits(marked).tobytes()


def _list_array(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *rows])))


def _signatures(docs: DataFrame, sim: Similarity) -> DataFrame:
    """Per document: set size, two sums that name the set, how many shingles its
    head has, its posted shingles (the head's, and more by hash where a prefix is
    longer than that), short codes (15 bits) of its head or of all of a small set,
    by hash, a bitmap of these, and a hash of the text."""
    longs = [T.StructField(n, T.LongType()) for n in ("n_shingles", "f1", "f2", "n_head")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("posted", T.ArrayType(T.LongType())),
                           T.StructField("codes", T.ArrayType(T.ShortType())), T.StructField("bits", T.BinaryType()), T.StructField("text_hash", T.LongType())])
    head = sim.head()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nums: list[list[int]] = [[], [], [], []]
            posted, codes = [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), sim.words)
                n_head = int(np.searchsorted(s, head))
                some = s[:max(sim.prefix(len(s)), n_head)]
                f = np.array([s.sum(), _mixed(s).sum()], np.uint64).view(np.int64)
                for out, x in zip(nums, (len(s), *f, n_head)):
                    out.append(int(x))
                posted.append(some.view(np.int64))
                codes.append(((s if len(s) <= WHOLE else s[:n_head]) & _CODE).astype(np.int16))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in nums), _list_array(posted, np.int64),
                 _list_array(codes, np.int16), pa.array([_bitmap(c) for c in codes], pa.binary()), b.column("text_hash")], names=schema.names)

    return doc_texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, schema)


def _lists(classes: DataFrame, sim: Similarity) -> DataFrame:
    """s, class, n_shingles, place: the shingles of each class's prefix that other
    classes hold as well, and how many of its shingles come before each."""
    posted = classes.select("class", F.posexplode("posted").alias("at", "s"))
    # of the shingles beyond the head the order is that of the hashes, so the place is known
    counted = posted.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("df > 1").join(
        classes.select("class", "n_shingles", "n_head").hint("merge"), "class")
    in_head = F.col("at") < F.col("n_head")
    of_class = Window.partitionBy("class")
    # the shingles of the head that one class alone holds come first
    alone = F.col("n_head") - F.count_if(in_head).over(of_class)
    rank = F.row_number().over(of_class.orderBy(~in_head, "df", "s")) - 1
    placed = counted.withColumn("place", F.when(in_head, alone + rank).otherwise(F.col("at")))
    room = F.expr(f"n_shingles - (({sim.percent} * n_shingles + 99) div 100)")
    return written(placed.where(F.col("place") <= room).select("s", "class", "n_shingles", "place"))


def _fits(sim: Similarity, a: str = "", b: str = "2") -> Column:
    """Whether a shingle at these places can be the first one that two linked sets share."""
    n, n2 = F.col("n_shingles" + a), F.col("n_shingles" + b)
    least = sim.least(n + n2)
    return (F.col("place" + a) <= n - least) & (F.col("place" + b) <= n2 - least)


def _step(column: str) -> Column:
    return F.floor(F.log(F.col(column)) * STEPS).alias("step")


def _stars(lists: DataFrame, sim: Similarity) -> DataFrame:
    """a, b: candidates of each class with the head of its step in a long list, and
    of these heads with each other."""
    long_ones = lists.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > STAR).select("s")
    rows = lists.join(long_ones, "s").withColumn("step", _step("n_shingles"))
    heads = rows.groupBy("s", "step").agg(F.min(F.struct("place", "class", "n_shingles")).alias("h")).select(
        "s", "step", F.col("h.class").alias("b"), F.col("h.n_shingles").alias("n_shingles2"), F.col("h.place").alias("place2"))
    reach = math.floor(-math.log(sim.percent / 100) * STEPS) + 1
    near = heads.select("s", F.col("step").alias("step1"), F.col("b").alias("class"),
                        F.col("n_shingles2").alias("n_shingles"), F.col("place2").alias("place"))
    own = rows.join(heads, ["s", "step"])
    other = heads.join(near, "s").where(F.col("step").between(F.col("step1") + 1, F.col("step1") + reach))
    both = [x.where((F.col("class") != F.col("b")) & _fits(sim)).select(F.col("class").alias("a"), "b") for x in (own, other)]
    return both[0].unionByName(both[1]).distinct()


def _block_pairs(rows: DataFrame, key: str, cost: Column, most: int, sim: Similarity) -> DataFrame:
    """The rows with lo, hi and block: each class of a key once for each pair of
    blocks (lo, hi) that its block is part of. A key whose classes' costs fit a block
    is one, a larger one has its steps of size dealt into as many blocks as they take."""
    large = rows.groupBy(key).agg((F.sum(cost) > most).alias("large"))
    whole = rows.join(large.where("not large").select(key), key).withColumns({c: F.lit(0).cast("long") for c in ("lo", "hi", "block")})
    stepped = rows.join(large.where("large").select(key), key).withColumn("step", _step("n_shingles"))
    span = stepped.groupBy(key, "step").agg(
        F.ceil(F.sum(cost) / most).cast("int").alias("parts"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    number = lambda part: (F.col("step") * (1 << 40) + part).alias("block")
    dealt = stepped.join(span.select(key, "step", "parts"), [key, "step"]).select(
        *rows.columns, number(F.pmod(F.xxhash64("class"), F.col("parts"))))
    blocks = span.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        key, number(F.col("part")), "least", "most")
    right = blocks.select(key, F.col("block").alias("hi"), F.col("least").alias("least2"))
    pairs = blocks.join(right, key).where(
        (F.col("block") <= F.col("hi")) & (100 * F.col("most") >= sim.percent * F.col("least2"))).select(
        key, F.col("block").alias("lo"), "hi")
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    return whole.unionByName(dealt.join(ends, [key, "block"]).select(*whole.columns))


def _pairs_of(rows: dict[str, np.ndarray], sim: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of whole runs (equal s, lo, hi), sorted by run and size, whose
    bitmaps differ in no more bits than linked sets may, and whether these decide."""
    n, place, joined, block, cls, kind, bits = (rows[c] for c in ("n_shingles", "place", "joined", "block", "class", "kind", "bits"))
    crossing = rows["lo"] != rows["hi"]
    new = np.ones(len(n), bool)
    new[1:] = np.any([np.diff(rows[c]) != 0 for c in _RUN], axis=0)
    run = np.cumsum(new)
    wide = np.int64(int(n.max(initial=0)) * 100 // sim.percent + 2)
    last = np.searchsorted(run * wide + n, run * wide + n * 100 // sim.percent, side="right")
    after = last - np.arange(len(n)) - 1
    ends = np.cumsum(after)
    at = 0
    while at < len(n):
        z = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        many = after[at:z]
        i = np.repeat(np.arange(at, z), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        at = z
        least = sim.least(n[i] + n[j])
        good = (joined[i] != joined[j]) & (place[i] <= n[i] - least) & (place[j] <= n[j] - least)
        good &= ~crossing[i] | (block[i] != block[j])
        i, j = i[good], j[good]
        sharp = (kind[i] == kind[j]) & (kind[i] < 2)
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        good = ~sharp | (differ <= n[i] + n[j] - 2 * sim.least(n[i] + n[j]))
        yield cls[i[good]], cls[j[good]], sharp[good]


def _joining(x: np.ndarray, y: np.ndarray, sharp: np.ndarray) -> pa.RecordBatch:
    """a, b, near: of near pairs edges that join what they join, of the others each once."""
    names, at = np.unique(np.concatenate([x[sharp], y[sharp]]), return_inverse=True)
    k = len(at) // 2
    a, b = (names[e] for e in forest(len(names), at[:k], at[k:]))
    rest = np.unique(np.sort(np.stack([x[~sharp], y[~sharp]], axis=1), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, rest[:, 0]])), pa.array(np.concatenate([b, rest[:, 1]])),
                                       pa.array(np.arange(len(a) + len(rest)) < len(a))], names=["a", "b", "near"])


_RUN = ("s", "lo", "hi")


def _candidates(lists: DataFrame, joined: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """a, b, near: all candidates whose ends are not joined yet (``node``,
    ``component``), or of those that small bitmaps show to be near a task's spanning
    forests, so a family whose pairs are just no links gives no row a pair."""

    def arrays(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: b.column(c).to_numpy() for c in b.schema.names if c != "bits"}
        return out | {"bits": np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)}

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in itertools.chain(batches, [None]):
            rows = held
            if b is not None:
                rows = arrays(b)
                rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()} if held else rows
            if rows is None:
                continue
            whole = len(rows["s"])
            if b is not None:                 # the last run may go on
                changes = np.flatnonzero(np.any([np.diff(rows[c]) != 0 for c in _RUN], axis=0))
                whole = int(changes[-1]) + 1 if len(changes) else 0
            for found in _pairs_of({c: v[:whole] for c, v in rows.items()}, sim) if whole else ():
                if len(found[0]):
                    yield _joining(*found)
            held = {c: v[whole:] for c, v in rows.items()}

    rows = lists.join(joined, F.col("class") == F.col("node"), "left").select(
        "s", "class", "n_shingles", "place", F.coalesce("component", "class").alias("joined"))
    mixed = rows.groupBy("s").agg(F.min("joined").alias("x"), F.max("joined").alias("y")).where("x <> y").select("s")
    kind = F.when(F.col("n_shingles") <= WHOLE, 0).when(F.col("n_head") <= SHARP, 1).otherwise(2).cast("long").alias("kind")
    rows = _block_pairs(written(rows.join(mixed, "s")), "s", F.lit(1), BLOCK_CLASSES, sim).join(
        classes.select("class", kind, "bits").hint("merge"), "class")
    dealt = rows.repartition(*_RUN).sortWithinPartitions(*_RUN, "n_shingles")
    return written(dealt.mapInArrow(enumerate_, "a long, b long, near boolean").distinct())


def _near(pairs: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs whose heads, or small sets, differ in no more shingles than linked
    sets may, by short codes. What falls together there counts as shared, so no pair
    is lost."""
    pairs = written(pairs)
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    sets = written(classes.select("class", "n_shingles", "n_head", "codes").join(ends, "class"))
    side = lambda k: sets.select(F.col("class").alias(k), F.struct("n_shingles", "n_head", "codes").alias(f"{k}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small = (F.col("a_set.n_shingles") <= WHOLE) & (F.col("b_set.n_shingles") <= WHOLE)
    used = lambda k: F.when(small, F.col(f"{k}_set.codes")).otherwise(
        F.slice(f"{k}_set.codes", F.lit(1), F.col(f"{k}_set.n_head").cast("int")))
    n = F.col("a_set.n_shingles") + F.col("b_set.n_shingles")
    counted = both.select("a", "b", (n - 2 * sim.least(n)).alias("may"), used("a").alias("x"), used("b").alias("y")).select(
        "a", "b", "may", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("shared"),
        F.size(F.array_distinct("x")).alias("dx"), F.size(F.array_distinct("y")).alias("dy"))
    shared = F.col("shared") + F.least(F.col("nx") - F.col("dx"), F.col("ny") - F.col("dy"))
    return written(counted.where(F.col("nx") + F.col("ny") - 2 * shared <= F.col("may")).select("a", "b"))


def _clusters(classes: DataFrame, sim: Similarity) -> DataFrame:
    """cluster, class, n_shingles of the classes that near pairs join."""
    lists = _lists(classes, sim)
    stars = _near(_stars(lists, sim), classes, sim)
    pairs = _candidates(lists, components(stars), classes, sim)
    near = pairs.where("near").select("a", "b").unionByName(_near(pairs.where("not near").select("a", "b"), classes, sim))
    joined = components(stars.unionByName(near)).select(F.col("component").alias("cluster"), F.col("node").alias("class"))
    return written(joined.join(classes.select("class", "n_shingles"), "class"))


def _maybe(wanted: DataFrame, column: str) -> Column:
    """Whether a row's ``column`` may be among those of ``wanted``, by a sketch:
    true for all that are, false for most others."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.counted(b.column("h").to_numpy().view(np.uint64) for b in batches)

    marks = np.packbits(sketch.total(wanted.select(F.xxhash64(column).alias("h")).mapInArrow(hashed, sketch.SCHEMA)) > 0)

    @F.arrow_udf("boolean")
    def maybe(hashes: pa.Array) -> pa.Array:
        at = sketch.cell(hashes.to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.array((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return maybe(F.xxhash64(column))


def _class_texts(docs: DataFrame, clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """class and text of the classes in clusters. Documents that can't be one of
    them are left out before the shuffle by a sketch of the wanted ids."""
    wanted = written(clusters.select("class").join(classes, "class").select(
        "class", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")))

    maybe = _maybe(wanted, "doc_id")
    some = doc_texts(docs).where("doc_id IS NOT NULL").where(maybe)
    found = some.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"]).select("class", "text")
    return written(found.dropDuplicates(["class"]))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: a product of the 0/1 matrix of sets and the
    shingles that two of them share, some columns at a time."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32)
    width = 4096
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [k, k + width])
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], column[a:b] - k] = 1
        out += part @ part.T
    return out


def _links(rows: pa.Table, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links in one pair of blocks."""
    classes, block = rows.column("class").to_numpy(), rows.column("block").to_numpy()
    sets = [shingles(t.as_py(), sim.words) for t in rows.column("text")]
    n = np.array([len(s) for s in sets])
    both = _overlaps(sets)
    near = np.triu(100 * both >= sim.percent * (n[:, None] + n[None] - both), 1)
    if rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py():
        near &= block[:, None] != block[None]
    a, b = forest(len(sets), *np.nonzero(near))
    return classes[a], classes[b]


def _verified(clusters: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """a, b: spanning forests of the links between classes of a cluster."""
    run = ["cluster", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in itertools.chain(batches, [None]):
            rows = pa.Table.from_batches([b]) if b is not None else None
            if held is not None:
                rows = pa.concat_tables([held, rows]) if rows is not None else held
            if rows is None or not rows.num_rows:
                continue
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.any([np.diff(rows.column(c).to_numpy()) != 0 for c in run], axis=0)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], rows.num_rows)
            whole = len(starts) if b is None else len(starts) - 1  # the last run may go on
            found = [_links(rows.slice(s, e - s), sim) for s, e in zip(starts[:whole], ends[:whole])]
            if found:
                a, c = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])
            held = rows.slice(starts[whole]) if whole < len(starts) else None

    pairs = _block_pairs(clusters, "cluster", F.col("n_shingles") + CLASS_COST, BLOCK_SHINGLES, sim)
    rows = pairs.join(texts, "class").select(*run, "block", "class", "text")
    return written(rows.repartition(*run).sortWithinPartitions(*run).mapInArrow(verify, "a long, b long"))


def _classes(linked: DataFrame) -> DataFrame:
    """One row per different set: class, its size, posted shingles, codes and
    bitmap, and its first document."""
    return written(linked.groupBy(*SET).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_head").alias("n_head"),
        F.first("posted").alias("posted"), F.first("codes").alias("codes"), F.first("bits").alias("bits")).withColumn("class", F.monotonically_increasing_id()))


def ngram_components(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    signed = written(_signatures(docs, sim))
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = _classes(linked)
    clusters = _clusters(classes, sim)
    links = _verified(clusters, _class_texts(docs, clusters, classes), sim)
    members = classes.join(components(links), F.col("class") == F.col("node"), "left").drop("node").withColumn(
        "component", F.coalesce("component", "class"))
    first = members.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    named = members.join(first, "component").select(*SET, "component_id")
    have = linked.select("doc_id", *SET).join(named, list(SET)).select("doc_id", "n_shingles", "component_id")
    rest = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return have.unionByName(rest)


def first_of_each(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """The documents, all columns kept, with one row of each component: the one
    of the smallest id, and of rows that share it the first as they are numbered
    here. Rows link by their texts whatever their ids; a row with a null id gives
    way to any that has one."""
    row = free_name(docs, "_row")
    table = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = ngram_components(table.select(F.col(row).alias("doc_id"), "text"), sim).select(F.col("doc_id").alias("_key"), "component_id")
    ids = table.select(F.col(row).alias("_key"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    placed = written(ids.join(found, "_key"))
    first = placed.groupBy("component_id").agg(F.min(F.struct("no_id", "doc_id", "_key")).alias("first")).select("first._key")
    later = written(placed.select("_key").join(first, "_key", "left_anti").withColumnRenamed("_key", row))
    maybe = _maybe(later, row)  # the texts of most rows that stay are not shuffled
    return table.where(~maybe).unionByName(table.where(maybe).join(later, row, "left_anti")).drop(row)


def op7(docs: DataFrame) -> DataFrame:
    return ngram_components(docs)
