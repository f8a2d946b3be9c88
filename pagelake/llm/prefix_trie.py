"""Operator 12, conversation prefix trie by the Euler-tour technique.

Conversations that begin alike share the nodes of their common first turns. A
node is known by the sums, over its turns, of digests of (place, role, text);
sums can be taken in any order, so the turns of one very long conversation are
summed in parts. Its name is (smallest member, depth).

Each node has an arc that enters it and one that leaves it. The arcs form one
list, the Euler tour: an entering arc is followed by the one that enters the
first child, or by the node's own leaving arc; a leaving arc by the one that enters
the next sibling, or that leaves the parent. The list is ranked without ever
being in one place:

1. nodes are dealt out by range of (smallest member's block, member, depth), and
   each slice joins the arcs of its own that follow each other into chains;
2. chains that remain are contracted in rounds: by coin flips, some take in their
   successor, until FINISH of them are left; these are ranked in one task;
3. the rounds are undone, which gives each chain the sums of all arcs before it.

Sums of leaves and savings at a node's two arcs differ by what its subtree has.

Hot groups: copies of a conversation and common first turns meet in aggregates
that combine before they shuffle; children of one parent are ordered slice by slice;
the few parents with very many children (fewer than nodes / HOT) are broadcast to
their children; a conversation with very many turns is dealt out by range.

Defined results: rows of a null conv_id belong to no conversation; null role and
text are empty; turns that tie are ordered by role, then by a digest of the text; equal
rows are turns of their own; an empty table has no nodes; other columns are ignored.
Very long texts are digested where they are read, and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import written

#: Nodes in a slice at most (there are no fewer slices than shuffle partitions),
#: chains ranked in one task, children that make a parent hot.
SLICE, FINISH, HOT = 200_000, 65_536, 1_000

#: Conversation ids in a block, which stay near each other in the slices.
BLOCK_SHIFT = 10

LANES = tuple(f"k{i}" for i in range(4))
_PARENT = tuple(f"p{i}" for i in range(4))


def _lanes(depth: Column, digest: Column) -> list[Column]:
    """Four 32-bit numbers of a turn at its place."""
    d = F.md5(F.concat_ws(":", depth.cast("string"), digest))
    return [F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _wrapped(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, part, pos (from 1 in the conversation), n (its turns), digest and
    chars of each turn; a conversation's turns lie in parts, by order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.char_length(text).cast("bigint").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = written(narrow.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("conv_id", "part")
    parts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("conv_id")
    parts = parts.select("conv_id", "part", F.sum("c").over(whole).alias("n"), (F.sum("c").over(
        whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")).alias("before"))
    rows = dealt.withColumn("place", F.row_number().over(here.orderBy(*order))).join(parts, ["conv_id", "part"])
    return rows.select("conv_id", "part", (F.col("before") + F.col("place")).alias("pos"), "n", "digest", "chars")


def rebuilt(turns: DataFrame, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The contract's change of ``numbered_turns``: the first h turns come from
    conversation c - c % span, h = crc32(c) % most. Returns rows (conv_id, part,
    depth, last, digest, chars; part -1: from the other conversation) and one
    row per conversation (conv_id, last: whether it has no turn)."""
    c = F.col("conv_id")
    heads = turns.where((c % span == 0) & (F.col("pos") < most)).groupBy(c.alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    h = (F.crc32(c.cast("string")) % most).cast("int")
    convs = turns.where("pos = 1").select("conv_id", "n", (c - c % span).alias("base"), h.alias("h")).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(heads.schema["head"].dataType))
    convs = convs.select("conv_id", "n", "h", head.alias("head"))
    length = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    first = convs.select("conv_id", F.lit(-1).alias("part"), length.alias("all"), F.inline("head")).select(
        "conv_id", "part", F.col("pos").alias("depth"), (F.col("pos") == F.col("all")).alias("last"), "digest", "chars")
    # how far own turns move up, only where the other conversation is short; by
    # part, as a conversation may have very many turns
    moved = convs.select("conv_id", (F.size("head") - F.col("h")).alias("move")).where("move <> 0")
    parts = turns.select("conv_id", "part").distinct().join(moved, "conv_id")
    own = turns.where(F.col("pos") > h).join(parts, ["conv_id", "part"], "left").select(
        "conv_id", "part", (F.col("pos") + F.coalesce("move", F.lit(0))).alias("depth"), (F.col("pos") == F.col("n")).alias("last"),
        "digest", "chars")
    return first.unionByName(own), convs.select("conv_id", (length == 0).alias("last"))


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, last, chars, the node's LANES and its parent's, for each
    turn, and for the root with each conversation."""
    terms = written(rows.select("conv_id", "part", "depth", "last", "chars", *[
        x.alias(k) for k, x in zip(LANES, _lanes(F.col("depth"), F.col("digest")))]))
    sums = terms.groupBy("conv_id", "part").agg(*[F.sum(k).alias(k) for k in LANES])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"b{k}") for k in LANES])
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = terms.select("*", *[F.sum(k).over(so_far).alias(f"s{k}") for k in LANES]).join(sums, ["conv_id", "part"])
    keyed = run.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "last", "chars",
                       *[_wrapped(F.col(f"s{k}") + F.col(f"b{k}")).alias(k) for k in LANES],
                       *[_wrapped(F.col(f"s{k}") + F.col(f"b{k}") - F.col(k)).alias(p) for k, p in zip(LANES, _PARENT)])
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv_id", zero.alias("depth"), "last", zero.alias("chars"), *[zero.alias(k) for k in LANES + _PARENT])
    return keyed.unionByName(root)


_NODE = ("depth", *LANES)


def _count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def trie_nodes(members: DataFrame, slice_nodes: int = SLICE) -> DataFrame:
    """A row per node of ``prefixes``: num (its number: by slice and place),
    conv_id, depth, n_convs, chars, keys."""
    nodes = members.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        *[F.max(p).alias(p) for p in _PARENT])
    nodes = written(nodes)
    block = F.xxhash64(F.shiftright("conv_id", BLOCK_SHIFT))
    order = [block, F.col("conv_id"), F.col("depth")]
    slices = max(math.ceil(_count(nodes) / slice_nodes), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(nodes.repartitionByRange(slices, *order).sortWithinPartitions(*order)
                   .select(F.monotonically_increasing_id().alias("num"), "*"))


#: Bits of a node's number within its slice, as the numbering above has them.
_PLACE_BITS = 33


def linked(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """``nodes`` with n_children, and the numbers of the first child, the next
    sibling and the parent (null: none), and the parent's conv_id."""
    up = F.when(F.col("depth") > 0, F.col("depth") - 1).alias("depth")
    kids = nodes.where("depth > 0").select("num", up, *[F.col(p).alias(k) for p, k in zip(_PARENT, LANES)])
    counts = kids.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_children"), F.min("num").alias("first_child"))
    # siblings by number, slice by slice
    kids = kids.withColumn("slice", F.shiftright("num", _PLACE_BITS))
    inside = kids.withColumn("next", F.lead("num").over(Window.partitionBy(*_NODE, "slice").orderBy("num")))
    after = Window.partitionBy(*_NODE).orderBy("slice")
    firsts = kids.groupBy(*_NODE, "slice").agg(F.min("num").alias("f"))
    firsts = firsts.withColumn("ahead", F.lead("f").over(after)).where("ahead IS NOT NULL").drop("f")
    sibling = inside.join(firsts, [*_NODE, "slice"], "left").select(
        "num", *_NODE, F.coalesce("next", "ahead").alias("next_sibling"))
    known = written(nodes.drop(*_PARENT).join(counts, list(_NODE), "left")
                    .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))
    parents = known.select(*_NODE, F.col("num").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many, few = (parents.where(f"n_children {test} {hot}").drop("n_children") for test in (">", "BETWEEN 1 AND"))
    # at most nodes / hot parents have more children than that
    by_hot = sibling.join(F.broadcast(many), list(_NODE), "left")
    rest = by_hot.where("parent IS NULL").drop("parent", "parent_conv_id").join(few, list(_NODE), "left")
    ups = by_hot.where("parent IS NOT NULL").unionByName(rest).drop(*_NODE)
    return known.join(ups, "num", "left")


#: Rows of a slice: kind 0 is a node with the chains of its two arcs and the sums
#: in them before the arc; kind 1 a chain with its successor and sums.
_PIECE = "kind INT, id BIGINT, a BIGINT, al BIGINT, av BIGINT, b BIGINT, bl BIGINT, bv BIGINT"


def _ranked(ids: np.ndarray, succ: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For arcs sorted by id: index of the first arc of its chain, sums of the
    weights before it in the chain, and the arc that follows it here (or -1)."""
    n = len(ids)
    at = np.searchsorted(ids, succ)
    at[at == n] = 0
    nxt = np.where((ids[at] == succ) & (succ >= 0), at, -1) if n else np.empty(0, np.int64)
    prev = np.full(n, -1)
    here = np.flatnonzero(nxt >= 0)
    prev[nxt[here]] = here
    jump, sums = prev.copy(), [np.where(prev >= 0, w[prev], 0) for w in weights]
    head = np.where(prev >= 0, prev, np.arange(n))
    while (live := np.flatnonzero(jump >= 0)).size:
        to = jump[live]
        add = [s[to] for s in sums]
        for s, x in zip(sums, add):
            s[live] += x
        head[live] = head[to]
        jump[live] = jump[to]
    return head, sums, nxt


def _arcs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Arc numbers (entering: even), sorted, their successors, and what they carry."""
    num = t.column("num").to_numpy()
    order = np.argsort(num, kind="stable")
    num = num[order]
    get = lambda c: t.column(c).fill_null(-1).to_numpy()[order]
    child, sibling, parent = get("first_child"), get("next_sibling"), get("parent")
    n = len(num)
    ids, succ, leaf, saved = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64), np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    ids[::2], ids[1::2] = 2 * num, 2 * num + 1
    succ[::2] = np.where(child >= 0, 2 * child, 2 * num + 1)
    succ[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, -1))
    leaf[::2] = child < 0
    saved[::2] = (get("n_convs") - 1) * get("chars")
    return ids, succ, [leaf, saved]


def _slice_chains(t: pa.Table) -> pa.Table:
    ids, succ, weights = _arcs(t)
    head, (leaf, saved), nxt = _ranked(ids, succ, weights)
    n = len(ids) // 2
    tail = np.flatnonzero(nxt < 0)
    total = [s[tail] + w[tail] for s, w in zip((leaf, saved), weights)]
    nothing = np.zeros(len(tail), np.int64)
    cols = [(ids[::2] // 2, ids[head[tail]]), (ids[head[::2]], succ[tail]), (leaf[::2], total[0]), (saved[::2], total[1]),
            (ids[head[1::2]], nothing), (leaf[1::2], nothing), (saved[1::2], nothing)]
    kind = np.concatenate([np.zeros(n, np.int32), np.ones(len(tail), np.int32)])
    return pa.table([pa.array(kind, pa.int32()), *[pa.array(np.concatenate(c), pa.int64()) for c in cols]],
                    names=["kind", "id", "a", "al", "av", "b", "bl", "bv"])


def _finished(t: pa.Table) -> pa.Table:
    order = np.argsort(t.column("id").to_numpy(), kind="stable")
    ids, succ, leaf, saved = (t.column(c).to_numpy()[order] for c in ("id", "succ", "l", "v"))
    _, sums, _ = _ranked(ids, succ, [leaf, saved])
    return pa.table([pa.array(x, pa.int64()) for x in (ids, *sums)], names=["id", "l", "v"])


def rank_chains(chains: DataFrame, finish: int = FINISH) -> DataFrame:
    """Sums l and v over all chains before each one (id), for chains (id, succ, l, v)
    that form one list. A round takes about a quarter of them out."""
    merged: list[DataFrame] = []
    n, turn = _count(chains), 0
    while n > finish:
        heads_up = F.xxhash64("id", F.lit(turn)).bitwiseAND(F.lit(1).cast("bigint")) == 1
        flipped = chains.withColumn("up", heads_up)
        takers = flipped.where("NOT up").drop("up")
        givers = flipped.where("up").select(F.col("id").alias("succ"), F.col("succ").alias("s2"), F.col("l").alias("l2"), F.col("v").alias("v2"))
        taken = written(takers.join(givers, "succ", "left"))
        into = taken.where("s2 IS NOT NULL")
        merged.append(into.select(F.col("succ").alias("id"), F.col("id").alias("of"), "l", "v"))
        stay = flipped.where("up").drop("up").join(into.select(F.col("succ").alias("id")), "id", "left_anti")
        zero = F.lit(0).cast("bigint")
        chains = written(taken.select("id", F.coalesce("s2", "succ").alias("succ"), (F.col("l") + F.coalesce("l2", zero)).alias("l"),
                                      (F.col("v") + F.coalesce("v2", zero)).alias("v")).unionByName(stay))
        n, turn = _count(chains), turn + 1
    # FINISH rows at most
    ranked = written(chains.groupBy().applyInArrow(_finished, "id BIGINT, l BIGINT, v BIGINT"))
    for gone in reversed(merged):
        back = gone.join(ranked.select(F.col("id").alias("of"), F.col("l").alias("l0"), F.col("v").alias("v0")), "of")
        ranked = written(ranked.unionByName(back.select("id", (F.col("l") + F.col("l0")).alias("l"), (F.col("v") + F.col("v0")).alias("v"))))
    return ranked


def subtree_sums(nodes: DataFrame, finish: int = FINISH) -> DataFrame:
    """num, n_leaves and saved of each of the ``linked`` nodes' subtrees."""
    pieces = written(nodes.select("num", "first_child", "next_sibling", "parent", "n_convs", "chars",
                                  F.shiftright("num", _PLACE_BITS).alias("slice"))
                     .groupBy("slice").applyInArrow(_slice_chains, _PIECE))
    chains = pieces.where("kind = 1").select("id", F.col("a").alias("succ"), F.col("al").alias("l"), F.col("av").alias("v"))
    arcs = pieces.where("kind = 0").drop("kind").withColumnRenamed("id", "num")
    here = arcs.where("a = b").select("num", (F.col("bl") - F.col("al")).alias("n_leaves"), (F.col("bv") - F.col("av")).alias("saved"))
    apart = arcs.where("a <> b")
    ranks = rank_chains(chains, finish)
    for arc in ("a", "b"):
        apart = apart.join(ranks.select(F.col("id").alias(arc), F.col("l").alias(f"l0{arc}"), F.col("v").alias(f"v0{arc}")), arc)
    apart = apart.select("num", (F.col("l0b") + F.col("bl") - F.col("l0a") - F.col("al")).alias("n_leaves"),
                         (F.col("v0b") + F.col("bv") - F.col("v0a") - F.col("av")).alias("saved"))
    return here.unionByName(apart)


#: Ids joined into one piece of a list, before the pieces are hashed in order.
ENDS = 512


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (keys, conv_id) as pieces of the keys' lists."""
    names = [*_NODE, "at", "ids"]
    key, held = None, []

    def piece() -> tuple:
        return (*key, held[0], ",".join(map(str, held)))

    for b in batches:
        out = []
        for *k, conv in zip(*(b.column(c).to_pylist() for c in (*_NODE, "conv_id"))):
            if held and (k != key or len(held) == ENDS):
                out.append(piece())
                held = []
            key = k
            held.append(conv)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=_PIECES)
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, piece()))], schema=_PIECES)


#: Schema of such pieces.
_PIECES = pa.schema([*[(k, pa.int64()) for k in _NODE], ("at", pa.int64()), ("ids", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one digest per key; the lists are never held."""
    key, sha = None, None
    schema = pa.schema([*[(k, pa.int64()) for k in _NODE], ("ends_sha256", pa.string())])
    row = lambda: dict(zip(schema.names, (*key, sha.hexdigest())))
    for b in batches:
        out = []
        for *k, ids in zip(*(b.column(c).to_pylist() for c in (*_NODE, "ids"))):
            if k != key:
                if sha:
                    out.append(row())
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if sha:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def ends_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, comma-joined ids of the conversations that end at
    each node where any does. Lists are made in pieces, so that what meets in
    the one task that must hash a list is ENDS ids a row, streamed."""
    keys = T.StructType([T.StructField(k, T.LongType()) for k in _NODE])
    pieces = (members.where("last").select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
              .mapInArrow(_joined, T.StructType([*keys.fields, T.StructField("at", T.LongType()), T.StructField("ids", T.StringType())])))
    return (pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "at")
            .mapInArrow(_hashed, T.StructType([*keys.fields, T.StructField("ends_sha256", T.StringType())])))


def trie(members: DataFrame, slice_nodes: int = SLICE, finish: int = FINISH, hot: int = HOT) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved (characters that its subtree shares), ends_sha256."""
    nodes = written(linked(trie_nodes(members, slice_nodes), hot))
    sums = subtree_sums(nodes, finish)
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, "num").join(ends_digests(members), list(_NODE), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form of ``rebuilt``."""
    rows = turns.select("conv_id", "part", F.col("pos").alias("depth"), (F.col("pos") == F.col("n")).alias("last"), "digest", "chars")
    return rows, turns.where("pos = 1").select("conv_id", F.lit(False).alias("last"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of a table of conv_id, turn, role and text."""
    return trie(written(prefixes(*plain(written(numbered_turns(turns))))))


def op12(turns: DataFrame) -> DataFrame:
    """The contract's columns, over rebuilt conversations."""
    members = written(prefixes(*rebuilt(written(numbered_turns(turns)))))
    return trie(members).withColumnRenamed("saved", "saved_tokens")
