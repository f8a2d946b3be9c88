"""Operator 12 against a trie of Python dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagelake.llm import prefix_trie as P
from pagelake.llm.common import written
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            conv[c].append(((t is not None, t or 0), r, tie, x))
    return {c: [(r, x) for _, r, _, x in sorted(turns)] for c, turns in conv.items()}


def changed(conv):
    out = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conv.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(conv):
    nodes = defaultdict(lambda: [[], set(), [], 0])
    for c in sorted(conv):
        for d in range(len(conv[c]) + 1):
            node = nodes[tuple(conv[c][:d])]
            node[0].append(c)
            node[3] = len(conv[c][d - 1][1]) if d else 0
            if d < len(conv[c]):
                node[1].add(tuple(conv[c][:d + 1]))
            else:
                node[2].append(c)
    sums = {}
    for key in sorted(nodes, key=len, reverse=True):
        m, kids, _, chars = nodes[key]
        below = [sums[k] for k in kids]
        sums[key] = (sum(x for x, _ in below) if kids else 1, sum(v for _, v in below) + (len(m) - 1) * chars)
    return sorted((m[0], len(k), nodes[k[:-1]][0][0] if k else None, len(m), len(kids), *sums[k],
                   hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
                  for k, (m, kids, ends, _) in nodes.items())


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def test_given_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert P.op12(turns).columns == COLUMNS
    assert result(P.op12(turns)) == brute(changed(sequences(rows)))
    assert result(P.conversation_trie(turns)) == brute(sequences(rows))


def shared(n, rng):
    """Conversations over few texts, so that prefixes branch at every depth."""
    return [(c, t, rng.choice("ua"), rng.choice(["", "x", "yé", "long text"])) for c in rng.sample(range(-250, 900), n)
            for t in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("slice_nodes,finish,hot", [(10**6, 10**6, 10**6), (40, 10, 2), (7, 1, 0)])
def test_slices_rounds_and_hot_parents(spark, slice_nodes, finish, hot):
    """Any cut of the tour into slices and any number of rounds gives the same."""
    rows = shared(160, random.Random(slice_nodes))
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    members = written(P.prefixes(*P.rebuilt(written(P.numbered_turns(turns)))))
    assert result(P.trie(members, slice_nodes, finish, hot)) == brute(changed(sequences(rows)))


def test_list_ranking(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 300)
    rows = [(a, b, rng.randrange(9), rng.randrange(99)) for a, b in zip(ids, ids[1:] + [-1])]
    got = {r.id: (r.l, r.v) for r in P.rank_chains(spark.createDataFrame(rows, "id long, succ long, l long, v long"), 5).collect()}
    before = (0, 0)
    for i, _, x, v in rows:
        assert got[i] == before
        before = (before[0] + x, before[1] + v)


def test_one_very_long_conversation_and_many_copies(spark):
    long = [(5, t, "u", f"{t % 11}") for t in range(3000)]
    copies = [(c, t, "u", f"same {t}") for c in range(1000, 2600) for t in range(3)]
    turns = spark.createDataFrame(long + copies, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # its turns lie in several parts
    try:
        numbered = written(P.numbered_turns(turns))
        assert numbered.where("conv_id = 5").select("part").distinct().count() > 1
        assert result(P.op12(turns)) == brute(changed(sequences(long + copies)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_inputs(spark):
    rows = [(None, 1, "u", "lost"), (7, None, None, None), (7, None, "", ""), (7, 2, "u", "a"), (7, 2, "a", "b"), (7, 2, "u", "a"),
            (100, 0, "u", "z"), (101, 0, "u", "own"), (-3, 1, "u", "n"), (-300, -5, "u", "m"), (9, 1, "u", "x" * 2_000_000),
            (109, 1, "u", "x" * 2_000_000), (110, 1, "u", "1:ux"), (111, 1, "u1", ":ux")]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("p"), "num": F.lit(0), "depth": F.lit(1), "n": F.lit(None)})
    assert result(P.op12(turns)) == brute(changed(sequences(rows)))
    # conversations that lose all turns are members of the root alone
    gone = [c for c, s in changed(sequences(rows)).items() if not s]
    assert gone and len(sequences(rows)) > len(gone)
    assert P.op12(spark.createDataFrame([], SCHEMA)).collect() == []
