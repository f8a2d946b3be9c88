"""Depths of deep link graphs: those of a breadth-first search, in few rounds."""

import random

from pagelake.operators import crawl as CR
from pagelake.operators import reach as RE


def _bfs(starts, edges):
    depth = dict(starts)
    todo = sorted(depth.values())
    d = min(todo, default=0)
    while any(x >= d for x in depth.values()):
        for u, v in edges:
            if depth.get(u) == d and depth.get(v, d + 2) > d + 1:
                depth[v] = d + 1
        d += 1
    return depth


def test_depths_are_those_of_a_search_by_levels(spark):
    R = random.Random(3)
    edges = {(f"c{i}", f"c{i + 1}") for i in range(300)} | {("c40", "d0"), ("d3", "c20"), ("c250", "c100"), ("s", "s"), ("c9", "c0")}
    edges |= {(f"d{i}", f"d{i + 1}") for i in range(70)} | {("d50", "c290"), ("d70", "c295")}
    edges |= {("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "t")}               # a ring that nothing leads to
    edges |= {(f"g{R.randrange(40)}", f"g{R.randrange(40)}") for _ in range(70)} | {("c5", "g0")}
    starts = {"c0": 2, "s": 2}
    rounds = []

    def pin(df):
        rounds.append(1)
        return df.localCheckpoint()

    got = RE.depths(spark.createDataFrame(list(starts.items()), "url string, depth int"), spark.createDataFrame(sorted(edges), "src_url string, url string").distinct(), pin)
    rows = [tuple(r) for r in got.select("url", "depth").collect()]
    assert dict(rows) == _bfs(starts, edges) and len(rows) == len(dict(rows))
    assert len(rounds) < 60


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    pins, pin = [], CR._Levels.pin
    monkeypatch.setattr(CR._Levels, "pin", lambda self, df: pins.append(1) or pin(self, df))
    at = lambda i: f"https://x.test/{i}"
    edges = spark.createDataFrame([(at(i), at(i + 1)) for i in range(150)] + [(at(140), at(3))], "src_url string, dst_url string")
    seeds = spark.createDataFrame([(at(0),)], "url string")
    got = {r.url: (r.depth, r.source) for r in CR.crawl(seeds, edges, max_depth=0).collect()}
    assert got == {at(i): (i, "link" if i else "seed") for i in range(151)}
    assert len(pins) < 50
    assert CR.crawl(seeds, edges, max_depth=60).count() == 61
