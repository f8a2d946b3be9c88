"""Shortest depths in deep link graphs, by joins whose number follows the
graph's branching rather than its depth.

A node with one source alone is as deep as that source and one more, so its depth
needs no level of its own: such nodes point to their source, and pointers are
doubled until they end at a node that has several sources or is a start (a
logarithm of the longest chain, in rounds). Between these heads the links carry
the chain's length, and lengths are relaxed until none gets shorter. Any graph
comes out exact; a chain costs no round a node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pin = Callable[[DataFrame], DataFrame]


def chains(edges: DataFrame, starts: DataFrame, pin: Pin) -> DataFrame:
    """``url, head, steps``: the nodes of one source alone, with the head their
    chain begins at. Nodes of a ring that nothing else leads to have none.
    ``edges``: distinct ``src_url, url``; ``starts``: ``url``."""
    single = edges.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min("src_url").alias("head")).where("n = 1")
    single = single.join(starts.select("url"), "url", "left_anti").where("head <> url")
    table = pin(single.select("url", "head", F.lit(1).cast("long").alias("steps")))
    # a chain of n nodes ends within log2(n) rounds; what has not then is a ring, or behind one
    for _ in range(table.count().bit_length() + 1):
        ahead = table.select(F.col("url").alias("head"), F.col("head").alias("_next"), F.col("steps").alias("_more"))
        table = pin(table.join(ahead, "head", "left").select(
            "url", F.coalesce("_next", "head").alias("head"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"),
            F.col("_next").isNotNull().alias("open")))
        if table.where("open").isEmpty():
            break
    return table.where("NOT open").select("url", "head", "steps") if "open" in table.columns else table


def depths(starts: DataFrame, edges: DataFrame, pin: Pin) -> DataFrame:
    """``url, depth``: every node that ``starts`` (``url, depth``, distinct) lead
    to, starts included, with its least depth. ``edges``: distinct ``src_url, url``.
    ``pin`` cuts the lineage (a checkpoint)."""
    begin = pin(starts.select("url", F.col("depth").cast("long").alias("depth")))
    chain = pin(chains(edges, begin.select("url"), pin))
    heads = edges.join(chain.select("url"), "url", "left_anti")
    by = chain.select(F.col("url").alias("src_url"), "head", "steps")
    links = pin(heads.join(by, "src_url", "left").select(
        F.coalesce("head", "src_url").alias("src_url"), "url", (F.coalesce("steps", F.lit(0)) + 1).alias("length"))
        .groupBy("src_url", "url").agg(F.min("length").alias("length")))
    known = front = begin
    while not front.isEmpty():
        reached = front.select(F.col("url").alias("src_url"), "depth").join(links, "src_url").groupBy("url").agg(
            F.min(F.col("depth") + F.col("length")).alias("depth"))
        old = known.select("url", F.col("depth").alias("_old"))
        front = pin(reached.join(old, "url", "left").where("_old IS NULL OR depth < _old").select("url", "depth"))
        known = pin(known.unionByName(front).groupBy("url").agg(F.min("depth").alias("depth")))
    inner = chain.join(known.select(F.col("url").alias("head"), "depth"), "head").select("url", (F.col("depth") + F.col("steps")).alias("depth"))
    return known.unionByName(inner)
