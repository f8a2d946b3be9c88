"""Sitemaps from stored snapshots.

``xpath`` with ``local-name()`` reads namespaced sitemap XML on the JVM. An
index is expanded one level per round by joining its child locations back
to the snapshot table; children that are missing or do not parse contribute
nothing, like the reference skipping failed children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import go_trim
from ..operators import reach as RE
from ..session import ensure_checkpoint_dir

#: Rounds of one level each.
SHALLOW = 8

_INDEX_LOCS = "/*[local-name()='sitemapindex']/*[local-name()='sitemap']/*[local-name()='loc']/text()"
_URL_LOCS = "/*[local-name()='urlset']/*[local-name()='url']/*[local-name()='loc']/text()"


def read_sitemap(snapshots: DataFrame, seeds: DataFrame, body_col: str = "body") -> DataFrame:
    """``snapshots(url, body)``, ``seeds(url)`` → ``sitemap_url, url`` page
    locations (empty locs dropped). Malformed XML yields no rows. Indexes are
    followed to any depth; a sitemap listed twice, or by itself, is read once.

    Each round is one join of the new sitemap addresses with the snapshots;
    what it read is checkpointed, so later rounds only join addresses. Beyond
    SHALLOW rounds every snapshot is read once, and what the remaining addresses
    lead to is found by ``reach``, without a round a level."""
    ensure_checkpoint_dir(snapshots.sparkSession)
    snap = snapshots.select(F.col("url").alias("sitemap_url"), F.col(body_col).cast("string").alias("xml"))
    locs = lambda path: F.filter(F.transform(F.expr(f'xpath(xml, "{path}")'), go_trim), lambda x: x != "")
    frontier = visited = seeds.select(F.col("url").alias("sitemap_url")).distinct()
    lists = (locs(_INDEX_LOCS).alias("children"), locs(_URL_LOCS).alias("locs"))
    found, rounds = None, 0
    while found is None or not frontier.isEmpty():
        rounds += 1
        if rounds > SHALLOW:
            pin = lambda df: df.checkpoint(eager=True)
            every = pin(snap.select("sitemap_url", *lists))
            links = every.select(F.col("sitemap_url").alias("src_url"), F.explode("children").alias("url")).distinct().join(
                visited.select(F.col("sitemap_url").alias("url")), "url", "left_anti")
            deep = RE.depths(frontier.select(F.col("sitemap_url").alias("url"), F.lit(0).alias("depth")), pin(links), pin)
            rest = every.join(deep.select(F.col("url").alias("sitemap_url")), "sitemap_url", "left_semi")
            return found.unionByName(rest.select("sitemap_url", F.explode("locs").alias("url")))
        read = frontier.join(snap, "sitemap_url").select(
            "sitemap_url", *lists).checkpoint(eager=True)
        pages = read.select("sitemap_url", F.explode("locs").alias("url"))
        found = pages if found is None else found.unionByName(pages)
        children = read.select(F.explode("children").alias("sitemap_url")).distinct()
        frontier = children.join(visited, "sitemap_url", "left_anti").checkpoint(eager=True)
        visited = visited.unionByName(frontier)
    return found
