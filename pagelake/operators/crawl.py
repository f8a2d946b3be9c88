"""Link-graph crawl (M5) and its counters (§2.4 D1/D7, C14, E5, E6, W2, G5, G7).

The reference runs a worker pool over a channel and a visited set in
memory. Here a crawl is level-synchronous breadth-first search: each level
is one Spark job — frontier ⋈ edges (D7) → rewrite (C4) → visit key (C3) →
host/allow/deny filters (C6-C8) → anti join with everything visited (D1).
The visited table and frontier are checkpointed to the cluster's shared
checkpoint folder every level, so lineage stays one level deep and a lost
executor only recomputes the current level. Level-by-level BFS gives every
URL its minimum depth (T9: deterministic, never larger than the
reference's first-arrival depth). What lies deeper than SHALLOW levels gets the
same depths from ``reach``, whose rounds don't follow the length of chains.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from . import reach as RE

COMPACT_EVERY = 4
#: Levels that are walked one by one; deeper links go through ``reach``.
SHALLOW = 12
FORCE_RENDER_MIN_PAGES = 10
FORCE_RENDER_SHELL_RATIO = 0.8


def _visit_keys(df: DataFrame, rules, seed_host: str | None, allow, deny) -> DataFrame:
    """C4 → C3 → filters on the normalized URL (the crawl's visit key).
    (The reference marks a URL visited before filtering it; a rejected URL
    would be rejected again, so filtering first emits the same rows.)"""
    rewritten = U.rewrite_url(F.col("raw_url"), rules) if rules else F.col("raw_url")
    keyed = df.withColumn("url", U.normalize_url(rewritten)).filter(F.col("url") != "")
    if seed_host is not None:
        keyed = keyed.filter(U.passes_filters(F.col("url"), seed_host, allow, deny))
    return keyed


class _Levels:
    """Tables that cut the lineage: each is persisted (so it is computed
    once) and written to the shared checkpoint folder. The cached copies are
    released as soon as nothing but the checkpoint is needed."""

    def __init__(self, checkpoint: bool):
        self.checkpoint = checkpoint
        self.cached: list[DataFrame] = []

    def pin(self, df: DataFrame) -> DataFrame:
        if not self.checkpoint:
            return df
        self.cached.append(df.persist())
        return self.cached[-1].checkpoint(eager=True)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()
        self.cached = []


def crawl(seeds: DataFrame, edges: DataFrame, pages: DataFrame | None = None, max_depth: int = 3,
          allow: Sequence[str] = (), deny: Sequence[str] = (), rules: Sequence[tuple[str, str]] = (),
          same_host: bool = True, checkpoint: bool = True, num_partitions: int | None = None,
          store: DataFrame | None = None, now=None, ttl_seconds: int = 72 * 3600,
          renderer_available: bool = False, expand_hits: bool = True, seed_host: str | None = None) -> DataFrame:
    """M5 over tables.

    ``seeds``: ``url``. ``edges``: ``src_url, dst_url`` — the links of the
    page fetched at ``src_url`` (a normalized crawl URL), already resolved
    (C19/C20, e.g. from ``page_links``). ``pages`` (optional): ``url,
    content_type, body`` — C14 expands only pages whose content is HTML
    with a non-empty body. ``max_depth`` ≤ 0 means until the frontier is
    empty. Output: ``url, depth, source`` (``seed``/``link``) and
    ``status``, one row per visited URL.

    With a page ``store`` (D2), a URL with a fresh, not stale-for-render
    entry is ``unchanged``, every other one ``new``. The reference returns
    on a store hit before following links (T7): ``expand_hits=False``
    reproduces that; the default also expands hits.

    Plan: link targets are rewritten, normalized and filtered ONCE (they do
    not depend on the level); each level is then frontier ⋈ edges →
    distinct → anti join visited. ``visited`` is kept hash-partitioned by
    ``url`` across levels (checkpoints keep their partitioning), so a level
    shuffles only its candidates."""
    spark = seeds.sparkSession
    if checkpoint:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)   # the cluster's shared folder (spark.checkpoint.dir)
    levels = _Levels(checkpoint)
    spread = (lambda df, key: df.repartition(num_partitions, key)) if num_partitions else (lambda df, key: df.repartition(key))
    if same_host and seed_host is None:
        # the seed host is taken BEFORE rewriting (T9); a seed list is small
        hosts = seeds.select(U.hostname("url").alias("h")).distinct().limit(2).collect()
        if len(hosts) != 1 or hosts[0].h is None:
            raise ValueError("same-host crawl needs exactly one seed host")
        seed_host = hosts[0].h
    U.validate_rules(rules)
    U.validate_deny(deny)

    link_keys = _visit_keys(edges.select("src_url", F.col("dst_url").alias("raw_url")),
                            rules, seed_host, allow, deny).select("src_url", "url").distinct()
    if pages is not None:                                    # C14: expand HTML pages with a body only
        expandable = pages.filter(F.col("content_type").isin("text/html", "application/xhtml+xml")
                                  & (F.octet_length("body") > 0)).select(F.col("url").alias("src_url"))
        link_keys = link_keys.join(expandable, "src_url", "left_semi")
    link_keys = levels.pin(spread(link_keys, "src_url"))

    hit_keys = None
    if store is not None:                                    # D2: fresh, usable store entries
        from . import store as ST
        when = now if now is not None else F.current_timestamp()
        latest = ST.latest_per_key(store, ["cached_at", "source"])
        hit_keys = latest.filter(ST.is_fresh(F.col("cached_at"), when, ttl_seconds)
                                 & ~ST.stale_for_render(F.col("source"), renderer_available)) \
            .select("cache_key", F.lit(True).alias("_hit"))
        hit_keys = levels.pin(spread(hit_keys, "cache_key"))   # computed once

    def with_status(df: DataFrame) -> DataFrame:
        if hit_keys is None:
            return df.withColumn("status", F.lit("new"))
        from ..functions.text import cache_key
        j = df.withColumn("cache_key", cache_key(F.col("url"))).join(hit_keys, "cache_key", "left")
        return j.withColumn("status", F.when(F.col("_hit"), F.lit("unchanged")).otherwise(F.lit("new"))) \
            .drop("cache_key", "_hit")

    def expandable_of(level_df: DataFrame) -> DataFrame:
        src = level_df if expand_hits else level_df.filter(F.col("status") == "new")
        return src.select(F.col("url").alias("src_url"))

    seed_rows = seeds.select(F.col("url").alias("raw_url"))
    level = with_status(_visit_keys(seed_rows, rules, seed_host, allow, deny).select("url").distinct()
                        .withColumn("depth", F.lit(0)).withColumn("source", F.lit("seed")))
    visited = level = levels.pin(spread(level, "url"))
    d = 0
    while max_depth <= 0 or d < max_depth:
        d += 1
        cand = (expandable_of(level)
                .join(link_keys, "src_url")                   # D7
                .select("url").distinct())
        # no forced partition count: the anti join is already hash-partitioned
        # on url, and AQE sizes (coalesces) its partitions to the level's data
        level = levels.pin(with_status(
            cand.join(visited.select("url"), "url", "left_anti")                     # D1
            .withColumn("depth", F.lit(d)).withColumn("source", F.lit("link"))))
        if level.isEmpty():
            break
        # levels are checkpointed leaves, so the union has a short lineage;
        # every few levels it is compacted back into one hash-partitioned,
        # checkpointed table so the anti join never scans levels x partitions
        visited = visited.unionByName(level)
        if checkpoint and d >= SHALLOW and (max_depth <= 0 or max_depth > d + SHALLOW):
            open_links = link_keys.join(visited.select("url"), "url", "left_anti")
            if not expand_hits:
                known = with_status(open_links.select(F.col("src_url").alias("url")).distinct())
                open_links = open_links.join(expandable_of(known), "src_url", "left_semi")
            deep = RE.depths(level.select("url", "depth"), levels.pin(open_links), levels.pin).where(F.col("depth") > d)
            if max_depth > 0:
                deep = deep.where(F.col("depth") <= max_depth)
            deep = with_status(deep.withColumn("depth", F.col("depth").cast("int")).withColumn("source", F.lit("link")))
            visited = visited.unionByName(levels.pin(deep))
            break
        if d % COMPACT_EVERY == 0:
            visited = levels.pin(spread(visited, "url"))
            levels.release()                                  # the checkpoints hold what later levels read
    levels.release()
    return visited


def crawl_summary(results: DataFrame, run_col: str = "run_id") -> DataFrame:
    """E5 (T10): per run, foreground ``pages`` (errors excluded) and
    background ``pages_all`` (errors included), new/changed/unchanged/error
    counts and duration in seconds."""
    err = F.col("error").isNotNull() & (F.col("error") != "")
    return results.groupBy(run_col).agg(
        (F.count("*") - F.count_if(err)).alias("pages"),
        F.count("*").alias("pages_all"),
        F.count_if(~err & (F.col("status") == "new")).alias("new"),
        F.count_if(~err & (F.col("status") == "changed")).alias("changed"),
        F.count_if(~err & (F.col("status") == "unchanged")).alias("unchanged"),
        F.count_if(err).alias("errors"),
        (F.unix_seconds(F.max("at").cast("timestamp")) - F.unix_seconds(F.min("at").cast("timestamp")))
        .alias("duration_s"),
    )


def write_run_status(summary: DataFrame, path: str, run_id: str) -> None:
    """B6 (batch): the status rows of one run replace its previous ones
    (``path/run_id=<id>``, overwritten at every refresh)."""
    summary.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def host_shell_ratio(fetches: DataFrame) -> DataFrame:
    """Per host, HTML fetches and how many were shells."""
    return fetches.groupBy("host").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("js_detection") == "likely_shell").alias("shells"),
    )


def force_render_history(arrivals: DataFrame, bucket_col: str = "bucket") -> DataFrame:
    """Before each arrival, has its host ≥ 10 classified pages with
    > 80 % shells? A parallel prefix sum, so one hot host is not one task:

    1. per (host, bucket) counts (partial aggregation);
    2. per host, exclusive running totals over its buckets (few rows);
    3. within (host, bucket), running counts of the earlier rows + offset.

    Input: ``host, bucket, at, seq, is_shell`` (``bucket`` any coarse,
    order-preserving key such as the hour of ``at``)."""
    per_bucket = arrivals.groupBy("host", bucket_col).agg(
        F.count("*").alias("_n"), F.count_if("is_shell").alias("_s"))
    wb = Window.partitionBy("host").orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "host", bucket_col,
        F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(wb), F.lit(0)).alias("_s0"))
    wr = Window.partitionBy("host", bucket_col).orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    run = arrivals.select(
        "*",
        F.coalesce(F.count("*").over(wr), F.lit(0)).alias("_nb"),
        F.coalesce(F.sum(F.col("is_shell").cast("int")).over(wr), F.lit(0)).alias("_sb"),
    )
    j = run.join(offsets, ["host", bucket_col])
    total = (F.col("_n0") + F.col("_nb")).cast("long")
    shells = (F.col("_s0") + F.col("_sb")).cast("long")
    force = (total >= FORCE_RENDER_MIN_PAGES) & (shells.cast("double") / F.greatest(total, F.lit(1))
                                                 > FORCE_RENDER_SHELL_RATIO)
    return (j.withColumn("prior_total", total).withColumn("prior_shells", shells)
            .withColumn("force_render", force).drop("_n0", "_s0", "_nb", "_sb"))


def cap_pages(results: DataFrame, max_pages: int = 30) -> tuple[DataFrame, str | None]:
    """Bounded crawl output. Errors do not count; the first
    ``max_pages`` pages by (depth, url) are kept (default 30; the limit is
    the feature). Returns (pages, stopped) with ``stopped = 'max_pages'``
    when cut."""
    n = max_pages if max_pages > 0 else 30
    ok = results.filter(F.col("error").isNull() | (F.col("error") == ""))
    ordered = ok.orderBy("depth", "url")
    kept = ordered.limit(n)                                   # top-k, not a sort of everything
    stopped = "max_pages" if ordered.limit(n + 1).count() > n else None
    return kept, stopped


def list_runs(runs: DataFrame) -> DataFrame:
    """G7 (T11): runs newest first."""
    return runs.orderBy(F.desc("started_at"), F.asc("id"))


def to_json_lines(results: DataFrame, path: str) -> None:
    """B1: ``url, title, words, status, source, body`` as JSON lines; NULL
    fields are omitted like the reference's omitempty."""
    results.select("url", "title", "words", "status", "source", "body").write.mode("overwrite") \
        .option("ignoreNullFields", "true").json(path)


def to_tsv(df: DataFrame, cols: Sequence[str], path: str) -> None:
    """B2: unquoted tab-separated rows (the CSV writer would quote)."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
              .alias("value")).write.mode("overwrite").text(path)
