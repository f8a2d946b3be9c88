"""Federated ranking (§2.5-2.8): Reciprocal Rank Fusion over ranked lists.

Input schema (``search_results``)::

    query_id STRING, backend STRING, backend_ord INT, rank INT,
    title STRING, url STRING, description STRING, content STRING

Plan shape: the per-backend depth cut (G3) runs map-side, then ONE shuffle
on ``query_id``. Every later step (one term per backend, per-document
aggregates, tie groups, the total order and the cut) needs a clustering
that ``query_id`` already satisfies, so Spark inserts no further exchange.
A query's rows are bounded by ``n_backends × depth`` (depth ≤ 20), so a
single hot query cannot grow a task: the group size does not scale with
the table, only the number of queries does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url

# Fixed values of the fusion contract.
RRF_K = 60
FETCH_FLOOR = 10
FETCH_CAP = 20
SCORE_EPSILON = 1e-9
# Scores are summed as exact integers of 1e-18 units: Σ floor(1e18/(k+rank)).
# Integer sums do not depend on shuffle order (float sums do, T1), and a
# truncation error of < 1e-18 per term is far below the 1e-9 tie epsilon.
SCORE_UNIT = 10 ** 18
EPS_UNITS = int(SCORE_EPSILON * SCORE_UNIT)


def fetch_depth(limit: int) -> int:
    """Per-backend fetch depth = clamp(limit, 10, 20)."""
    return min(max(limit, FETCH_FLOOR), FETCH_CAP)


def rank_lists(df: DataFrame, order_col: str = "pos") -> DataFrame:
    """rank = position + 1 within each (query, backend) list."""
    w = Window.partitionBy("query_id", "backend_ord").orderBy(order_col)
    return df.withColumn("rank", F.row_number().over(w).cast("int"))


def _entries(lists: DataFrame) -> DataFrame:
    """One term per backend per document, the first (best) occurrence."""
    best = F.min_by(
        F.struct("rank", "title", "url", "description", "content"), F.col("rank")
    )
    return (
        lists.groupBy("query_id", "key", "backend_ord", "backend")
        .agg(best.alias("e"))
        .select("query_id", "key", "backend_ord", "backend", "e.*")
    )


def _nonempty_first(c: str, order: Column) -> Column:
    # First non-empty value in (rank, backend order); NULL and '' alike.
    return F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order))


def rrf_fuse(lists: DataFrame, limit: int = 0, k: int = RRF_K,
             depth: int | None = None, partition_by_query: bool = True) -> DataFrame:
    """M1 core: C1 → E1-E4 → W3 → G1 → G2.

    ``limit`` ≤ 0 keeps everything; ``depth`` defaults to ``fetch_depth(limit)``.
    Output: ``query_id, fused_rank, key, url, title, description, content,
    backends ARRAY<STRING>, n_backends, best_rank, score``.
    """
    depth = fetch_depth(limit) if depth is None else depth
    cut = lists.filter(F.col("rank") <= F.lit(depth))          # G3, map side
    keyed = cut.select(
        "query_id", "backend", F.col("backend_ord").cast("int").alias("backend_ord"),
        F.col("rank").cast("int").alias("rank"), "title", "url",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("content", F.lit("")).alias("content"),
        canonical_url("url").alias("key"),
    )
    if partition_by_query:
        keyed = keyed.repartition("query_id")                    # the only shuffle
    ent = _entries(keyed)
    order = F.struct("rank", "backend_ord")
    docs = ent.groupBy("query_id", "key").agg(
        F.sum(F.expr(f"{SCORE_UNIT}L div ({int(k)} + rank)")).cast("long").alias("score_units"),
        F.min_by(F.struct("url", "title"), order).alias("rep"),
        _nonempty_first("description", order).alias("description"),
        _nonempty_first("content", order).alias("content"),
        F.array_sort(F.collect_set("backend")).alias("backends"),
        F.min("rank").alias("best_rank"),
    )
    docs = docs.withColumn("n_backends", F.size("backends").cast("long"))
    wq = Window.partitionBy("query_id").orderBy(F.desc("score_units"), F.desc("n_backends"),
                                                 F.asc("best_rank"), F.asc("key"))
    # Gaps and islands over adjacent scores; a gap > epsilon starts a group.
    gap = (F.lag("score_units").over(wq) - F.col("score_units")) > F.lit(EPS_UNITS)
    grouped = docs.withColumn("new_group", F.coalesce(gap, F.lit(False)).cast("int"))
    grouped = grouped.withColumn(
        "tie_group", F.sum("new_group").over(wq.rowsBetween(Window.unboundedPreceding, 0)))
    w2 = Window.partitionBy("query_id").orderBy(F.asc("tie_group"), F.desc("n_backends"),
                                                 F.asc("best_rank"), F.asc("key"))
    ranked = grouped.withColumn("fused_rank", F.row_number().over(w2).cast("int"))
    if limit > 0:
        ranked = ranked.filter(F.col("fused_rank") <= limit)   # G2 after fusion
    return ranked.select(
        "query_id", "fused_rank", "key",
        F.col("rep.url").alias("url"), F.col("rep.title").alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("content", F.lit("")).alias("content"),
        "backends", "n_backends", F.col("best_rank").cast("int").alias("best_rank"),
        (F.col("score_units").cast("double") / F.lit(float(SCORE_UNIT))).alias("score"),
    )


def select_backends(lists: DataFrame, names: list[str], registry: list[str]) -> DataFrame:
    """Trimmed, first-occurrence-deduplicated backend names; ``all``
    alone means the whole registry in registry order; mixing is an error.
    Returns the lists of the chosen backends with ``backend_ord`` set to the
    requested order (the registry is a small fixed list: a literal map)."""
    cleaned: list[str] = []
    for n in names:
        n = n.strip()
        if n and n not in cleaned:
            cleaned.append(n)
    if "all" in cleaned:
        if len(cleaned) > 1:
            raise ValueError("'all' cannot be combined with backend names")
        cleaned = list(registry)
    unknown = [n for n in cleaned if n not in registry]
    if unknown:
        raise ValueError(f"unknown backend(s): {', '.join(unknown)}")
    ords = F.create_map(*[x for i, n in enumerate(cleaned) for x in (F.lit(n), F.lit(i))])
    return (lists.filter(F.col("backend").isin(*cleaned))
            .withColumn("backend_ord", ords[F.col("backend")].cast("int")))


def failure_map(outcomes: DataFrame) -> DataFrame:
    """E15 + H5: per query, ``errors MAP<backend, error>`` of the failed
    backends, ``succeeded`` = resolved − failed, and ``all_failed`` (the
    whole query fails only when every backend failed; zero results is
    success). Input: ``query_id, backend, backend_ord, ok, error``."""
    failed = F.when(~F.col("ok"), F.struct("backend", "error"))
    return outcomes.groupBy("query_id").agg(
        F.map_from_entries(F.filter(F.collect_list(failed), lambda x: x.isNotNull())).alias("errors"),
        F.array_except(
            F.transform(F.array_sort(F.collect_list(F.struct("backend_ord", "backend"))), lambda x: x["backend"]),
            F.collect_list(F.when(~F.col("ok"), F.col("backend"))),
        ).alias("succeeded"),
        F.bool_and(~F.col("ok")).alias("all_failed"),
        F.count_if(~F.col("ok")).alias("n_failed"),
    )


def multi_search(lists: DataFrame, outcomes: DataFrame | None = None, limit: int = 0,
                 k: int = RRF_K) -> DataFrame:
    """M1: union of succeeded lists (H1) fused with RRF. When ``outcomes``
    is given, lists of failed backends are dropped by a semi join on
    (query_id, backend) — the outcome table is one row per attempt."""
    if outcomes is not None:
        ok = outcomes.filter("ok").select("query_id", "backend")
        lists = lists.join(ok, ["query_id", "backend"], "left_semi")
    return rrf_fuse(lists, limit=limit, k=k)


def random_fallback(outcomes: DataFrame, seed: int = 0) -> DataFrame:
    """Per query, shuffle the backends (seeded, repeatable, by a
    SHA-256 key), take the first that succeeded, and report the failures
    tried before it.

    Output: ``query_id, chosen, tried ARRAY<STRING>, failures ARRAY<STRUCT>``
    (``chosen`` NULL when all failed)."""
    # a seeded, engine-independent shuffle key: SHA-256 of (query, backend, seed)
    order = F.sha2(F.concat_ws("|", F.col("query_id"), F.col("backend"), F.lit(str(seed))), 256)
    w = Window.partitionBy("query_id").orderBy(order, "backend")
    pos = outcomes.withColumn("try_pos", F.row_number().over(w))
    first_ok = F.min(F.when(F.col("ok"), F.col("try_pos")))
    wq = Window.partitionBy("query_id")
    pos = pos.withColumn("first_ok", first_ok.over(wq))
    tried = F.col("first_ok").isNull() | (F.col("try_pos") < F.col("first_ok"))
    return pos.groupBy("query_id").agg(
        F.max_by(F.when(F.col("try_pos") == F.col("first_ok"), F.col("backend")),
                 F.when(F.col("try_pos") == F.col("first_ok"), F.lit(1))).alias("chosen"),
        F.transform(
            F.array_sort(F.collect_list(F.when(tried & ~F.col("ok"), F.struct("try_pos", "backend", "error")))),
            lambda x: F.struct(x["backend"].alias("backend"), x["error"].alias("error")),
        ).alias("failures"),
    )
