"""Page store (§2.2 B4/B7, §2.4 D2/D10, C11-C13, E14, W5).

The reference keeps pages in a key-value file keyed by a URL hash with a
TTL. Here the store is a Parquet table of versions::

    cache_key STRING, cached_at TIMESTAMP, source STRING,
    url STRING, fetched_url STRING, title STRING, markdown STRING,
    etag STRING, last_modified STRING, content_hash STRING, raw_html STRING

Lookups are equi joins on ``cache_key`` (a sort-merge join at scale; the
request side is usually the smaller one and is broadcast only when Spark's
size estimate is under the broadcast threshold). Upserts write a NEW
version directory (never overwrite the table being read) holding the
latest row per key. A commit log (``commits``) numbers versions and stream
deltas alike, so of equal times the later write wins whatever wrote it, and a
version or a compaction retires the deltas that it has taken in.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits as C
from ..functions.text import cache_key

SOURCES = ("http", "http_shell", "browser", "")
DEFAULT_TTL_SECONDS = 72 * 3600
WRITE_ORD = "write_ord"  # a row's commit number (null: that of its file's commit); never part of a result


def is_fresh(cached_at: Column, now: Column, ttl_seconds: int) -> Column:
    """¬I16: age ≤ TTL (strictly older is expired)."""
    return ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(cached_at.cast("timestamp")))
            <= F.lit(int(ttl_seconds) * 1_000_000))


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch, independent of the session time zone:
    a zone-less timestamp is read as UTC wall time, a zoned one is already
    an instant."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col))


def stale_for_render(source: Column, renderer_available: bool) -> Column:
    """C11: ``http_shell`` is always stale; a blank (legacy) source is stale
    only when a renderer exists."""
    s = F.coalesce(source, F.lit(""))
    return (s == "http_shell") | (F.lit(renderer_available) & (s == ""))


def latest_per_key(store: DataFrame, columns: Sequence[str] | None = None, keep_order: bool = False) -> DataFrame:
    """The latest version of every key; of equal times the later write
    (``write_ord``, where there is one), then the larger source name, then
    the larger content, so the result does not depend on row order.

    A ``max_by`` aggregate rather than a ``row_number`` window: the partial
    aggregation keeps one candidate per key per map task before the shuffle,
    so a key holding a third of all versions does not become one task sorting
    a third of the table. ``columns`` is projected before the aggregate: a
    status check neither reads nor shuffles page contents."""
    cols = [c for c in (columns or store.columns) if c not in ("cache_key", WRITE_ORD)]
    ranked = WRITE_ORD in store.columns
    # a row without a number is being written now: later than all
    rank = ["cached_at"] + [F.coalesce(WRITE_ORD, F.lit(2 ** 63 - 1)).alias("_o")] * ranked
    order = F.struct(*rank, F.coalesce("source", F.lit("")).alias("_s"), *[c for c in cols if c not in ("cached_at", "source")])
    cols = cols + [WRITE_ORD] * (keep_order and ranked)
    best = F.max_by(F.struct(*cols), order)
    return store.groupBy("cache_key").agg(best.alias("_v")).select("cache_key", *[F.col(f"_v.{c}").alias(c)
                                                                                  for c in cols])


def lookup(requests: DataFrame, store: DataFrame, now: Column, ttl_seconds: int = DEFAULT_TTL_SECONDS,
           renderer_available: bool = False, want_raw: bool = False, force_render: bool = False,
           url_col: str = "url") -> DataFrame:
    """D2 (+C12, C13): requests ⟕ store on the URL's key. ``hit`` when the
    entry is fresh and not stale-for-render; a raw request also needs raw
    HTML (C12); a forced-render request only accepts ``browser`` entries
    (C13). Misses are ``hit = false`` rows (split with a filter)."""
    req = requests.withColumn("cache_key", cache_key(F.col(url_col)))
    st = store.select("cache_key", "cached_at", "source", "title", "markdown", "content_hash",
                      *(["raw_html"] if want_raw else []))
    j = req.join(st, "cache_key", "left")
    hit = (F.col("cached_at").isNotNull() & is_fresh(F.col("cached_at"), now, ttl_seconds)
           & ~stale_for_render(F.col("source"), renderer_available))
    if want_raw:
        hit = hit & F.coalesce(F.col("raw_html") != "", F.lit(False))
    if force_render:
        hit = hit & (F.col("source") == "browser")
    return j.withColumn("hit", hit)


def upsert(store: DataFrame | None, rows: DataFrame, keep_raw: bool = True, keep_order: bool = False) -> DataFrame:
    """Old and new rows, the latest per key; a new row wins over an old
    one of the same time. A markdown-only write (``keep_raw=False``) stores
    no raw HTML. The caller writes the result to a new version directory
    (``write_version``; ``upsert_store`` does both)."""
    new = rows if keep_raw else rows.withColumn("raw_html", F.lit(None).cast("string"))
    if store is None:
        return latest_per_key(new)
    old = store if WRITE_ORD in store.columns else store.withColumn(WRITE_ORD, F.lit(0).cast("long"))
    both = old.unionByName(new.withColumn(WRITE_ORD, F.lit(None).cast("long")), allowMissingColumns=True)
    return latest_per_key(both, keep_order=keep_order)


def write_version(df: DataFrame, root: str, version: int | None = None, fmt: str = "parquet", as_of: int | None = None) -> str:
    """Write a store version under ``root/v=<n>`` (the next number unless one is
    given) and commit it; readers keep reading the previous one until then.
    ``as_of`` is the commit that ``df`` was read at: the version retires what was
    committed up to it. Without one, what is committed when the call begins. ``fmt``
    is the pluggable storage format (L3): any Spark data source."""
    spark, log = df.sparkSession, C.entries(df.sparkSession, root)
    if as_of is None:
        as_of = max((e["n"] for e in log), default=0)
    if version is None:
        version = max((e["version"] for e in log if e["kind"] == "version"), default=0) + 1
    name = f"v={int(version)}"
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").format(fmt).save(path)
    C.commit(spark, root, {"kind": "version", "path": name, "version": int(version), "upto": as_of})
    return path


def write_delta(rows: DataFrame, root: str, name: str | None = None, token: str | None = None, fmt: str = "parquet") -> bool:
    """K5: commit rows, one per key, on top of what is there. A ``token``
    that is committed already writes nothing (and gives False)."""
    spark, log = rows.sparkSession, C.entries(rows.sparkSession, root)
    if token is not None and any(e.get("token") == token for e in log):
        return False
    folder = f"batch={name or uuid.uuid4().hex}"
    rows.write.mode("overwrite").format(fmt).save(f"{root.rstrip('/')}/{folder}")
    C.commit(spark, root, {"kind": "delta", "path": folder, "token": token})
    return True


def read_store(spark: SparkSession, root: str, version: int | None = None, fmt: str = "parquet", as_of: int | None = None,
               keep_order: bool = False) -> DataFrame:
    """The store as of its newest commit (or ``as_of``): the newest version
    and the deltas it doesn't stand for, the latest row per key; with ``version``,
    that version alone. Lookups then filter or join on ``cache_key`` and push
    the predicate into the scan. With ``keep_order`` rows carry their commit number."""
    log = C.entries(spark, root)

    def load(entry: dict) -> DataFrame:
        df = spark.read.format(fmt).load(f"{root.rstrip('/')}/{entry['path']}")
        own = F.lit(entry["n"]).cast("long")
        return df.withColumn(WRITE_ORD, F.coalesce(WRITE_ORD, own) if WRITE_ORD in df.columns else own)

    if version is not None:
        one = [e for e in log if e["kind"] == "version" and e["version"] == int(version)]
        if not one:
            raise ValueError(f"the store has no version {version}")
        return load(one[-1]).drop(WRITE_ORD)
    base, deltas = C.live(log, as_of)
    parts = ([load(base)] if base else []) + [load(e) for e in deltas]
    if not parts:
        return empty_store(spark)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    if deltas:
        both = latest_per_key(both, keep_order=True)
    return both if keep_order else both.drop(WRITE_ORD)


def upsert_store(rows: DataFrame, root: str, keep_raw: bool = True) -> str:
    """B4 as one step: read the store, take the rows in, commit a new version.
    Deltas committed meanwhile stay on top of what was read."""
    spark = rows.sparkSession
    seen = C.last(spark, root)
    old = read_store(spark, root, as_of=seen, keep_order=True) if seen else None
    return write_version(upsert(old, rows, keep_raw, keep_order=True), root, as_of=seen)


def compact(spark: SparkSession, root: str) -> str | None:
    """Merge the live deltas into a new version, which retires them; rows keep
    their commit numbers. None where there is nothing to merge."""
    seen = C.last(spark, root)
    if not C.live(C.entries(spark, root), seen)[1]:
        return None
    return write_version(read_store(spark, root, as_of=seen, keep_order=True), root, as_of=seen)


def expire(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders of commits that the newest version has retired;
    their names. For when no reader uses an older version."""
    log = C.entries(spark, root)
    base, deltas = C.live(log)
    if base is None:
        return []
    kept = {base["path"], *(e["path"] for e in deltas)}
    gone = sorted({e["path"] for e in log if e["n"] < base["n"]} - kept)
    C.remove(spark, root, gone)
    return gone


def store_stats(store: DataFrame) -> DataFrame:
    """Entries and bytes (of the page JSON-ish payload + raw HTML)."""
    size = (F.coalesce(F.octet_length("markdown"), F.lit(0)) + F.coalesce(F.octet_length("title"), F.lit(0))
            + F.coalesce(F.octet_length("raw_html"), F.lit(0)))
    return store.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def detect_changes(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """New / changed / unchanged (and removed) between two snapshots by
    content hash; etag equality is null-safe. Full outer join on the key."""
    o = old.select(F.col(key).alias("_k"), F.col("content_hash").alias("old_hash"),
                   (F.col("etag") if "etag" in old.columns else F.lit(None).cast("string")).alias("old_etag"))
    n = new.select(F.col(key).alias("_k"), F.col("content_hash").alias("new_hash"),
                   (F.col("etag") if "etag" in new.columns else F.lit(None).cast("string")).alias("new_etag"))
    j = o.join(n, "_k", "full_outer")
    status = (F.when(F.col("old_hash").isNull() & F.col("new_hash").isNotNull(), "new")
              .when(F.col("new_hash").isNull(), "removed")
              .when((F.col("old_hash") == F.col("new_hash")), "unchanged")
              .otherwise("changed"))
    return j.select(F.col("_k").alias(key), status.alias("status"), "old_hash", "new_hash",
                    F.col("old_etag").eqNullSafe(F.col("new_etag")).alias("etag_same"))


def raw_output(pages: DataFrame, max_chars: int = 0) -> DataFrame:
    """``url, fetched_url, title, source, raw_html``; HTML cut to N
    code points; non-HTML pages carry no raw HTML."""
    from ..functions.text import truncate
    raw = F.when(F.coalesce(F.col("is_html"), F.lit(True)), truncate(F.col("raw_html"), max_chars))
    return pages.select("url", "fetched_url", "title", "source", raw.alias("raw_html"))


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], (
        "cache_key STRING, cached_at TIMESTAMP, source STRING, url STRING, fetched_url STRING, "
        "title STRING, markdown STRING, etag STRING, last_modified STRING, content_hash STRING, raw_html STRING"))
