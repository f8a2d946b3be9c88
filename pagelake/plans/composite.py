"""Composite jobs (M3, M4, M6) built from the operators: one lazy plan each.

* ``search_and_scrape`` (M3): fused results (M1) ⟕ refined pages on the
  rewritten URL (D3), post-processed (I3).
* ``scrape_batch`` (M4): URL list → rewrite (C4) → store key (I7) → store
  lookup (D2) → misses ⟕ snapshots → ``llms.txt`` shortcut for bare
  domains (D8) → refinement (J13) → new store rows (B4); errors are rows;
  input order kept (G8).
* ``crawl_snapshots`` (M5): sitemap or seeds → each snapshot parsed once for
  page and links → levels (``operators.crawl``) → store → one row per address.
* ``extract_html`` (M6): selector extraction (J4) or refinement, after
  input validation (C21).
"""

from __future__ import annotations

import uuid
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import cache_key, content_hash, post_process
from ..operators import extract as X
from ..operators import nodes as N
from ..operators import shell as SH
from ..operators import store as ST
from ..session import ensure_checkpoint_dir


def enrich_results(results: DataFrame, pages: DataFrame, rules: Sequence[tuple[str, str]] = (),
                   keep_missing: bool = True, trim: bool = False, max_chars: int = 0) -> DataFrame:
    """D3: attach page content to search results by the rewritten URL. A
    result without a page survives when ``keep_missing`` (structured
    output) and is dropped otherwise (text output)."""
    r = results.withColumn("_fetch", U.rewrite_url(F.col("url"), rules) if rules else F.col("url"))
    p = pages.select(F.col("url").alias("_fetch"), F.col("title").alias("page_title"),
                     post_process(F.col("markdown"), trim, max_chars).alias("page_content"))
    j = r.join(p, "_fetch", "left" if keep_missing else "inner")
    return j.drop("_fetch")


def search_and_scrape(lists: DataFrame, pages_refined: DataFrame, limit: int = 5,
                      rules: Sequence[tuple[str, str]] = (), keep_missing: bool = True,
                      trim: bool = False, max_chars: int = 0) -> DataFrame:
    """M3 = M1 → D3 → I3."""
    from ..operators.fuse import rrf_fuse
    return enrich_results(rrf_fuse(lists, limit=limit), pages_refined, rules, keep_missing, trim, max_chars)


def _llms_candidates(urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Bare-domain URLs whose ``scheme://host/llms.txt`` snapshot is a
    200 ``text/plain`` body."""
    p = U.url_parts(F.col("fetch_url"))
    bare = urls.filter(U.is_bare_domain(F.col("fetch_url"))).select(
        "input_pos", F.concat(p["scheme"], F.lit("://"), p["authority"], F.lit("/llms.txt")).alias("_llms"))
    s = snapshots.filter((F.col("status") == 200) & F.col("content_type").contains("text/plain")).select(
        F.col("url").alias("_llms"), F.col("body").cast("string").alias("llms_body"))
    return bare.join(s, "_llms").select("input_pos", "llms_body")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """One snapshot per URL: the last fetched that is not a 304 (whose page is
    the one before); ``not_modified`` tells that a 304 came after it, and a
    URL of 304s alone keeps one."""
    if "fetched_at" not in snapshots.columns:
        snapshots = snapshots.withColumn("fetched_at", F.lit(None).cast("timestamp"))
    later = F.struct((F.col("status") != 304).alias("a"), "fetched_at", F.col("status").alias("b"), F.xxhash64("body").alias("c"))
    cols = ["status", "content_type", "body", "error", "error_kind"]
    return (snapshots.groupBy("url").agg(
        F.max_by(F.struct(*cols), later).alias("s"),
        (F.max_by(F.col("status") == 304, F.struct("fetched_at", (F.col("status") == 304).alias("n")))).alias("not_modified"))
        .select("url", *[F.col(f"s.{c}").alias(c) for c in cols], "not_modified"))


def scrape_batch(urls: DataFrame, snapshots: DataFrame, store: DataFrame | None, now: Column,
                 ttl_seconds: int = ST.DEFAULT_TTL_SECONDS, rules: Sequence[tuple[str, str]] = (),
                 renderer_available: bool = False, use_llms_txt: bool = True,
                 trim: bool = False, max_chars: int = 0,
                 converter: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """M4 over tables. ``urls``: ``input_pos, url``; ``snapshots``: A3 rows.
    Returns (results, store_delta): results ``input_pos, url, fetched_url,
    title, markdown, source, content_hash, from_store, error, error_kind``
    in input order; store_delta are the rows to upsert (B4).

    ``converter`` (L2) turns non-HTML documents (e.g. PDF) into text: it
    receives ``input_pos, fetch_url, ctype, html`` rows and returns
    ``input_pos, title, markdown`` (a ``mapInPandas`` or Pandas UDF of the
    caller's choice). Without one, PDF rows are ``precondition`` errors."""
    snapshots = latest_snapshots(snapshots)
    u = urls.select("input_pos", "url").withColumn(
        "fetch_url", U.rewrite_url(F.col("url"), rules) if rules else F.col("url"))
    u = u.withColumn("cache_key", cache_key(F.col("fetch_url")))
    if store is not None:
        st = ST.latest_per_key(store, ["cached_at", "source", "title", "markdown"])
        looked = u.join(st, "cache_key", "left")
        hit = (F.col("cached_at").isNotNull() & ST.is_fresh(F.col("cached_at"), now, ttl_seconds)
               & ~ST.stale_for_render(F.col("source"), renderer_available))
        # a page that its server calls unchanged is the stored one, however old
        same = snapshots.where(F.col("not_modified")).select(F.col("url").alias("fetch_url"), F.lit(True).alias("_same"))
        kept = F.col("cached_at").isNotNull() & F.col("_same") & ~ST.stale_for_render(F.col("source"), renderer_available)
        looked = looked.join(same, "fetch_url", "left").withColumn(
            "hit", F.coalesce(hit, F.lit(False)) | F.coalesce(kept, F.lit(False))).drop("_same")
    else:
        looked = u.select("*", F.lit(None).cast("timestamp").alias("cached_at"),
                          F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("title"),
                          F.lit(None).cast("string").alias("markdown"), F.lit(False).alias("hit"))
    hits = looked.filter("hit").select(
        "input_pos", "url", "fetch_url", "title", "markdown", "source", F.lit(True).alias("from_store"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_kind"))
    misses = looked.filter(~F.col("hit")).select("input_pos", "url", "fetch_url", "cache_key")

    if use_llms_txt:
        llms = _llms_candidates(misses, snapshots)
        misses = misses.join(llms, "input_pos", "left")
    else:
        misses = misses.withColumn("llms_body", F.lit(None).cast("string"))
    snap = snapshots.select(F.col("url").alias("fetch_url"), "status", "content_type",
                            F.col("body").cast("string").alias("html"), "error", "error_kind")
    fetched = misses.join(snap, "fetch_url", "left")
    ctype = X.content_type(F.col("content_type"), F.col("html").cast("binary"))
    fetched = fetched.withColumn("ctype", ctype)
    err = (F.when(F.col("llms_body").isNotNull(), F.lit(None))
           .when(F.col("status").isNull(), F.lit("no snapshot for URL"))
           .when(F.col("status") == 304, F.lit("not modified, and no page stored"))
           .when(F.col("error").isNotNull(), F.col("error"))
           .when((F.col("ctype") == "application/pdf") & F.lit(converter is None),
                 F.lit("PDF needs a document converter"))
           .when(~X.is_html_type(F.col("ctype")) & ~F.col("ctype").startswith("text/")
                 & ~((F.col("ctype") == "application/pdf") & F.lit(converter is not None)),
                 F.concat(F.lit("unsupported content type "), F.col("ctype"))))
    kind = (F.when(err.isNull(), F.lit(None))
            .when(F.col("status").isNull() | (F.col("status") == 304), F.lit("not_found"))
            .when(F.col("error_kind").isNotNull(), F.col("error_kind"))
            .when(F.col("ctype") == "application/pdf", F.lit("precondition"))
            .otherwise(F.lit("validation")))
    fetched = fetched.withColumn("err", err).withColumn("kind", kind)

    html_rows = fetched.filter(F.col("err").isNull() & F.col("llms_body").isNull() & X.is_html_type(F.col("ctype")))
    # one pass over each page gives its title, markdown and shell signals
    marked = html_rows.select("input_pos", "html", SH.markers().alias("_marks"))
    seen = N.parse_fold(marked, lambda page: X.refined(page) + SH.signals(page), f"{X.REFINED}, {SH.SIGNALS}")
    html_out = seen.select("input_pos", "title", "markdown", SH.fetch_source(SH.verdict("_marks"), renderer_available).alias("source"))
    if converter is not None:
        docs = fetched.filter(F.col("err").isNull() & F.col("llms_body").isNull() & (F.col("ctype") == "application/pdf"))
        converted = converter(docs.select("input_pos", "fetch_url", "ctype", "html")).select(
            "input_pos", "title", "markdown", F.lit("http").alias("source"))
    text_out = fetched.filter(F.col("err").isNull() & (F.col("ctype") != "application/pdf")
                              & (F.col("llms_body").isNotNull() | ~X.is_html_type(F.col("ctype")))).select(
        "input_pos",
        F.when(F.col("llms_body").isNotNull(), F.lit("llms.txt")).otherwise(F.lit("")).alias("title"),
        F.coalesce("llms_body", "html").alias("markdown"), F.lit("http").alias("source"))
    content = html_out.unionByName(text_out)
    if converter is not None:
        content = content.unionByName(converted)
    base = fetched.select("input_pos", "url", "fetch_url", "cache_key", F.col("err").alias("error"),
                          F.col("kind").alias("error_kind"))
    fresh = base.join(content, "input_pos", "left").withColumn("from_store", F.lit(False))
    delta = fresh.filter(F.col("error").isNull()).select(
        "cache_key", now.cast("timestamp").alias("cached_at"), "source", F.col("fetch_url").alias("url"),
        F.when(F.col("fetch_url") != F.col("url"), F.col("fetch_url")).alias("fetched_url"), "title", "markdown",
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        content_hash(F.col("markdown")).alias("content_hash"), F.lit(None).cast("string").alias("raw_html"))
    out = hits.unionByName(fresh.drop("cache_key"))
    results = out.select(
        "input_pos", "url", U.fetched_url(F.col("url"), F.col("fetch_url")).alias("fetched_url"),
        "title", post_process(F.col("markdown"), trim, max_chars).alias("markdown"), "source",
        content_hash(F.col("markdown")).alias("content_hash"), "from_store", "error", "error_kind")
    return results, delta


def crawl_snapshots(seeds: DataFrame, snapshots: DataFrame, max_depth: int = 3, allow: Sequence[str] = (), deny: Sequence[str] = (),
                    rules: Sequence[tuple[str, str]] = (), sitemap: bool = False, store: DataFrame | None = None, now: Column | None = None,
                    ttl_seconds: int = ST.DEFAULT_TTL_SECONDS, renderer_available: bool = False, expand_hits: bool = True) -> DataFrame:
    """M5 over snapshots (A3 rows): a row per visited address: ``url, depth,
    source`` (``seed``, ``sitemap`` or ``link``), ``status`` (``new``, ``changed``,
    ``unchanged``), ``title, markdown, content_hash, fetch_source, error,
    error_kind``. ``seeds`` (``url``) are pages, or with ``sitemap`` sitemaps,
    whose pages are then level 0.

    Snapshots outside of the crawl's host and patterns are dropped by their
    address; each of the others is parsed ONCE, in the pass that reads it, for its
    page (J13) and its links (J3), and what is needed of it is written; levels then
    join narrow edges only. A page without a snapshot, with an error status or of
    a type that isn't a page is an error row. With a ``store`` (D2), a fresh
    entry is ``unchanged`` and keeps its content; a page that was stored with another
    content hash is ``changed`` (T8), with the same ``unchanged``. A snapshot of 304
    leaves the stored page (``unchanged``), however old."""
    from ..operators import crawl as CR
    from ..sources.sitemap import read_sitemap

    spark = seeds.sparkSession
    if sitemap:
        hosts = [r.h for r in seeds.select(U.hostname("url").alias("h")).distinct().limit(2).collect()]
        starts = read_sitemap(snapshots, seeds).select("url").distinct()
    else:
        hosts, starts = [r.h for r in seeds.select(U.hostname("url").alias("h")).distinct().limit(2).collect()], seeds.select("url")
    if len(hosts) != 1 or hosts[0] is None:
        raise ValueError("a crawl needs seeds of one host")
    U.validate_rules(rules)
    U.validate_deny(deny)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    # addresses first: narrow rows, written so that their keys are computed once
    keys = kept(snapshots.select("url").distinct().withColumn("key", U.normalize_url(F.col("url"))), "keys")
    keys = keys.where(U.passes_filters(F.col("key"), hosts[0], allow, deny))
    snap = latest_snapshots(snapshots.join(keys, "url").drop("url").withColumnRenamed("key", "url")).withColumn("html", F.col("body").cast("string")).drop("body")
    ctype = X.content_type(F.col("content_type"), F.col("html").cast("binary"))
    snap = snap.withColumn("ctype", ctype)
    bad = (F.when(F.col("status") == 304, F.lit("not modified, and no page stored")).when(F.col("error").isNotNull(), F.col("error"))
           .when(F.col("ctype") == "application/pdf", F.lit("PDF needs a document converter"))
           .when(~X.is_html_type(F.col("ctype")) & ~F.col("ctype").startswith("text/"), F.concat(F.lit("unsupported content type "), F.col("ctype"))))
    kind = (F.when(F.col("status") == 304, F.lit("not_found")).when(F.col("error").isNotNull(), F.col("error_kind"))
            .when(F.col("ctype") == "application/pdf", F.lit("precondition")).when(F.col("_bad").isNotNull(), F.lit("validation")))
    snap = snap.withColumn("_bad", bad).select(
        "url", "not_modified", F.col("_bad").alias("error"), kind.alias("error_kind"), SH.markers().alias("_marks"),
        (F.col("_bad").isNull() & X.is_html_type(F.col("ctype"))).alias("is_html"), "html")

    def page(p: N.Page) -> tuple:
        links = [p.attrs[i]["href"] for i, tag in enumerate(p.tag) if tag == "a" and "href" in p.attrs[i]]
        return X.refined(p) + SH.signals(p) + (links,)

    parsed = N.parse_fold(snap.where("is_html"), page, f"{X.REFINED}, {SH.SIGNALS}, links ARRAY<STRING>")
    parsed = parsed.select("url", "not_modified", "error", "error_kind", "title", "markdown", "links",
                           SH.fetch_source(SH.verdict("_marks"), renderer_available).alias("fetch_source"))
    plain = snap.where("NOT is_html").select(
        "url", "not_modified", "error", "error_kind", F.lit("").alias("title"), F.when(F.col("error").isNull(), F.col("html")).alias("markdown"),
        F.array().cast("array<string>").alias("links"), F.lit("http").alias("fetch_source"))
    # an address is taken apart once for all its links
    pages = kept(parsed.unionByName(plain).withColumns({"content_hash": content_hash(F.col("markdown")), "_rb": U.url_parts(F.col("url"))}), "pages")
    hrefs = pages.select(F.col("url").alias("src_url"), "_rb", F.explode("links").alias("href")).where(U.link_candidate("href"))
    found = U.with_resolved(hrefs, "src_url", "href", "dst_url")
    edges = kept(found.where(F.col("dst_url").isNotNull() & F.col("_web")).select("src_url", "dst_url"), "edges")

    seen = CR.crawl(starts, edges, max_depth=max_depth, allow=allow, deny=deny, rules=rules, store=store, now=now, ttl_seconds=ttl_seconds,
                    renderer_available=renderer_available, expand_hits=expand_hits, seed_host=hosts[0])
    out = seen.join(pages.drop("links", "_rb"), "url", "left")
    fresh = F.col("status") == "unchanged"
    if store is not None:
        st = ST.latest_per_key(store, ["cached_at", "source", "title", "markdown", "content_hash"]).select(
            "cache_key", F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in ("title", "markdown", "content_hash")])
        out = out.withColumn("cache_key", cache_key(F.col("url"))).join(st, "cache_key", "left")
        same = F.coalesce(F.col("not_modified"), F.lit(False)) & F.col("_content_hash").isNotNull()
        out = out.withColumn("_kept", fresh | same)
        for c in ("title", "markdown", "content_hash"):
            out = out.withColumn(c, F.when(F.col("_kept"), F.col(f"_{c}")).otherwise(F.col(c)))
        out = out.withColumn("fetch_source", F.when(F.col("_kept"), F.col("_source")).otherwise(F.col("fetch_source")))
        status = (F.when(F.col("_kept") | (F.col("_content_hash") == F.col("content_hash")), F.lit("unchanged"))
                  .when(F.col("_content_hash").isNotNull(), F.lit("changed")).otherwise(F.lit("new")))
    else:
        out, status = out.withColumn("_kept", F.lit(False)), F.lit("new")
    missing = F.col("fetch_source").isNull()
    error = F.when(~F.col("_kept"), F.when(missing, F.lit("no snapshot for URL")).otherwise(F.col("error")))
    kind = F.when(~F.col("_kept"), F.when(missing, F.lit("not_found")).otherwise(F.col("error_kind")))
    out = out.select("url", "depth", F.when((F.col("depth") == 0) & F.lit(sitemap), F.lit("sitemap")).otherwise(F.col("source")).alias("source"),
                     status.alias("status"), "title", "markdown", "content_hash", "fetch_source", error.alias("error"), kind.alias("error_kind"))
    return out.select("url", "depth", "source", F.when(F.col("error").isNull(), F.col("status")).alias("status"),
                      *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("title", "markdown", "content_hash", "fetch_source")],
                      "error", "error_kind")


def extract_html(df: DataFrame, selector: str | None = None, trim: bool = False, max_chars: int = 0,
                 url_col: str = "url", max_bytes: int = X.MAX_INPUT_BYTES) -> DataFrame:
    """M6: validated input (C21; ``max_bytes`` 0 lifts the size limit) → selector
    extraction (J4: all matches in order joined by a blank line; no match →
    not_found; a bad selector raises) or refinement."""
    v = X.validate_inputs(df.withColumn("page_id", F.col("page_id").cast("long")), "html", max_bytes=max_bytes)
    ok = v.filter(F.col("error").isNull())
    nodes = N.html_nodes(ok.select("page_id", "html"))
    if selector is None:
        out = X.refine_pages(ok.select("page_id", url_col, "html"), nodes, trim, max_chars)
        out = out.withColumn("error", F.lit(None).cast("string")).withColumn("error_kind", F.lit(None).cast("string"))
    else:
        found = X.select_markdown(nodes, selector)
        out = ok.select("page_id", url_col).join(found, "page_id", "left").select(
            "page_id", url_col, F.lit("").alias("title"),
            post_process(F.coalesce("markdown", F.lit("")), trim, max_chars).alias("markdown"),
            F.lit(None).cast("string").alias("content_hash"),
            F.when(F.col("markdown").isNull(), F.lit("no element matches selector")).alias("error"),
            F.when(F.col("markdown").isNull(), F.lit("not_found")).alias("error_kind"))
    bad = v.filter(F.col("error").isNotNull()).select(
        "page_id", url_col, F.lit("").alias("title"), F.lit("").alias("markdown"),
        F.lit(None).cast("string").alias("content_hash"), "error", "error_kind")
    return out.unionByName(bad, allowMissingColumns=True)


def query_docs(matches_raw: DataFrame, docs_raw: DataFrame) -> DataFrame:
    """M7 (docs): per query, the top library match (A10, first in upstream
    order) ⋈ that library's stored docs payload → code snippets then info
    snippets (A9/H3). ``matches_raw``: ``query_id, body``; ``docs_raw``:
    ``library, body``."""
    from pyspark.sql import functions as F
    from ..sources.blocks import docs_results
    ex = matches_raw.select("query_id", F.try_element_at(
        F.from_json("body", "struct<results:array<struct<id:string>>>")["results"], F.lit(1))["id"].alias("library"))
    docs = docs_results(docs_raw)
    found = ex.join(docs, "library", "left")
    missing = F.col("library").isNull() | ~F.exists(F.array(*[F.col(c).isNotNull() for c in docs.columns if c != "library"]), lambda x: x)
    return found.withColumn("error_kind", F.when(missing, F.lit("not_found")))


def query_code(files: DataFrame, term: str, lang: str | None = None, limit: int = 10,
               regexp: bool = False) -> DataFrame:
    """M7 (code): grep over a files table (J14 → W4), top ``limit`` by
    (repo, path)."""
    from ..operators.codegrep import grep_code
    return grep_code(files, term, lang=lang, limit=limit, regexp=regexp)
