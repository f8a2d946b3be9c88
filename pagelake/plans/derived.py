"""Inputs derived from the driver's tables when they lack a shape the
reference works on (FIXTURES.md part 3). Each has a DuckDB twin in
``pagelake.plans.sql_oracle`` so both engines see identical inputs.

All derivations are row-wise or windowed with a bounded group limit, so
their work grows linearly with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Fixed names of the synthetic backends of the ranked-list fixture.
BACKENDS = ("alpha", "beta", "gamma")
# brand-number last digits on which a backend "fails" (semantic, not a sample)
FAIL_DIGITS = {"alpha": ("3", "9"), "beta": ("7", "9"), "gamma": ("3", "9")}
LIST_DEPTH = 20


def url_variants(pages: DataFrame) -> DataFrame:
    """``pages`` × 4 URL spellings of the same page: as is, scheme swapped,
    ``www.`` added, fragment dropped + trailing slash + ``utm_source``."""
    u = F.col("url")
    swapped = (F.when(u.startswith("https://"), F.regexp_replace(u, "^https", "http"))
               .when(u.startswith("http://"), F.regexp_replace(u, "^http", "https"))
               .otherwise(u))
    www = F.when(u.rlike(r"^https?://www\."), u).otherwise(F.regexp_replace(u, r"^(https?://)", "$1www."))
    base = F.regexp_replace(u, r"#.*$", "")
    tracked = (F.when(base.contains("?"), F.concat(base, F.lit("&utm_source=x")))
               .when(base.endswith("/"), F.concat(base, F.lit("?utm_source=x")))
               .otherwise(F.concat(base, F.lit("/?utm_source=x"))))
    return pages.select(
        "page_id",
        F.inline(F.array(
            F.struct(F.lit(0).alias("variant"), u.alias("url")),
            F.struct(F.lit(1).alias("variant"), swapped.alias("url")),
            F.struct(F.lit(2).alias("variant"), www.alias("url")),
            F.struct(F.lit(3).alias("variant"), tracked.alias("url")),
        )),
    )


QUERY_PARTS = 500


def query_of() -> Column:
    return F.concat_ws("/", F.expr(f"p_partkey div {QUERY_PARTS}").cast("string"), "p_brand").alias("query_id")


def ranked_lists_part(part: DataFrame) -> DataFrame:
    """Three backends rank the parts of each query (a run of part keys and a
    brand, so queries grow with the table): alpha by price desc, beta by size
    desc, gamma by name; ties by key; top 20.

    One scan, one window: the per-backend sort keys are folded into two
    generic sort columns, and ``row_number() <= 20`` lets Spark plan a
    ``WindowGroupLimit`` that keeps ≤ 20 rows per (brand, backend) per map
    task before the shuffle — the shuffle is bounded by brands, not parts.
    """
    key = F.col("p_partkey")
    ex = part.select(
        "p_partkey", "p_name", query_of(), "p_type", "p_size", "p_retailprice",
        F.explode(F.array(*[F.lit(i) for i in range(len(BACKENDS))])).alias("backend_ord"),
    )
    sort_a = (F.when(F.col("backend_ord") == 0, -F.col("p_retailprice"))
              .when(F.col("backend_ord") == 1, -F.col("p_size").cast("double")))
    sort_b = F.when(F.col("backend_ord") == 2, F.col("p_name"))
    w = Window.partitionBy("query_id", "backend_ord").orderBy(
        sort_a.asc_nulls_first(), sort_b.asc_nulls_first(), key.asc())
    ranked = ex.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= LIST_DEPTH)
    k = key.cast("string")
    url = (F.when(F.col("backend_ord") == 0, F.concat(F.lit("https://shop.example.com/part/"), k))
           .when(F.col("backend_ord") == 1,
                 F.concat(F.lit("http://www.shop.example.com/part/"), k, F.lit("/?utm_source=beta")))
           .when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://Shop.example.com/part/"), k, F.lit("#spec")))
           .otherwise(F.concat(F.lit("https://shop.example.com/part/"), k, F.lit("?ref=gamma"))))
    names = F.element_at(F.array(*[F.lit(b) for b in BACKENDS]), F.col("backend_ord") + 1)
    return ranked.select(
        "query_id",
        names.alias("backend"),
        F.col("backend_ord").cast("int").alias("backend_ord"),
        F.col("rank").cast("int").alias("rank"),
        F.col("p_name").alias("title"),
        url.alias("url"),
        F.when(F.col("backend_ord") == 1, F.col("p_type")).otherwise(F.lit("")).alias("description"),
        F.when(F.col("backend_ord") == 2, F.concat(F.lit("size "), F.col("p_size").cast("string")))
        .otherwise(F.lit("")).alias("content"),
    )


def attempts_part(part: DataFrame) -> DataFrame:
    """One outcome row per (query, backend): failed when the brand number's
    last digit is one of the backend's fail digits."""
    rows = part.select(query_of()).distinct().select(
        "query_id",
        F.posexplode(F.array(*[F.lit(b) for b in BACKENDS])).alias("backend_ord", "backend"),
    )
    fail = F.lit(False)
    for b, digits in FAIL_DIGITS.items():
        fail = fail | ((F.col("backend") == b) & F.substring(F.col("query_id"), -1, 1).isin(*digits))
    return rows.select(
        "query_id", "backend", F.col("backend_ord").cast("int").alias("backend_ord"),
        (~fail).alias("ok"),
        F.when(fail, F.concat(F.col("backend"), F.lit(": upstream timeout"))).alias("error"),
    )


# --- store, change and crawl fixtures ----------------------------------------
# fixed "now" and TTL of the store fixtures
STORE_NOW = "2024-01-31 00:00:00"
STORE_TTL_SECONDS = 72 * 3600
UPSERT_SPLIT = "2024-01-16 00:00:00"
SITE_HOST = "site.example.com"
# event type → fetch source recorded in the store ('' = legacy entry)
EVENT_SOURCE = {"view": "http", "click": "browser", "error": "http_shell", "signup": "", "purchase": "http"}
# event type → crawl status of the run log ('error' rows are errors)
EVENT_STATUS = {"view": "new", "signup": "new", "click": "changed", "purchase": "unchanged"}


def store_rows_from_events(events: DataFrame) -> DataFrame:
    from ..functions.text import cache_key, content_hash
    url = F.concat(F.lit("https://u.example.com/"), F.col("user_id").cast("string"))
    src = F.create_map(*[x for k, v in EVENT_SOURCE.items() for x in (F.lit(k), F.lit(v))])
    return events.select(
        cache_key(url).alias("cache_key"), F.col("ts").alias("cached_at"),
        src[F.col("event_type")].alias("source"), url.alias("url"), F.lit(None).cast("string").alias("fetched_url"),
        F.col("event_type").alias("title"), F.col("props").alias("markdown"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        content_hash(F.col("props")).alias("content_hash"),
        F.when(F.col("value") > 50, F.col("props")).otherwise(F.lit("")).alias("raw_html"),
    )


def doc_snapshots(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of ``documents``: the old one lacks source ``src0``
    (those are new), the new one lacks ``src1`` (removed) and revises every
    German text (changed)."""
    from ..functions.text import content_hash
    url = F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string"))
    old = documents.filter(F.col("source") != "src0").select(url.alias("url"), content_hash("text").alias("content_hash"))
    new_text = F.when(F.col("lang") == "de", F.concat(F.col("text"), F.lit(" (rev 2)"))).otherwise(F.col("text"))
    new = documents.filter(F.col("source") != "src1").select(url.alias("url"), content_hash(new_text).alias("content_hash"))
    return old, new


def site_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages moved onto one host; page i links to pages 2i+1, 2i+2 and i div 2.
    Returns (seeds, edges, site pages)."""
    from ..functions.urls import normalize_url
    site = pages.select("page_id", F.regexp_replace("url", r"^https?://[^/?#]+", "https://" + SITE_HOST).alias("site_url"))
    # the visit key is projected before the explode: lambda-local struct
    # aliases do not survive being planned inside a Generate
    src = site.select("page_id", normalize_url("site_url").alias("src_url"))
    src = src.select("page_id", "src_url",
                     F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2,
                                       F.expr("page_id div 2"))).alias("dst_id"))
    dst = site.select(F.col("page_id").alias("dst_id"), F.col("site_url").alias("dst_url"))
    edges = src.join(dst, "dst_id").select("src_url", "dst_url")
    seeds = site.orderBy("page_id").limit(1).select(F.col("site_url").alias("url"))
    return seeds, edges, site


CHAINS = 3
CHAIN_HOST = "https://chain.example.com"


def chain_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages as three long chains (page i links to page i + 3): a crawl whose
    depth grows with the table. Returns (seeds, edges)."""
    at = lambda i: F.concat(F.lit(f"{CHAIN_HOST}/p/"), i.cast("string"))
    here = F.col("page_id")
    ahead = pages.select((here - CHAINS).alias("page_id"))
    edges = pages.join(ahead, "page_id").select(at(here).alias("src_url"), at(here + CHAINS).alias("dst_url"))
    return pages.where(here < CHAINS).select(at(here).alias("url")), edges


SITEMAP_PAGES = 20
SITEMAP_HOST = "https://maps.example.com"


def sitemap_snapshots(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sitemap files of 20 pages each behind a chain of index files, one level
    a file; the last names one that is missing, and each names the first.
    Returns (snapshots, seeds)."""
    number = F.expr(f"page_id div {SITEMAP_PAGES}")
    loc = lambda tag, url: F.concat(F.lit(f"<{tag}><loc>\n "), url, F.lit(f"\t</loc></{tag}>"))
    name = lambda kind, n: F.concat(F.lit(f"{SITEMAP_HOST}/{kind}"), n.cast("string"), F.lit(".xml"))
    head = F.lit('<?xml version="1.0"?>')
    files = pages.select(number.alias("n"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u")).groupBy("n").agg(
        F.array_join(F.collect_list(loc("url", F.col("u"))), "").alias("locs"))
    urlsets = files.select(name("u", F.col("n")).alias("url"), F.concat(head, F.lit("<urlset>"), "locs", F.lit("</urlset>")).alias("body"))
    indexes = files.select("n").select(name("i", F.col("n")).alias("url"), F.concat(
        head, F.lit("<sitemapindex>"), *(loc("sitemap", name(k, n)) for k, n in (("u", F.col("n")), ("i", F.col("n") + 1), ("i", F.lit(0)))),
        F.lit("</sitemapindex>")).alias("body"))
    return urlsets.unionByName(indexes), indexes.where(F.col("url") == f"{SITEMAP_HOST}/i0.xml").select("url")


def arrivals(events: DataFrame) -> DataFrame:
    """Fetch arrivals per host: host = user, ordered by (ts, event_id); a
    shell when the event is an error or the user is one of the first ten."""
    return events.select(
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"),
        F.date_trunc("minute", "ts").alias("bucket"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        ((F.col("event_type") == "error") | (F.col("user_id") < 10)).alias("is_shell"),
    )


def run_log(events: DataFrame) -> DataFrame:
    st = F.create_map(*[x for k, v in EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("ts").alias("at"),
        F.when(F.col("event_type") == "error", F.lit("fetch failed")).alias("error"),
        st[F.col("event_type")].alias("status"),
    )


# names of the four spelling "backends" of the page-search fixture
VARIANT_BACKENDS = ("as_is", "scheme", "www", "tracked")


def page_search_lists(pages: DataFrame) -> DataFrame:
    """Ranked lists over the driver's pages: query = page host; four
    backends, one per URL spelling (``url_variants``), each ranking the
    host's pages its own way (id asc, id desc, size desc, URL); top 20."""
    from ..functions.urls import hostname
    base = pages.select("page_id", F.lower(hostname("url")).alias("host"), F.length("html").alias("size"),
                        F.col("url").alias("orig_url"))
    v = url_variants(pages.select("page_id", "url")).join(base, "page_id")
    sort_a = (F.when(F.col("variant") == 0, F.col("page_id"))
              .when(F.col("variant") == 1, -F.col("page_id"))
              .when(F.col("variant") == 2, -F.col("size").cast("long")))
    sort_b = F.when(F.col("variant") == 3, F.col("orig_url"))
    w = Window.partitionBy("host", "variant").orderBy(sort_a.asc_nulls_first(), sort_b.asc_nulls_first(),
                                                     F.col("page_id").asc())
    ranked = v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= LIST_DEPTH)
    names = F.element_at(F.array(*[F.lit(b) for b in VARIANT_BACKENDS]), F.col("variant") + 1)
    return ranked.select(
        F.col("host").alias("query_id"), names.alias("backend"), F.col("variant").cast("int").alias("backend_ord"),
        F.col("rank").cast("int").alias("rank"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"),
        "url", F.lit("").alias("description"), F.lit("").alias("content"))
