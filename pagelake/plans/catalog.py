"""Registered queries: one Spark plan and (where SQL can express it) one
DuckDB oracle per operator family of SURVEY §2.

Every query reads the driver's tables (or what Spark derives from them), so
its work grows with them. Outputs are flat: arrays are joined into strings
and scores are exact-unit doubles, so both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as D
from . import sql_oracle as S
from ..functions.urls import canonical_url
from ..operators import fuse
from ..session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --- step 0: canonical dedup (C1, C2, H2) ---------------------------------

@register("canonical_dedup", f"""
SELECT key, CAST(count(*) AS BIGINT) AS n_variants, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages,
       min(url) AS first_url
FROM ({S.canon_select(S.URL_VARIANTS)}) GROUP BY key
""")
def canonical_dedup(spark: SparkSession, sf: str) -> DataFrame:
    v = D.url_variants(read_table(spark, sf, "pages").select("page_id", "url"))
    return (v.withColumn("key", canonical_url("url"))
            .groupBy("key")
            .agg(F.count("*").alias("n_variants"), F.countDistinct("page_id").alias("n_pages"),
                 F.min("url").alias("first_url")))


# --- M1: federated search over derived ranked lists -----------------------

def _flat_fused(df: DataFrame) -> DataFrame:
    return df.withColumn("backends", F.array_join("backends", ","))


@register("rrf_fusion", f"""
SELECT * EXCLUDE (backends), array_to_string(backends, ',') AS backends
FROM ({S.rrf_sql(S.RANKED_LISTS_PART, limit=0)})
""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    lists = D.ranked_lists_part(read_table(spark, sf, "part"))
    return _flat_fused(fuse.rrf_fuse(lists, limit=0))


@register("multi_search_top10", f"""
SELECT * EXCLUDE (backends), array_to_string(backends, ',') AS backends
FROM ({S.rrf_sql(f"SELECT l.* FROM ({S.RANKED_LISTS_PART}) l SEMI JOIN ({S.ATTEMPTS_PART}) a "
                 f"ON l.query_id = a.query_id AND l.backend = a.backend AND a.ok", limit=10)})
""")
def multi_search_top10(spark: SparkSession, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part")
    lists = D.ranked_lists_part(part)
    outcomes = D.attempts_part(part)
    return _flat_fused(fuse.multi_search(lists, outcomes, limit=10))


@register("search_failures", f"""
SELECT query_id,
  coalesce(array_to_string(list_sort(list(backend || '=' || error) FILTER (WHERE NOT ok)), ';'), '') AS errors,
  coalesce(array_to_string(list(backend ORDER BY backend_ord) FILTER (WHERE ok), ','), '') AS succeeded,
  bool_and(NOT ok) AS all_failed, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_failed
FROM ({S.ATTEMPTS_PART}) GROUP BY query_id
""")
def search_failures(spark: SparkSession, sf: str) -> DataFrame:
    out = fuse.failure_map(D.attempts_part(read_table(spark, sf, "part")))
    errs = F.array_join(F.array_sort(F.transform(F.map_entries("errors"),
                                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("query_id", errs.alias("errors"), F.array_join("succeeded", ",").alias("succeeded"),
                      "all_failed", "n_failed")


# --- I-family text functions over whole documents -----------------------------
from ..functions import text as T  # noqa: E402


@register("doc_text_stats", f"""
SELECT doc_id, {S.word_count_sql('text')} AS n_words, {S.first_line_sql('text')} AS first_line,
  {S.hash16('text')} AS text_hash, {S.hash16(S.strip_md('text'))} AS stripped_hash,
  {S.hash16(S.truncate_sql(S.strip_md('text'), 500))} AS post_hash,
  CAST(length(text) AS BIGINT) AS n_code_points,
  {S.hash16("regexp_replace(" + S.trim_ws("regexp_replace(text, " + S.lit(T.WS_CLASS + '+') + ", ' ', 'g')") + ", '', '')")} AS ws_hash
FROM documents
""")
def doc_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    from ..session import spread
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    # strip once (a staged projection), then hash it and its truncation (I3 = I1 then I2)
    d = d.withColumn("stripped", T.strip_markdown("text"))
    return d.select(
        "doc_id", T.word_count("text").alias("n_words"), T.first_line("text").alias("first_line"),
        T.content_hash("text").alias("text_hash"), T.content_hash("stripped").alias("stripped_hash"),
        T.content_hash(T.truncate("stripped", 500)).alias("post_hash"),
        F.length("text").cast("long").alias("n_code_points"),
        T.content_hash(T.normalize_ws("text")).alias("ws_hash"),
    )


# --- J1-J3, J10: HTML node table and what is derived from it ------------------
from ..operators import nodes as N  # noqa: E402
from ..operators import shell as SH  # noqa: E402


def _spread(pages: DataFrame) -> int | None:
    """Partitions for a table of fewer files than cores: parsing costs far more
    than a shuffle of the HTML. Tables of many files are parsed where they are read."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return cores if len(pages.inputFiles()) < cores else None


@register("page_titles", S.PAGE_TITLES)
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    return N.page_title(N.html_nodes(pages, num_partitions=_spread(pages), keep=["title"]))


@register("page_links", S.PAGE_LINKS)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages")
    return N.page_links(N.html_nodes(pages.select("page_id", "html"), num_partitions=_spread(pages), keep=["a"]),
                        pages.select("page_id", "url"))


def _shell_sql() -> str:
    """Visible pieces of the driver's pages by expressions: their lists,
    article, heading and paragraphs are regular enough for that."""
    plain = S.trim_ws("regexp_replace(" + S.unescape_html("regexp_replace(x, '<[^>]*>', '', 'g')") + r", '[\t\n\r ]+', ' ', 'g')")
    return f"""
WITH a AS (
  SELECT page_id, html, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS li, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art,
    strlen(regexp_extract(html, '(?s)<script>(.*?)</script>', 1)) AS script_bytes FROM pages),
b AS (
  SELECT *, list_concat(li, regexp_extract_all(art, '(?s)<h1>(.*?)</h1>', 1),
    list_transform(string_split(art, '<p>')[2:], lambda x: split_part(x, '</p>', 1))) AS blocks FROM a),
c AS (
  SELECT *, list_filter(list_transform(blocks, lambda x: {plain}), lambda x: x <> '') AS texts,
    {plain.replace("(x,", "(art,")} AS whole FROM b),
d AS (
  SELECT page_id, CAST(script_bytes AS BIGINT) AS script_bytes,
    CAST(list_sum(list_transform(list_append(texts, whole), lambda x: strlen(x))) + len(texts) AS BIGINT) AS vis_bytes,
    CAST(len(list_filter(texts, lambda x: strlen(x) > 20)) AS BIGINT) AS meaningful_blocks FROM c),
e AS (
  SELECT *, CASE WHEN vis_bytes >= 200 THEN 'static' WHEN meaningful_blocks > 2 THEN 'ambiguous'
    WHEN script_bytes > vis_bytes * 3 THEN 'likely_shell' ELSE 'ambiguous' END AS js_detection FROM d)
SELECT page_id, js_detection, vis_bytes, meaningful_blocks, script_bytes,
  CASE js_detection WHEN 'likely_shell' THEN 'http_shell' ELSE 'http' END AS source FROM e
"""


@register("js_shell_verdicts", _shell_sql())
def js_shell_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    return SH.js_shell(N.html_nodes(pages, num_partitions=_spread(pages)), pages).withColumn(
        "source", SH.fetch_source("js_detection"))


# --- store (D2, W5, B4, E14, C11-C13), change detection (D10) -----------------
from ..operators import store as ST  # noqa: E402
from ..operators import crawl as CR  # noqa: E402

_NOW = f"TIMESTAMP '{D.STORE_NOW}'"


@register("store_lookup", f"""
WITH st AS ({S.latest_sql(S.STORE_ROWS)}),
rq AS (SELECT DISTINCT 'https://u.example.com/' || user_id AS url FROM events),
j AS (SELECT rq.url, left(sha256(rq.url), 16) AS cache_key, st.cached_at, st.source, st.raw_html
      FROM rq LEFT JOIN st ON left(sha256(rq.url), 16) = st.cache_key)
SELECT url, cache_key, source, epoch_us(cached_at) AS cached_at_us,
  coalesce(cached_at IS NOT NULL AND {S.fresh_sql('cached_at', D.STORE_NOW, D.STORE_TTL_SECONDS)}
           AND NOT (coalesce(source, '') = 'http_shell'), false) AS hit,
  coalesce(cached_at IS NOT NULL AND {S.fresh_sql('cached_at', D.STORE_NOW, D.STORE_TTL_SECONDS)}
           AND NOT (coalesce(source, '') IN ('http_shell', '')), false) AS hit_with_renderer,
  coalesce(cached_at IS NOT NULL AND {S.fresh_sql('cached_at', D.STORE_NOW, D.STORE_TTL_SECONDS)}
           AND NOT (coalesce(source, '') = 'http_shell') AND raw_html <> '', false) AS raw_hit,
  coalesce(cached_at IS NOT NULL AND {S.fresh_sql('cached_at', D.STORE_NOW, D.STORE_TTL_SECONDS)}
           AND source = 'browser', false) AS forced_hit
FROM j
""")
def store_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events")
    store = ST.latest_per_key(D.store_rows_from_events(ev))
    req = ev.select(F.concat(F.lit("https://u.example.com/"), F.col("user_id").cast("string")).alias("url")).distinct()
    now = F.expr(_NOW)
    forced = ST.lookup(req, store, now, D.STORE_TTL_SECONDS, force_render=True).select(
        "cache_key", F.coalesce("hit", F.lit(False)).alias("forced_hit"))
    j = ST.lookup(req, store, now, D.STORE_TTL_SECONDS, want_raw=True).join(forced, "cache_key")
    fresh = F.col("cached_at").isNotNull() & ST.is_fresh(F.col("cached_at"), now, D.STORE_TTL_SECONDS)
    return j.select(
        "url", "cache_key", "source", ST.epoch_micros(j, "cached_at").alias("cached_at_us"),
        F.coalesce(fresh & ~ST.stale_for_render(F.col("source"), False), F.lit(False)).alias("hit"),
        F.coalesce(fresh & ~ST.stale_for_render(F.col("source"), True), F.lit(False)).alias("hit_with_renderer"),
        F.coalesce(F.col("hit"), F.lit(False)).alias("raw_hit"),
        "forced_hit",
    )


@register("store_upsert", f"""
WITH old AS (SELECT * FROM ({S.STORE_ROWS}) WHERE cached_at < TIMESTAMP '{D.UPSERT_SPLIT}'),
new AS (SELECT * EXCLUDE (raw_html), CAST(NULL AS VARCHAR) AS raw_html
        FROM ({S.STORE_ROWS}) WHERE cached_at >= TIMESTAMP '{D.UPSERT_SPLIT}'),
u AS ({S.latest_sql("SELECT * FROM old UNION ALL BY NAME SELECT * FROM new")})
SELECT cache_key, epoch_us(cached_at) AS cached_at_us, source, coalesce(raw_html <> '', false) AS has_raw,
  content_hash FROM u
""")
def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.store_rows_from_events(read_table(spark, sf, "events"))
    split = F.expr(f"TIMESTAMP '{D.UPSERT_SPLIT}'")
    old = rows.filter(F.col("cached_at") < split)
    new = rows.filter(F.col("cached_at") >= split)
    out = ST.upsert(old, new, keep_raw=False)
    return out.select("cache_key", ST.epoch_micros(out, "cached_at").alias("cached_at_us"), "source",
                      F.coalesce(F.col("raw_html") != "", F.lit(False)).alias("has_raw"), "content_hash")


@register("store_stats", f"""
SELECT CAST(count(*) AS BIGINT) AS entries,
  CAST(coalesce(sum(coalesce(octet_length(encode(markdown)), 0) + coalesce(octet_length(encode(title)), 0)
                    + coalesce(octet_length(encode(raw_html)), 0)), 0) AS BIGINT) AS bytes
FROM ({S.latest_sql(S.STORE_ROWS)})
""")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    store = ST.latest_per_key(D.store_rows_from_events(read_table(spark, sf, "events")))
    return ST.store_stats(store)


@register("change_detection", """
WITH old AS (SELECT 'https://docs.example.com/' || doc_id AS url, left(sha256(text), 16) AS h
             FROM documents WHERE source <> 'src0'),
new AS (SELECT 'https://docs.example.com/' || doc_id AS url,
          left(sha256(CASE WHEN lang = 'de' THEN text || ' (rev 2)' ELSE text END), 16) AS h
        FROM documents WHERE source <> 'src1')
SELECT coalesce(o.url, n.url) AS url,
  CASE WHEN o.h IS NULL AND n.h IS NOT NULL THEN 'new' WHEN n.h IS NULL THEN 'removed'
       WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status,
  o.h AS old_hash, n.h AS new_hash
FROM old o FULL OUTER JOIN new n ON o.url = n.url
""")
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    old, new = D.doc_snapshots(read_table(spark, sf, "documents"))
    return ST.detect_changes(old, new).select("url", "status", "old_hash", "new_hash")


# --- crawl (M5: D1, D7, C3, C6-C8, C14), counters (E5, E6), W2 ---------------

@register("crawl_site", f"""
WITH sp0 AS ({S.canon_select(S.SITE_PAGES, 'url', 'visit_key', normalize=True)}),
sp AS (SELECT page_id, visit_key AS k FROM sp0),
e AS (
  SELECT a.k AS src, b.k AS dst FROM sp a,
    (SELECT unnest([a2.page_id * 2 + 1, a2.page_id * 2 + 2, a2.page_id // 2]) AS dst_id, a2.page_id AS pid FROM pages a2) x,
    sp b
  WHERE x.pid = a.page_id AND b.page_id = x.dst_id AND b.k <> ''
    AND regexp_extract(b.k, '^[a-z]+://([^/?#:]*)', 1) = 'site.example.com'
),
seed AS (SELECT k FROM sp WHERE page_id = (SELECT min(page_id) FROM pages))
SELECT k AS url, CAST(min(depth) AS INTEGER) AS depth,
  CASE WHEN min(depth) = 0 THEN 'seed' ELSE 'link' END AS source
FROM (
  WITH RECURSIVE bfs(k, depth) AS (
    SELECT k, 0 FROM seed
    UNION
    SELECT e.dst, bfs.depth + 1 FROM bfs JOIN e ON e.src = bfs.k WHERE bfs.depth < (SELECT count(*) FROM sp)
  ) SELECT * FROM bfs
) GROUP BY k
""")
def crawl_site(spark: SparkSession, sf: str) -> DataFrame:
    seeds, edges, _site = D.site_graph(read_table(spark, sf, "pages").select("page_id", "url"))
    out = CR.crawl(seeds, edges, max_depth=0)
    return out.select("url", F.col("depth").cast("int").alias("depth"), "source")  # cold crawl: all new


@register("crawl_chain", f"""
SELECT '{D.CHAIN_HOST}/p/' || page_id AS url,
  CAST(row_number() OVER (PARTITION BY page_id % {D.CHAINS} ORDER BY page_id) - 1 AS INTEGER) AS depth
FROM pages
""")
def crawl_chain(spark: SparkSession, sf: str) -> DataFrame:
    seeds, edges = D.chain_graph(read_table(spark, sf, "pages").select("page_id"))
    return CR.crawl(seeds, edges, max_depth=0).select("url", F.col("depth").cast("int").alias("depth"))


@register("sitemap_pages", f"""
SELECT '{D.SITEMAP_HOST}/u' || (page_id // {D.SITEMAP_PAGES}) || '.xml' AS sitemap_url, url FROM pages
""")
def sitemap_pages(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.sitemap import read_sitemap
    return read_sitemap(*D.sitemap_snapshots(read_table(spark, sf, "pages").select("page_id", "url")))


@register("crawl_summary", """
SELECT strftime(ts, '%Y-%m-%d') AS run_id,
  CAST(count(*) - count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS pages,
  CAST(count(*) AS BIGINT) AS pages_all,
  CAST(count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS BIGINT) AS new,
  CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS changed,
  CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS unchanged,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors,
  CAST(epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS BIGINT) AS duration_s
FROM events GROUP BY 1
""")
def crawl_summary(spark: SparkSession, sf: str) -> DataFrame:
    return CR.crawl_summary(D.run_log(read_table(spark, sf, "events")))


@register("host_shell_ratio", """
SELECT 'h' || user_id AS host, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE event_type = 'error' OR user_id < 10) AS BIGINT) AS shells
FROM events GROUP BY 1
""")
def host_shell_ratio(spark: SparkSession, sf: str) -> DataFrame:
    a = D.arrivals(read_table(spark, sf, "events"))
    fetches = a.select("host", F.when(F.col("is_shell"), "likely_shell").otherwise("static").alias("js_detection"))
    return CR.host_shell_ratio(fetches)


@register("force_render", """
SELECT event_id, prior_total, prior_shells,
  prior_total >= 10 AND prior_shells::DOUBLE / greatest(prior_total, 1) > 0.8 AS force_render
FROM (
  SELECT event_id,
    CAST(count(*) OVER w AS BIGINT) AS prior_total,
    CAST(coalesce(sum(CASE WHEN event_type = 'error' OR user_id < 10 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS prior_shells
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
""")
def force_render(spark: SparkSession, sf: str) -> DataFrame:
    a = D.arrivals(read_table(spark, sf, "events"))
    out = CR.force_render_history(a)
    return out.select(F.col("seq").alias("event_id"), "prior_total", "prior_shells", "force_render")


# --- J14 / W4 / C16: code search over documents as files ---------------------
from ..operators import codegrep as CG  # noqa: E402

GREP_TERM = "license"


@register("code_grep", f"""
WITH f AS (SELECT source AS repo, doc_id || '.txt' AS path, lang AS language, text FROM documents
           WHERE contains(lower(text), '{GREP_TERM}')),
l AS (SELECT *, string_split(text, chr(10)) AS lines FROM f),
s AS (SELECT *, CASE WHEN list_position(list_transform(lines, lambda x: starts_with(x, '--- Snippet')), true) > 0
                     THEN lines[1:list_position(list_transform(lines, lambda x: starts_with(x, '--- Snippet')), true) - 1]
                     ELSE lines END AS body FROM l),
n AS (SELECT *, list_filter(list_transform(body, lambda x, i: {{'line': {S.trim_ws('x')}, 'line_no': CAST(i AS INTEGER)}}),
                            lambda r: r.line <> '') AS numbered FROM s),
b AS (SELECT *, coalesce(list_filter(numbered, lambda r: contains(lower(r.line), '{GREP_TERM}'))[1], numbered[1]) AS best FROM n)
SELECT repo, path, best.line_no AS line_no, best.line AS snippet, language,
  printf('https://code.example.com/%s/blob/HEAD/%s#L%d', repo, path, best.line_no) AS url, 'files' AS source
FROM b
""")
def code_grep(spark: SparkSession, sf: str) -> DataFrame:
    from ..session import spread
    files = CG.files_from_documents(spread(read_table(spark, sf, "documents")))
    return CG.grep_code(files, GREP_TERM)


# --- J5/J6/J8/J13: refined pages (markdown), rows-only ------------------------
from ..operators import extract as X  # noqa: E402


def _markdown_sql() -> str:
    """The driver's pages as markdown, block by block: marks for bold and line
    breaks, tags gone, white space collapsed, marks written out."""
    plain = S.unescape_html("regexp_replace(x, '<[^>]*>', '', 'g')")
    marked = "replace(replace(replace(x, '<b>', chr(1)), '</b>', chr(3)), '<br>', chr(2))"
    closed = f"{plain.replace('(x,', '(' + marked + ',')} || CASE WHEN contains(x, '<b>') AND NOT contains(x, '</b>') THEN chr(3) ELSE '' END"
    return rf"""
WITH a AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art,
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS x FROM pages),
b AS (
  SELECT page_id, url, {S.trim_ws(plain)} AS title,
    list_prepend('# ' || regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1),
                 list_transform(string_split(art, '<p>')[2:], lambda x: split_part(x, '</p>', 1))) AS blocks FROM a),
c AS (
  SELECT page_id, url, title, list_filter(list_transform(list_transform(blocks, lambda x: {closed}), lambda x: trim(
    replace(replace(regexp_replace(regexp_replace(x, '[\t\n\r ]+', ' ', 'g'), ' *' || chr(2) || ' *', chr(10), 'g'), chr(1), '**'),
            chr(3), '**'))), lambda x: x <> '') AS blocks FROM b),
d AS (SELECT page_id, url, title, array_to_string(blocks, chr(10) || chr(10)) AS markdown FROM c)
SELECT page_id, url, title, markdown, left(sha256(markdown), 16) AS content_hash FROM d
"""


@register("page_markdown", _markdown_sql())
def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    return X.refine_pages(pages, N.html_nodes(pages.select("page_id", "html"), num_partitions=_spread(pages)))


# --- D5 / G6: cookie scope over page URLs ------------------------------------
from ..operators import cookies as CK  # noqa: E402

COOKIE_NOW = "2024-06-01 00:00:00"


@register("cookie_scope", f"""
WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)) AS h FROM pages),
jar AS (
  SELECT DISTINCT * FROM (
    SELECT h AS domain, true AS host_only, '/' AS path, false AS secure, CAST(NULL AS TIMESTAMP) AS expires,
           'sid' AS name, h AS value FROM h
    UNION ALL
    SELECT CASE WHEN len(string_split(h, '.')) >= 3 THEN regexp_replace(h, '^[^.]+\\.', '') ELSE h END,
           false, '/en', true, TIMESTAMP '2030-01-01 00:00:00', 'pref',
           CASE WHEN len(string_split(h, '.')) >= 3 THEN regexp_replace(h, '^[^.]+\\.', '') ELSE h END FROM h)
),
r AS (
  SELECT DISTINCT url, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1), '\\.$', '')) AS host,
    coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS req_path,
    starts_with(lower(url), 'https:') AS secure_req
  FROM pages
),
m AS (
  SELECT r.url, jar.name, jar.value, jar.path, jar.domain FROM r JOIN jar
    ON (r.host = jar.domain OR (NOT jar.host_only AND ends_with(r.host, '.' || jar.domain)))
  WHERE (jar.expires IS NULL OR jar.expires > TIMESTAMP '{COOKIE_NOW}')
    AND (r.req_path = jar.path OR (starts_with(r.req_path, jar.path)
         AND (ends_with(jar.path, '/') OR substr(r.req_path, length(jar.path) + 1, 1) = '/')))
    AND (NOT jar.secure OR r.secure_req)
)
SELECT r.url, CAST(count(m.name) AS INTEGER) AS n_cookies,
  coalesce(string_agg(m.name || '=' || m.value, '; ' ORDER BY -length(m.path), m.domain, m.name, m.value), '') AS cookie_header
FROM r LEFT JOIN m ON r.url = m.url GROUP BY r.url
""")
def cookie_scope(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("url")
    jar = CK.cookies_for_hosts(pages)
    out = CK.match_cookies(pages, jar, F.expr(f"TIMESTAMP '{COOKIE_NOW}'"), order_cols=("domain",))
    return out.select("url", F.col("n_cookies").cast("int").alias("n_cookies"), "cookie_header")


# --- A4: backend payloads → ranked rows (round trip over derived lists) ------
from ..sources import payloads as PL  # noqa: E402

PAYLOAD_KINDS = {"alpha": "brave", "beta": "searxng", "gamma": "firecrawl"}


@register("search_payloads", f"""
SELECT query_id, CASE backend WHEN 'alpha' THEN 'brave' WHEN 'beta' THEN 'searxng' ELSE 'firecrawl' END AS backend,
  backend_ord, rank, title, url, description, '' AS content
FROM ({S.RANKED_LISTS_PART})
""")
def search_payloads(spark: SparkSession, sf: str) -> DataFrame:
    lists = D.ranked_lists_part(read_table(spark, sf, "part"))
    raw = PL.payloads_from_lists(lists, PAYLOAD_KINDS)
    return PL.normalize_search(raw)


# --- W6 / M2: random provider with fallback over derived attempts ------------

@register("random_search", f"""
WITH a AS ({S.ATTEMPTS_PART}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id || '|' || backend || '|42'), backend)
             AS try_pos FROM a),
f AS (SELECT *, min(CASE WHEN ok THEN try_pos END) OVER (PARTITION BY query_id) AS first_ok FROM o)
SELECT query_id, max(CASE WHEN try_pos = first_ok THEN backend END) AS chosen,
  CAST(count(*) FILTER (WHERE NOT ok AND (first_ok IS NULL OR try_pos < first_ok)) AS INTEGER) AS n_failures
FROM f GROUP BY query_id
""")
def random_search(spark: SparkSession, sf: str) -> DataFrame:
    out = fuse.random_fallback(D.attempts_part(read_table(spark, sf, "part")), seed=42)
    return out.select("query_id", "chosen", F.size("failures").alias("n_failures"))


# --- A5 + A6: event-stream text blocks (round trip over derived lists) -------
from ..sources import blocks as BL  # noqa: E402


@register("text_block_results", f"""
SELECT query_id || ':' || backend AS query_id, rank, title, url, description, description AS content
FROM ({S.RANKED_LISTS_PART})
""")
def text_block_results(spark: SparkSession, sf: str) -> DataFrame:
    lists = D.ranked_lists_part(read_table(spark, sf, "part")).withColumn("query_id", F.concat_ws(":", "query_id", "backend"))
    return BL.exa_results(BL.text_blocks_payload(lists), limit=0)


# --- M3 (M1 → D3) and M4 over the driver's pages -----------------------------
from ..plans import composite as CP  # noqa: E402
from ..sources import snapshots as SN  # noqa: E402


@register("search_enrich", f"""
WITH r AS ({S.rrf_sql(S.PAGE_SEARCH_LISTS, limit=10)}),
t AS ({S.PAGE_TITLES.replace('SELECT page_id,', 'SELECT url AS page_url,')})
SELECT r.query_id, r.fused_rank, r.url, r.title, t.title AS page_title, t.page_url IS NOT NULL AS has_page
FROM r LEFT JOIN t ON r.url = t.page_url
""")
def search_enrich(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    lists = D.page_search_lists(pages)
    nodes = N.html_nodes(pages.select("page_id", "html"), num_partitions=_spread(pages), keep=["title"])
    refined = N.page_title(nodes).join(pages.select("page_id", "url"), "page_id") \
        .withColumn("markdown", F.lit(""))
    out = CP.search_and_scrape(lists, refined, limit=10)
    return out.select("query_id", "fused_rank", "url", "title", "page_title",
                      F.col("page_title").isNotNull().alias("has_page"))


@register("scrape_batch", f"""
SELECT page_id AS input_pos, url, CAST(NULL AS VARCHAR) AS fetched_url,
  {S.trim_ws(S.unescape_html("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
  false AS from_store, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS error_kind
FROM pages
""")
def scrape_batch(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages")
    snaps = SN.prepare_snapshots(SN.snapshots_from_pages(pages))
    urls = pages.select(F.col("page_id").alias("input_pos"), "url")
    res, _delta = CP.scrape_batch(urls, snaps, None, F.expr("TIMESTAMP '2024-06-01 00:00:00'"))
    return res.select("input_pos", "url", "fetched_url", "title", "from_store", "error", "error_kind")


# --- C3/C6/C18 visit keys and C9/C10 content types over the driver's tables --

@register("crawl_keys", f"""
SELECT page_id, visit_key,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host,
  coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') IN ('', '/') AS bare_domain
FROM ({S.canon_select("SELECT page_id, url FROM pages", "url", "visit_key", normalize=True)})
""")
def crawl_keys(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import urls as U
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    return pages.select("page_id", U.normalize_url("url").alias("visit_key"), U.hostname("url").alias("host"),
                        U.is_bare_domain("url").alias("bare_domain"))


@register("content_types", f"""
WITH s AS (
  SELECT 'page-' || page_id AS id, 'text/html; charset=utf-8' AS declared, html AS body FROM pages
  UNION ALL
  SELECT 'doc-' || doc_id, CASE WHEN lang = 'en' THEN 'text/plain' ELSE '' END, text FROM documents
)
SELECT id, ctype, ctype IN ('text/html', 'application/xhtml+xml') AS is_html
FROM (SELECT id, {S.content_type_sql('declared', 'body')} AS ctype FROM s)
""")
def content_types(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.lit("text/html; charset=utf-8").alias("declared"), F.col("html").alias("body"))
    docs = read_table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("lang") == "en", F.lit("text/plain")).otherwise(F.lit("")).alias("declared"),
        F.col("text").alias("body"))
    s = pages.unionByName(docs)
    ct = X.content_type(F.col("declared"), F.col("body").cast("binary"))
    return s.select("id", ct.alias("ctype")).withColumn("is_html", X.is_html_type(F.col("ctype")))


# --- C4 / C5: ordered rewrite rules over page URLs ---------------------------
REWRITE_RULES = [(r"^http://", "https://"), (r"^https://www\.([^/]+)/(.*)$", "https://$1/$2"),
                 (r"/en/", "/intl/en/")]


@register("url_rewrite", """
SELECT page_id, url,
  CASE WHEN regexp_matches(url, '^http://') THEN regexp_replace(url, '^http://', 'https://', 'g')
       WHEN regexp_matches(url, '^https://www\\.([^/]+)/(.*)$') THEN regexp_replace(url, '^https://www\\.([^/]+)/(.*)$', 'https://\\1/\\2', 'g')
       WHEN regexp_matches(url, '/en/') THEN regexp_replace(url, '/en/', '/intl/en/', 'g')
       ELSE url END AS fetch_url,
  CASE WHEN regexp_matches(url, '^http://') OR regexp_matches(url, '^https://www\\.([^/]+)/(.*)$')
            OR regexp_matches(url, '/en/') THEN 1 ELSE 0 END AS rewritten
FROM pages
""")
def url_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import urls as U
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    out = pages.withColumn("fetch_url", U.rewrite_url("url", REWRITE_RULES))
    return out.select("page_id", "url", "fetch_url",
                      U.fetched_url(F.col("url"), F.col("fetch_url")).isNotNull().cast("int").alias("rewritten"))


# --- M5 with a warm page store (D2 inside the crawl, E5 statuses) -------------
CRAWL_STORE_START = "2024-01-01 00:00:00"
CRAWL_STORE_NOW = "2024-01-08 00:00:00"


@register("crawl_status", f"""
WITH sp0 AS ({S.canon_select(S.SITE_PAGES, 'url', 'visit_key', normalize=True)}),
sp AS (SELECT page_id, visit_key AS k FROM sp0),
st AS (
  SELECT left(sha256(s.k), 16) AS cache_key,
         max(TIMESTAMP '{CRAWL_STORE_START}' + to_minutes(length(p.html))) AS cached_at
  FROM sp s JOIN pages p ON s.page_id = p.page_id GROUP BY 1
),
e AS (
  SELECT a.k AS src, b.k AS dst FROM sp a,
    (SELECT unnest([a2.page_id * 2 + 1, a2.page_id * 2 + 2, a2.page_id // 2]) AS dst_id, a2.page_id AS pid FROM pages a2) x,
    sp b
  WHERE x.pid = a.page_id AND b.page_id = x.dst_id AND b.k <> ''
    AND regexp_extract(b.k, '^[a-z]+://([^/?#:]*)', 1) = 'site.example.com'
),
seed AS (SELECT k FROM sp WHERE page_id = (SELECT min(page_id) FROM pages)),
b AS (
  SELECT k AS url, CAST(min(depth) AS INTEGER) AS depth FROM (
    WITH RECURSIVE bfs(k, depth) AS (
      SELECT k, 0 FROM seed
      UNION
      SELECT e.dst, bfs.depth + 1 FROM bfs JOIN e ON e.src = bfs.k WHERE bfs.depth < (SELECT count(*) FROM sp)
    ) SELECT * FROM bfs
  ) GROUP BY k
)
SELECT b.url, b.depth, CASE WHEN b.depth = 0 THEN 'seed' ELSE 'link' END AS source,
  CASE WHEN st.cached_at IS NOT NULL AND {S.fresh_sql('st.cached_at', CRAWL_STORE_NOW, 72 * 3600)}
       THEN 'unchanged' ELSE 'new' END AS status
FROM b LEFT JOIN st ON left(sha256(b.url), 16) = st.cache_key
""")
def crawl_status(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import urls as U
    from ..functions.text import cache_key
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    seeds, edges, site = D.site_graph(pages.select("page_id", "url"))
    cached = F.expr(f"timestampadd(MINUTE, length(html), TIMESTAMP '{CRAWL_STORE_START}')")
    store = (site.join(pages.select("page_id", "html"), "page_id")
             .select(cache_key(U.normalize_url("site_url")).alias("cache_key"), cached.alias("cached_at"),
                     F.lit("http").alias("source")))
    out = CR.crawl(seeds, edges, max_depth=0, store=store, now=F.expr(f"TIMESTAMP '{CRAWL_STORE_NOW}'"))
    return out.select("url", F.col("depth").cast("int").alias("depth"), "source", "status")


# --- A12 / E13: a cookie jar written from the page hosts, parsed back -------
JAR_NOW_EPOCH = 1704844800        # 2024-01-10 00:00:00 UTC
JAR_EXPIRY_BASE = 1704067200       # 2024-01-01 00:00:00 UTC


@register("cookie_jar_counts", f"""
WITH l AS (
  SELECT CASE WHEN contains(url, '?') THEN 'skip'
              WHEN {JAR_EXPIRY_BASE} + length(html) * 100 <= {JAR_NOW_EPOCH} THEN 'expired'
              ELSE 'ok' END AS status
  FROM pages
)
SELECT CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS live,
  CAST(count(*) FILTER (WHERE status = 'expired') AS BIGINT) AS expired FROM l
""")
def cookie_jar_counts(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import urls as U
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    host = F.lower(U.hostname("url"))
    expiry = (F.lit(JAR_EXPIRY_BASE) + F.length("html") * 100).cast("string")
    fields = [host, F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), expiry, F.lit("sid")]
    # a line whose page URL has a query loses its value field: malformed, skipped
    line = F.when(F.col("url").contains("?"), F.concat_ws("\t", *fields)) \
        .otherwise(F.concat_ws("\t", *fields, F.col("page_id").cast("string")))
    lines = pages.select(F.col("page_id").alias("line_no"), line.alias("line"))
    # "now" as an instant from epoch seconds: independent of the session zone
    parsed = CK.parse_cookie_lines(lines, F.timestamp_seconds(F.lit(JAR_NOW_EPOCH)))
    return CK.jar_counts(parsed)


# --- J4: CSS selectors over the driver's pages --------------------------------

@register("page_selector_counts", """
SELECT page_id,
  CAST(len(regexp_extract_all(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?i)<a\\s[^>]*href=')) AS BIGINT) AS nav_links,
  CAST(len(regexp_extract_all(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?i)<p[\\s>]')) AS BIGINT) AS article_paragraphs,
  CAST(len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS BIGINT) AS headings
FROM pages
""")
def page_selector_counts(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    wanted = {"nav_links": "nav a[href]", "article_paragraphs": "article p", "headings": "h1"}
    hits = N.select_many(N.html_nodes(pages, num_partitions=_spread(pages)), wanted, with_text=False)
    counts = hits.groupBy("page_id").agg(*[F.count_if(F.col("selector") == name).alias(name) for name in wanted])
    return pages.select("page_id").join(counts, "page_id", "left").select(
        "page_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in wanted])


from . import catalog_html, catalog_io, catalog_more  # noqa: E402,F401  (register their queries)
