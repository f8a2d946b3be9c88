"""More registered queries: operators that the queries of ``catalog`` don't
reach, over the driver's tables, with the constants written out in the SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import codegrep as CG
from ..operators import crawl as CR
from ..operators import fuse
from ..operators import health as H
from ..operators import nodes as N
from ..operators import store as ST
from ..session import ensure_checkpoint_dir, read_table
from ..sources import blocks as BL
from ..sources import payloads as PL
from ..streaming import incremental as K
from . import composite as CP
from . import derived as D
from . import sql_oracle as S
from .catalog import register


def _pages(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", *cols)


@register("url_filters", """
SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#]*[^/?#]') AND NOT regexp_matches(url, '(?i)[0-9]{2}/?$') AS allowed_by_deny,
  contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 'a') AS allowed_by_path
FROM pages
""")
def url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """A deny pattern and an allow list."""
    deny = [r"(?i)[[:digit:]]{2}/?$"]
    U.validate_deny(deny)
    return _pages(spark, sf, "url").select("page_id", (~U.deny_match("url", deny)).alias("allowed_by_deny"),
                                           U.allow_match("url", ["a"]).alias("allowed_by_path"))


@register("redirect_targets", "SELECT page_id, url AS target, url AS plain FROM pages")
def redirect_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A wrapped link gives its target, any other link itself."""
    wrapped = F.concat(F.lit("https://go.example.com/l/?x=1&uddg="), F.url_encode("url"), F.lit("&rut=9"))
    return _pages(spark, sf, "url").select("page_id", "url", wrapped.alias("w")).select(
        "page_id", T.unwrap_redirect("w").alias("target"), T.unwrap_redirect("url").alias("plain"))


@register("error_kinds", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'cancelled' WHEN 'click' THEN 'not_found' WHEN 'purchase' THEN 'validation'
  WHEN 'signup' THEN 'precondition' ELSE 'upstream' END AS kind FROM events
""")
def error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """I15."""
    reason = F.create_map(*[F.lit(x) for x in ("view", "Timeout", "click", "http_404", "purchase", "bad_selector", "signup", "no_browser")])
    return read_table(spark, sf, "events").select("event_id", T.error_kind(F.coalesce(reason[F.col("event_type")], F.lit("?"))).alias("kind"))


@register("pipe_table_flags", """
SELECT doc_id, doc_id % 3 <> 2 AND text IS NOT NULL AS has_table,
  first_line FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '|---|' WHEN doc_id % 3 = 1 THEN 'x' ELSE ' |---|' END AS first_line FROM documents)
""")
def pipe_table_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A delimiter row counts at the start of a line only."""
    rest = F.regexp_replace("text", r"[|]", "")
    head = F.expr("CASE doc_id % 3 WHEN 0 THEN '|---|' WHEN 1 THEN 'x\\n|:--|' ELSE ' |---|' END")
    md = F.concat(head, F.lit("\n"), rest)
    marks = F.expr("CASE doc_id % 3 WHEN 0 THEN '|---|' WHEN 1 THEN 'x' ELSE ' |---|' END")
    return read_table(spark, sf, "documents").select(
        "doc_id", F.coalesce(T.has_pipe_table(md), F.lit(False)).alias("has_table"), marks.alias("first_line"))


@register("matched_lines", """
SELECT doc_id, coalesce(trim(string_split(text, chr(10))[1], ' '), '') AS line FROM documents
WHERE length(trim(string_split(text, chr(10))[1])) > 0
""")
def matched_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The line around byte 0 is the first line."""
    docs = read_table(spark, sf, "documents").where(F.length(F.trim(F.split("text", "\n")[0])) > 0)
    return docs.select("doc_id", T.matched_line("text", F.lit(0)).alias("line"))


@register("backend_choice", f"""
SELECT query_id, backend, CASE backend WHEN 'gamma' THEN 0 ELSE 1 END AS backend_ord, CAST(count(*) AS BIGINT) AS n
FROM ({S.RANKED_LISTS_PART}) WHERE backend IN ('gamma', 'alpha') GROUP BY ALL
""")
def backend_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Named backends, in the order named, once each."""
    lists = D.ranked_lists_part(read_table(spark, sf, "part"))
    chosen = fuse.select_backends(lists, [" gamma", "alpha", "gamma"], list(D.BACKENDS))
    return chosen.groupBy("query_id", "backend", F.col("backend_ord").cast("int").alias("backend_ord")).agg(F.count("*").alias("n"))


@register("code_stars", """
SELECT source AS repo, doc_id || '.txt' AS path, lang AS language,
  CASE WHEN source IN ('src1', 'src2') THEN NULL ELSE CAST(length(source) * 10 AS BIGINT) END AS stars
FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' AND doc_id % 5 <> 0 AND doc_id % 7 <> 0
""")
def code_stars(spark: SparkSession, sf: str) -> DataFrame:
    """Language, archived and forked files, stars by repository."""
    docs = read_table(spark, sf, "documents")
    extra = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
                        (F.col("doc_id") % 5 == 0).alias("archived"), (F.col("doc_id") % 7 == 0).alias("fork"))
    files = CG.files_from_documents(docs).join(extra, "path")
    repos = docs.select(F.col("source").alias("repo")).distinct().where("repo NOT IN ('src1', 'src2')").withColumn(
        "stars", (F.length("repo") * 10).cast("bigint"))
    return CG.add_stars(CG.grep_code(files, "the", lang="en"), repos).select("repo", "path", "language", "stars")


_CHECKS = """
SELECT 'h' || (user_id % 40) AS backend, event_type AS surface, CAST(event_id AS INTEGER) AS key_ord,
  CASE event_type WHEN 'error' THEN 'unreachable' WHEN 'signup' THEN 'no_key' ELSE 'ok' END AS status,
  user_id % 2 = 0 AS required FROM events
"""


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'error' THEN 'unreachable' WHEN 'signup' THEN 'no_key' ELSE 'ok' END")
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string")).alias("backend"), F.col("event_type").alias("surface"),
        F.col("event_id").cast("int").alias("key_ord"), F.lit(1).alias("n_keys"), status.alias("status"), F.lit("").alias("detail"),
        (F.col("user_id") % 2 == 0).alias("required"))


@register("health_status", f"""
SELECT surface, backend, max(status) AS status,
  CASE WHEN max(status) = 'ok' AND count(*) > 1 THEN count(*) || ' keys accepted' ELSE '' END AS detail, bool_or(required) AS required
FROM ({_CHECKS}) GROUP BY surface, backend
""")
def health_status(spark: SparkSession, sf: str) -> DataFrame:
    """E10."""
    return H.health_rollup(_checks(spark, sf))


@register("health_failing", f"""
SELECT CAST(count(*) FILTER (WHERE required AND status NOT IN ('ok', 'skipped')) AS BIGINT) AS failing
FROM (SELECT surface, backend, max(status) AS status, bool_or(required) AS required FROM ({_CHECKS}) GROUP BY surface, backend)
""")
def health_failing(spark: SparkSession, sf: str) -> DataFrame:
    """E11."""
    return H.failing_surfaces(H.health_rollup(_checks(spark, sf)))


@register("url_payloads", """
SELECT page_id, CAST(0 AS INTEGER) AS input_pos, url, CAST(NULL AS VARCHAR) AS error_kind FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT page_id, 1, 'second', NULL FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT NULL, NULL, NULL, 'validation' FROM pages WHERE page_id % 4 = 0
""")
def url_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A2: JSON arrays of URLs; an empty one is an error row."""
    pages = _pages(spark, sf, "url")
    body = F.when(F.col("page_id") % 4 != 0, F.to_json(F.array(F.concat_ws("\t", F.col("page_id").cast("string"), "url"),
                                                             F.concat_ws("\t", F.col("page_id").cast("string"), F.lit("second"))))).otherwise(F.lit("[]"))
    rows = PL.urls_from_json(pages.select(body.alias("body")))
    return rows.select(F.split("url", "\t")[0].cast("bigint").alias("page_id"), "input_pos", F.split("url", "\t")[1].alias("url"), "error_kind")


@register("absolute_links", """
SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="(/[^"#?]*|https?://[^"]*)"', 1)) AS h FROM pages) GROUP BY page_id
""")
def absolute_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links that are absolute after resolving."""
    pages = _pages(spark, sf, "url", "html")
    nodes = N.absolutize_attrs(N.html_nodes(pages, keep=["a"]), pages)
    href = F.col("attrs").getItem("href")
    return nodes.where((F.col("tag") == "a") & href.rlike("^https?://")).groupBy("page_id").agg(F.count("*").alias("n"))


@register("page_cap", """
SELECT url, depth FROM (SELECT 'u' || event_id AS url, CAST(user_id % 6 AS INTEGER) AS depth, event_type FROM events)
WHERE event_type <> 'error' ORDER BY depth, url LIMIT 30
""")
def page_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The bounded crawl's first pages."""
    rows = read_table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), (F.col("user_id") % 6).cast("int").alias("depth"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"))
    return CR.cap_pages(rows, 30)[0].select("url", "depth")


@register("store_roundtrip", """
SELECT 'k' || (event_id // 7) AS cache_key, CAST(arg_max(event_id % 5, (event_id % 11 <> 0, event_id % 5)) AS INTEGER) AS last_write
FROM events GROUP BY 1
""")
def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A version, a stream's delta, a version made of both, another
    stream delta, a compaction, and a last delta; most rows have the same time,
    so later writes win, and older times lose to earlier writes."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    at = F.when(F.col("event_id") % 11 == 0, "2024-04-01 00:00:00").otherwise("2024-05-01 00:00:00").cast("timestamp")
    rows = read_table(spark, sf, "events").select(
        F.concat(F.lit("k"), F.floor(F.col("event_id") / 7).cast("string")).alias("cache_key"), at.alias("cached_at"),
        F.lit("http").alias("source"), (F.col("event_id") % 5).cast("string").alias("title"))
    part = lambda n: rows.where(F.col("title") == str(n))

    def streamed(n: int) -> None:
        part(n).write.mode("append").parquet(f"{root}-in")
        pages = spark.readStream.schema(rows.schema).parquet(f"{root}-in")
        K.store_upsert_stream(pages, root, f"{root}-state").awaitTermination()

    ST.upsert_store(part(0), root)
    streamed(1)
    ST.upsert_store(part(2), root)
    streamed(3)
    ST.compact(spark, root)
    ST.write_delta(ST.upsert(None, part(4)), root)
    return ST.read_store(spark, root).select("cache_key", F.col("title").cast("int").alias("last_write"))


@register("selected_headings", """
SELECT page_id, error_kind, n_lines FROM (
  SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<h1[\\s>]') THEN NULL ELSE 'not_found' END AS error_kind,
    CAST(len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS BIGINT) AS n_lines FROM pages)
""")
def selected_headings(spark: SparkSession, sf: str) -> DataFrame:
    """M6: every match of a selector as markdown; no match is not_found."""
    out = CP.extract_html(_pages(spark, sf, "url", "html"), "h1")
    n = F.regexp_count("markdown", F.lit(r"(?m)^# ")).cast("bigint")
    return out.select("page_id", "error_kind", n.alias("n_lines"))


@register("visited_once", f"SELECT DISTINCT 'https://u.example.com/' || user_id AS visit_key FROM events")
def visited_once(spark: SparkSession, sf: str) -> DataFrame:
    """K1: a stream of URLs, drained, each address once."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/visits-{uuid.uuid4().hex}"
    rows = read_table(spark, sf, "events").select(F.concat(F.lit("https://u.example.com/"), F.col("user_id").cast("string"), F.lit("/#x")).alias("url"))
    # a table of one row group is written by one task, as one file, and so would be one task's in the stream
    files = max(rows.rdd.getNumPartitions(), 3 * spark.sparkContext.defaultParallelism)
    rows.repartition(files).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("url string").parquet(f"{root}/in")
    query = K.visit_once(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(
        availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("visit_key")


@register("event_frames", """
SELECT doc_id, CAST(pos AS INTEGER) AS pos, event, data FROM (
  SELECT doc_id, 0 AS pos, 'a' AS event, lang AS data FROM documents UNION ALL
  SELECT doc_id, 1, 'a', source FROM documents UNION ALL SELECT doc_id, 2, 'b', source FROM documents)
""")
def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each data line has the event type that stands before it."""
    body = F.concat(F.lit("event: a\ndata: "), "lang", F.lit("\ndata:"), "source", F.lit("\n\nevent: b\ndata: "), "source", F.lit("\n"))
    frames = read_table(spark, sf, "documents").select("doc_id", F.posexplode(BL.event_data(body)).alias("pos", "f"))
    return frames.select("doc_id", "pos", "f.event", "f.data")


# --- M5 from snapshots, K3, K4 ----------------------------------------------------

_SITE = "https://crawl.example.com"


@register("crawl_from_pages", f"""
WITH p AS (SELECT page_id AS id, page_id % 10 AS d, page_id % 13 = 5 AS gone, page_id % 17 = 3 AS pdf, page_id % 3 AS stored FROM pages),
v AS (SELECT * FROM p WHERE d <= 4 AND NOT EXISTS (
  SELECT 1 FROM p q WHERE q.id < p.id AND q.id >= p.id - p.d AND (q.gone OR q.pdf)) AND (SELECT count(*) FROM p q WHERE q.id < p.id AND q.id >= p.id - p.d) = p.d)
SELECT '{_SITE}/p/' || id AS url, CAST(d AS INTEGER) AS depth, CASE WHEN d = 0 THEN 'sitemap' ELSE 'link' END AS source,
  CASE WHEN stored = 0 THEN 'unchanged' WHEN gone OR pdf THEN NULL WHEN stored = 1 THEN 'changed' ELSE 'new' END AS status,
  CASE WHEN stored = 0 THEN 'Stored' WHEN gone OR pdf THEN NULL ELSE 'Page ' || id END AS title,
  CASE WHEN stored = 0 THEN NULL WHEN gone THEN 'not_found' WHEN pdf THEN 'precondition' END AS error_kind
FROM v
""")
def crawl_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """M5: from a sitemap over snapshots, four levels of links: pages, missing
    ones and documents as error rows, fresh, stale and new entries of a store."""
    from ..functions.text import cache_key, content_hash
    from ..sources import snapshots as SN
    ids = _pages(spark, sf).select("page_id", F.concat(F.lit(f"{_SITE}/p/"), F.col("page_id").cast("string")).alias("url"))
    gone, pdf = F.col("page_id") % 13 == 5, F.col("page_id") % 17 == 3
    html = F.concat(F.lit("<title>Page "), F.col("page_id").cast("string"), F.lit("</title><p>Some text.</p><a href='/p/"),
                    (F.col("page_id") + 1).cast("string"), F.lit("?utm_source=x#part'>next</a><a href='https://other.example.com/'>away</a>"))
    at = F.lit("2024-05-01 00:00:00").cast("timestamp")
    pages = ids.select("url", F.when(gone, 404).otherwise(200).alias("status"), F.when(pdf, "application/pdf").otherwise("text/html").alias("content_type"),
                       html.alias("body"), at.alias("fetched_at"))
    loc = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))
    maps = ids.where(F.col("page_id") % 10 == 0).groupBy(F.floor(F.col("page_id") / 1000).alias("m")).agg(F.array_join(F.sort_array(F.collect_list(loc)), "").alias("x"))
    maps = maps.select(F.concat(F.lit(f"{_SITE}/map"), F.col("m").cast("string"), F.lit(".xml")).alias("url"), F.lit(200).alias("status"),
                       F.lit("application/xml").alias("content_type"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("body"), at.alias("fetched_at"))
    fresh = F.when(F.col("page_id") % 3 == 0, "2024-05-01 00:00:00").otherwise("2024-01-01 00:00:00").cast("timestamp")
    store = ids.where(F.col("page_id") % 3 < 2).select(
        cache_key(F.col("url")).alias("cache_key"), "url", fresh.alias("cached_at"), F.lit("http").alias("source"), F.lit("Stored").alias("title"),
        F.lit("old").alias("markdown"), content_hash(F.lit("old")).alias("content_hash"))
    out = CP.crawl_snapshots(maps.select("url"), SN.prepare_snapshots(pages.unionByName(maps)), max_depth=4, sitemap=True, store=store,
                             now=F.lit("2024-05-02 00:00:00").cast("timestamp"))
    return out.select("url", F.col("depth").cast("int").alias("depth"), "source", "status", "title", "error_kind")


@register("host_history_stream", """
SELECT event_id AS seq, CAST(count(*) OVER w AS BIGINT) AS prior_total,
  CAST(coalesce(sum(CASE WHEN event_type = 'error' OR user_id < 10 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS prior_shells
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def host_history_stream(spark: SparkSession, sf: str) -> DataFrame:
    """K3: the arrivals in two micro-batches, before and after a day; each row's
    history counts all before it."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hosts-{uuid.uuid4().hex}"
    arrivals = D.arrivals(read_table(spark, sf, "events")).select("host", "bucket", "at", "seq", "is_shell")
    split = F.expr(f"TIMESTAMP '{D.UPSERT_SPLIT}'")
    for part in (F.col("at") < split, F.col("at") >= split):
        arrivals.where(part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(arrivals.schema).parquet(f"{root}/in")
        K.host_history_stream(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out/history").select("seq", "prior_total", "prior_shells")


@register("ttl_stream", """
WITH w AS (SELECT user_id, ts, CASE WHEN user_id % 10 = 0 THEN 'http_shell' ELSE 'http' END AS source FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('view', 'click'))
SELECT r.event_id AS request_id, w.ts IS NOT NULL AND epoch_us(r.ts) - epoch_us(w.ts) <= 86400000000 AND w.source <> 'http_shell' AS hit
FROM r ASOF LEFT JOIN (SELECT DISTINCT * FROM w) w ON r.user_id = w.user_id AND r.ts >= w.ts
""")
def ttl_stream(spark: SparkSession, sf: str) -> DataFrame:
    """K4: page writes and requests as two streams; a request hits the latest
    write before it if that is a day old at most and no shell."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ttl-{uuid.uuid4().hex}"
    events = read_table(spark, sf, "events")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("cache_key")
    write = F.col("event_type").isin("view", "click")
    source = F.when(F.col("user_id") % 10 == 0, "http_shell").otherwise("http").alias("source")
    at = F.timestamp_micros(ST.epoch_micros(events, "ts"))
    pages, asks = events.where(write).select(key, at.alias("cached_at"), source), events.where(~write).select(key, F.col("event_id").alias("request_id"), at.alias("requested_at"))
    for name, df in (("pages", pages), ("asks", asks)):
        df.write.parquet(f"{root}/{name}")
    stream = lambda name, df: spark.readStream.schema(df.schema).parquet(f"{root}/{name}")
    out = K.ttl_store_stream(stream("pages", pages), stream("asks", asks), ttl_seconds=86400, delay="3650 days")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("request_id", "hit")
