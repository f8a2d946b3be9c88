"""Queries for sources and sinks: files written from the driver's tables and
read back by the library, rules and code searches over tables. What is expected
is said by SQL from the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ORACLES, register
from . import derived as D
from ..operators import codeindex as CI
from ..operators import codegrep as CG
from ..operators import cookies as CK
from ..operators import crawl as CR
from ..operators import nodes as N
from ..operators import rewrite as RW
from ..operators import store as ST
from ..session import ensure_checkpoint_dir, read_table, spread
from ..sources import blocks as BL
from ..sources import payloads as PL
from ..sources import result_pages as RP
from ..streaming import incremental as K


def _root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# --- D6: a rule for each order ---------------------------------------------------

@register("rule_table", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://([a-z.]*)\.example\.(com|net|org)/en/([0-9]+)([/.?#].*)?$', ['scheme', 'sub', 'tld', 'num', 'rest']) AS p FROM pages),
r AS (SELECT min(o_orderkey) AS ord, CAST(o_orderkey % 1000 AS VARCHAR) AS num, CASE o_orderkey % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'net' ELSE 'org' END AS tld FROM orders GROUP BY ALL)
SELECT page_id, CASE WHEN r.ord IS NOT NULL THEN p.scheme || '://' || p.sub || '.orders.test/' || r.ord || p.rest
    WHEN regexp_matches(url, '[0-9]$') THEN url || '/' ELSE url END AS fetch_url,
  CASE WHEN r.ord IS NOT NULL THEN r.ord WHEN regexp_matches(url, '[0-9]$') THEN 1000000000000 END AS rule_ord
FROM u LEFT JOIN r ON u.p.num = r.num AND u.p.tld = r.tld
""")
def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for each order (many with the same pattern: the first counts)
    and one that requires no text, over the pages' addresses."""
    tld = F.when(F.col("o_orderkey") % 3 == 0, "com").when(F.col("o_orderkey") % 3 == 1, "net").otherwise("org")
    match = F.concat(F.lit(r"^(https?)://([a-z.]*)\.example\."), tld, F.lit("/en/"), (F.col("o_orderkey") % 1000).cast("string"), F.lit("(?P<rest>[/.?#].*)?$"))
    rules = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rule_ord"), match.alias("match"), F.concat(F.lit("$1://${2}.orders.test/"), _text("o_orderkey"), F.lit("${rest}")).alias("replace"))
    last = spark.createDataFrame([(10**12, "[0-9]$", "$0/")], "rule_ord long, match string, replace string")
    out = RW.rewrite_by_table(read_table(spark, sf, "pages").select("page_id", "url"), rules.unionByName(last))
    return out.select("page_id", "fetch_url", "rule_ord")


# --- J14: the index --------------------------------------------------------------

@register("code_index", r"""
SELECT 'term' AS search, source AS repo, doc_id || '.txt' AS path FROM documents WHERE contains(lower(text), 'onthe')
UNION ALL SELECT 'two words', source, doc_id || '.txt' FROM documents WHERE contains(lower(text), 'with by of')
UNION ALL SELECT 'pattern', source, doc_id || '.txt' FROM documents WHERE regexp_matches(text, '(?i)threea?[.,] [a-z]+ion ')
UNION ALL SELECT 'no gram', source, doc_id || '.txt' FROM documents WHERE regexp_matches(text, '[0-9]{6}')
UNION ALL SELECT 'absent', source, doc_id || '.txt' FROM documents WHERE contains(lower(text), 'qqzzqq')
""")
def code_index(spark: SparkSession, sf: str) -> DataFrame:
    """The documents indexed by trigrams, and searched for terms, for a
    pattern, for one that has no trigram and for a term that is nowhere."""
    root = _root(spark, "index")
    CI.build(CG.files_from_documents(spread(read_table(spark, sf, "documents"))), root)
    asked = {"term": ("OnThe", False), "two words": ("with by of", False), "pattern": (r"(?i)threea?[.,] [a-z]+ion ", True),
             "no gram": (r"[0-9]{6}", True), "absent": ("qqzzqq", False)}
    out = None
    for name, (term, regexp) in asked.items():
        rows = CI.search(spark, root, term, regexp).select(F.lit(name).alias("search"), "repo", "path")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- A1, A12: line files ---------------------------------------------------------

@register("url_list_file", """
SELECT url, CAST(count(*) AS BIGINT) AS n FROM (SELECT url FROM pages WHERE page_id % 5 < 3 UNION ALL SELECT url FROM pages WHERE page_id % 5 = 0) GROUP BY url
""")
def url_list_file(spark: SparkSession, sf: str) -> DataFrame:
    """A1: lines with blanks, tabs, comments and nothing; repeated ones stay."""
    root, kind = _root(spark, "urls"), F.col("page_id") % 5
    line = (F.when(kind == 0, F.concat(F.lit("  "), "url", F.lit("\t\n\n \t\n"), "url")).when(kind == 3, F.concat(F.lit("\t# "), "url"))
            .when(kind == 4, F.lit(" ")).otherwise(F.concat("url", F.lit("\r"))))
    read_table(spark, sf, "pages").select(line.alias("value")).write.text(root)
    return PL.read_url_list(spark, root).groupBy("url").agg(F.count("*").alias("n"))


@register("cookie_file", r"""
SELECT 'p' || page_id || '.example.com' AS domain, page_id % 5 = 1 AS http_only, page_id % 2 = 0 AS secure,
  CASE page_id % 5 WHEN 1 THEN 'a' || chr(9) || page_id ELSE 'v' || page_id END AS value, CASE page_id % 5 WHEN 4 THEN 'expired' ELSE 'ok' END AS status
FROM pages WHERE page_id % 5 NOT IN (2, 3)
""")
def cookie_file(spark: SparkSession, sf: str) -> DataFrame:
    """A jar file with comments, short lines, values that hold tabs,
    carriage returns and expired cookies."""
    root, kind = _root(spark, "jar"), F.col("page_id") % 5
    domain = F.concat(F.lit(".P"), _text("page_id"), F.lit(".example.com"))
    head = F.concat_ws("\t", domain, F.lit("TRUE"), F.lit("/"), F.when(F.col("page_id") % 2 == 0, "TRUE").otherwise("FALSE"),
                       F.when(kind == 4, "1000").otherwise("0"), F.lit("sid"))
    line = (F.when(kind == 1, F.concat(F.lit("#HttpOnly_"), head, F.lit("\ta\t"), _text("page_id"))).when(kind == 2, F.concat(F.lit("# "), head, F.lit("\tx")))
            .when(kind == 3, head).otherwise(F.concat(head, F.lit("\tv"), _text("page_id"), F.lit("\r"))))
    read_table(spark, sf, "pages").select(line.alias("value")).write.text(root)
    jar = CK.read_cookies(spark, root, F.timestamp_seconds(F.lit(1_700_000_000)))
    return jar.where("status <> 'skip'").select("domain", "http_only", "secure", "value", "status")


# --- A7, A9, A10: result pages and library payloads ------------------------------

@register("result_page_rows", """
SELECT page_id, CAST(k + 1 AS INTEGER) AS rank, 'Hit ' || k || ' of ' || page_id AS title, url || CASE k WHEN 0 THEN '' ELSE '&k=' || k END AS url,
  CASE k WHEN 1 THEN '' ELSE 'About ' || page_id END AS description
FROM pages, (SELECT unnest(range(3)) AS k) WHERE NOT contains(url, '#') AND k < page_id % 4
""")
def result_page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of up to three results, some behind a redirect, one without a
    description, and a block without a link, which is none."""
    def block(k: int) -> Column:
        href = F.concat("url", F.lit("" if k == 0 else f"&k={k}"))
        href = F.concat(F.lit("/l/?uddg="), F.url_encode(href)) if k < 2 else F.replace(href, F.lit("&"), F.lit("&amp;"))
        about = F.lit("") if k == 1 else F.concat(F.lit('<a class="result__snippet">About <b>'), _text("page_id"), F.lit("</b></a>"))
        return F.when(F.col("page_id") % 4 > k, F.concat(
            F.lit('<div class="links result"><h2 class="result__title"> <a class="result__a" href="'), href, F.lit(f'">Hit {k} of '), _text("page_id"), F.lit("</a></h2>"), about, F.lit("</div>"))).otherwise("")

    empty = F.lit('<div class="result"><h2 class="result__title">No link</h2></div>')
    pages = read_table(spark, sf, "pages").where(~F.contains("url", F.lit("#"))).select(
        "page_id", F.concat(F.lit("<body>"), block(0), empty, block(1), block(2), F.lit("</body>")).alias("html"))
    return RP.result_page_rows(N.html_nodes(pages))


@register("docs_rows", """
SELECT CAST(p_partkey AS VARCHAR) AS library, CAST(0 AS INTEGER) AS pos, p_name AS title, CAST(NULL AS VARCHAR) AS breadcrumb, CASE p_size % 3 WHEN 0 THEN '' ELSE p_type END AS snippet, 'c' || p_partkey AS url FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, p_brand, p_brand, p_name, 'i' || p_partkey FROM part WHERE p_size % 2 = 0
""")
def docs_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Code entries before texts, whatever their order in the body."""
    code = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<struct<language:string,code:string>>")).otherwise(
        F.array(F.struct(F.lit("sql").alias("language"), F.col("p_type").alias("code")), F.struct(F.lit("x").alias("language"), F.lit("second").alias("code"))))
    snippet = F.array(F.struct(F.col("p_name").alias("codeTitle"), F.concat(F.lit("c"), _text("p_partkey")).alias("codeId"), code.alias("codeList")))
    info = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.concat(F.lit("i"), _text("p_partkey")).alias("pageId"), F.col("p_brand").alias("breadcrumb"), F.col("p_name").alias("content"))))
    raw = read_table(spark, sf, "part").select(_text("p_partkey").alias("library"), F.to_json(F.struct(info.alias("infoSnippets"), snippet.alias("codeSnippets"))).alias("body"))
    return BL.docs_results(raw).drop("source")


@register("library_rows", """
SELECT CAST(k AS INTEGER) AS pos, '/' || p_partkey || '/' || k AS id, p_name AS title, CAST(p_size AS INTEGER) AS total_snippets
FROM part, (SELECT unnest(range(2)) AS k) WHERE k < p_size % 4
""")
def library_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A10: the first two matches of each answer, fewer where it has fewer."""
    match = lambda k: F.struct(F.concat(F.lit("/"), _text("p_partkey"), F.lit("/"), k.cast("string")).alias("id"), F.col("p_name").alias("title"),
                               F.col("p_size").alias("totalSnippets"), F.lit(7.5).alias("trustScore"))
    n = (F.col("p_size") % 4).cast("int")
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), match))
    raw = read_table(spark, sf, "part").select(F.to_json(F.struct(items.alias("results"))).alias("body"))
    return PL.library_matches(raw, 2).select("pos", "id", "title", "total_snippets")


# --- B1, B2, B6, B7, G7: what is written ------------------------------------------

@register("json_lines", """
SELECT CAST(page_id AS VARCHAR) AS title, url, CASE WHEN page_id % 3 <> 0 THEN html END AS body, page_id % 3 = 0 AS omitted FROM pages
""")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """B1: results as JSON lines, read back; a null field is not written."""
    root = _root(spark, "lines")
    rows = read_table(spark, sf, "pages").select(
        "url", _text("page_id").alias("title"), F.length("html").alias("words"), F.lit("new").alias("status"), F.lit("http").alias("source"),
        F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("body"))
    CR.to_json_lines(rows, root)
    line = spark.read.text(root)
    back = F.from_json("value", "url string, title string, body string")
    return line.select(back.alias("r"), (~F.contains("value", F.lit('"body":'))).alias("omitted")).select("r.title", "r.url", "r.body", "omitted")


@register("tsv_rows", """SELECT CAST(p_partkey AS VARCHAR) || chr(9) || '"' || p_name || '"' || chr(9) || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS value FROM part""")
def tsv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """B2: tab-separated rows without quoting; null is empty."""
    root = _root(spark, "tsv")
    rows = read_table(spark, sf, "part").select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit('"')).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"))
    CR.to_tsv(rows, ["p_partkey", "name", "brand"], root)
    return spark.read.text(root)


@register("run_status_stream", ORACLES["crawl_summary"])
def run_status_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the runs as the log arrives in two parts, written at
    each micro-batch; the last status of each run is that of the whole log."""
    root = _root(spark, "runs")
    log = D.run_log(read_table(spark, sf, "events"))
    for half in (0, 1):
        log.where(F.pmod(F.xxhash64(*log.columns), F.lit(2)) == half).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/in")
        K.write_run_status(K.run_counters(stream), f"{root}/status", f"{root}/state").awaitTermination()
    return K.read_run_status(spark, f"{root}/status")


@register("raw_pages", """
SELECT url, CASE WHEN page_id % 4 = 0 THEN NULL WHEN length(html) > 300 THEN left(html, 300) || chr(10) || chr(10) || '[truncated]' ELSE html END AS raw_html FROM pages
""")
def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Raw HTML cut to the length asked for; other types carry none."""
    pages = read_table(spark, sf, "pages").select(
        "url", F.col("url").alias("fetched_url"), F.lit("t").alias("title"), F.lit("http").alias("source"), F.col("html").alias("raw_html"), (F.col("page_id") % 4 != 0).alias("is_html"))
    return ST.raw_output(pages, 300).select("url", "raw_html")


@register("recent_runs", "SELECT 'r' || event_id AS id, ts AS started_at FROM events ORDER BY ts DESC, 'r' || event_id LIMIT 100")
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred newest runs (the limit is the report)."""
    runs = read_table(spark, sf, "events").select(F.concat(F.lit("r"), _text("event_id")).alias("id"), F.col("ts").alias("started_at"))
    return CR.list_runs(runs).limit(100)
