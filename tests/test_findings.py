"""Cases that went wrong once."""

import datetime as dt

from pyspark.sql import functions as F

from pagelake.operators import codegrep as CG
from pagelake.operators import cookies as CK
from pagelake.operators import crawl as CR
from pagelake.operators import store as ST
from pagelake.plans import composite as CP
from pagelake.sources import payloads as PL
from pagelake.sources import snapshots as SN
from pagelake.sources.sitemap import read_sitemap

def now():
    return F.expr("TIMESTAMP '2024-06-01 00:00:00'")


def test_a_url_listed_twice_gets_its_cookies_once(spark):
    jar = spark.createDataFrame([(1, "shop.test", False, "/", False, None, "sid", "v"), (2, "test", False, "/", False, None, "top", "t"),
                                 (3, "other.org", False, "/", False, None, "no", "n")],
                                "jar_ord int, domain string, host_only boolean, path string, secure boolean, expires timestamp, name string, value string")
    urls = spark.createDataFrame([("https://a.shop.test/x",)] * 2 + [("https://b.net/",)], "url string")
    got = {r.url: (r.n_cookies, r.cookie_header) for r in CK.match_cookies(urls, jar, now()).collect()}
    assert got == {"https://a.shop.test/x": (2, "sid=v; top=t"), "https://b.net/": (0, "")}


def test_a_later_write_wins_at_equal_times(spark, tmp_path):
    rows = lambda source, title: spark.createDataFrame([("k", "2024-01-01 00:00:00", source, title)], "cache_key string, cached_at string, source string, title string").withColumn(
        "cached_at", F.col("cached_at").cast("timestamp"))
    up = ST.upsert(rows("http", "old"), rows("browser", "new"))
    assert up.first().title == "new"
    root = str(tmp_path / "store")
    ST.write_version(up, root, 1)
    ST.write_delta(rows("a", "delta"), root)
    (tmp_path / "store" / "v=2").mkdir()  # a write that never ended
    assert ST.read_store(spark, root).first().title == "delta"


def test_a_lookup_of_status_reads_no_contents(spark, tmp_path):
    cols = "cache_key string, cached_at timestamp, source string, title string, markdown string, raw_html string"
    path = str(tmp_path / "s")
    spark.createDataFrame([], cols).write.parquet(path)
    plan = ST.latest_per_key(spark.read.parquet(path), ["cached_at", "source"])._jdf.queryExecution().executedPlan().toString()
    assert "raw_html" not in plan and "markdown" not in plan


def test_one_row_per_input_whatever_the_snapshots(spark):
    t = lambda d: dt.datetime(2024, 5, d)
    snaps = SN.prepare_snapshots(spark.createDataFrame(
        [("https://a.test/", 200, "text/html", b"<title>one</title><p>old</p>", t(1)), ("https://a.test/", 200, "text/html", b"<title>two</title><p>new</p>", t(2)),
         ("https://b.test/", 304, "", b"", t(3)), ("https://c.test/", 304, "", b"", t(3)), ("https://d.test/", 404, "", b"", t(1))],
        "url string, status int, content_type string, body binary, fetched_at timestamp"))
    store = spark.createDataFrame([("https://b.test/", "2020-01-01 00:00:00", "http", "kept", "text")], "url string, cached_at string, source string, title string, markdown string")
    store = store.withColumn("cached_at", F.col("cached_at").cast("timestamp")).withColumn("cache_key", F.substring(F.sha2("url", 256), 1, 16)).drop("url")
    urls = spark.createDataFrame([(2**45 + i, f"https://{h}.test/") for i, h in enumerate("abcde")], "input_pos long, url string")
    got = {r.url: r for r in CP.scrape_batch(urls, snaps, store, now())[0].collect()}
    assert len(got) == 5 and got["https://a.test/"].title == "two" and got["https://a.test/"].markdown == "new"
    assert got["https://b.test/"].from_store and got["https://b.test/"].markdown == "text"
    assert got["https://c.test/"].error_kind == "not_found" and got["https://e.test/"].error_kind == "not_found"


def test_bodies_are_whole_unless_asked(spark):
    df = spark.createDataFrame([("u", 200, "text/plain", b"abcdef")], "url string, status int, content_type string, body binary")
    whole, cut = SN.prepare_snapshots(df).first(), SN.prepare_snapshots(df, 3).first()
    assert (bytes(whole.body), whole.truncated, bytes(cut.body), cut.truncated) == (b"abcdef", False, b"abc", True)


def test_url_lists_and_sitemaps_are_trimmed(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("https://a.test/x\t\n\t# note\n\n  https://b.test/ \n")
    assert [r.url for r in PL.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.test/x", "https://b.test/"]
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>\n{x}\t</loc></sitemap>" for x in locs) + "</sitemapindex>"
    snaps = [(f"s{i}", index(f"s{i + 1}", "s0", "gone")) for i in range(8)] + [("s8", "<urlset><url><loc>\r\n https://p.test/ </loc></url></urlset>")]
    got = read_sitemap(spark.createDataFrame(snaps, "url string, body string"), spark.createDataFrame([("s0",)], "url string"))
    assert [tuple(r) for r in got.collect()] == [("s8", "https://p.test/")]


def test_a_crawl_goes_as_deep_as_the_links(spark):
    at = lambda i: f"https://deep.test/{i}"
    edges = spark.createDataFrame([(at(i), at(i + 1)) for i in range(70)], "src_url string, dst_url string")
    out = CR.crawl(spark.createDataFrame([(at(0),)], "url string"), edges, max_depth=0)
    assert out.count() == 71 and out.agg(F.max("depth")).first()[0] == 70


def test_code_search_takes_named_groups(spark):
    files = spark.createDataFrame([("r", "p", "go", "x\nfunc Foo() {}")], "repo string, path string, language string, text string")
    assert CG.grep_code(files, r"(?P<name>Foo)\(", regexp=True).first().line_no == 2
