"""A crawl straight from snapshots: pages, errors, sitemap, store."""

import datetime as dt

from pyspark.sql import functions as F

from pagelake.functions.text import cache_key, content_hash
from pagelake.operators import store as ST
from pagelake.plans import composite as CP
from pagelake.sources import snapshots as SN

S = "https://site.test"


def doc(title, *links, text="Some words about a pier, and about its boats, which are out at sea."):
    return f"<html><head><title>{title}</title></head><body><article><p>{text}</p>" + "".join(f"<a href='{x}'>l</a>" for x in links) + "</article></body></html>"


def snaps(spark):
    rows = [(f"{S}/", 200, "text/html", doc("Home", "/a", "b?utm_source=x#f", "/pdf", "/gone", "https://else.test/", "mailto:x", "/deny/1")),
            (f"{S}/a", 200, "text/html", doc("A", "/", "/c", "/never")), (f"{S}/b", 200, "text/html", doc("B", "/c")),
            (f"{S}/c", 200, "text/html", doc("C", "/d")), (f"{S}/d", 200, "text/html", doc("D", "/")), (f"{S}/pdf", 200, "application/pdf", "%PDF-1.4"),
            (f"{S}/gone", 404, "text/html", doc("x", "/unseen")), (f"{S}/unseen", 200, "text/html", doc("U")),
            (f"{S}/text", 200, "text/plain", "plain <a href='/unseen'>"), (f"{S}/deny/1", 200, "text/html", doc("no", "/unseen")),
            (f"{S}/sitemap.xml", 200, "application/xml", f"<urlset><url><loc>{S}/b</loc></url><url><loc>{S}/text</loc></url><url><loc>{S}/lost</loc></url></urlset>")]
    return SN.prepare_snapshots(spark.createDataFrame([(*r, dt.datetime(2024, 5, 1)) for r in rows],
                                                      "url string, status int, content_type string, body string, fetched_at timestamp"))


def test_pages_and_errors(spark):
    out = {r.url.removeprefix(S): r for r in CP.crawl_snapshots(spark.createDataFrame([(f"{S}/",)], "url string"), snaps(spark), max_depth=2, deny=["/deny/"]).collect()}
    home = "" if "" in out else "/"
    assert {u: (r.depth, r.source) for u, r in out.items()} == {
        home: (0, "seed"), "/a": (1, "link"), "/b": (1, "link"), "/pdf": (1, "link"), "/gone": (1, "link"), "/c": (2, "link"), "/never": (2, "link")}
    assert {u: r.error_kind for u, r in out.items() if r.error} == {"/pdf": "precondition", "/gone": "not_found", "/never": "not_found"}
    assert out["/a"].title == "A" and out["/a"].status == "new" and out["/a"].markdown.startswith("Some words") and out["/a"].fetch_source == "http"
    assert out["/gone"].status is None and out["/gone"].markdown is None


def test_sitemap_source(spark):
    out = {r.url.removeprefix(S): r for r in CP.crawl_snapshots(spark.createDataFrame([(f"{S}/sitemap.xml",)], "url string"), snaps(spark), max_depth=1, sitemap=True).collect()}
    assert {u: (r.depth, r.source, r.error_kind) for u, r in out.items()} == {
        "/b": (0, "sitemap", None), "/text": (0, "sitemap", None), "/lost": (0, "sitemap", "not_found"), "/c": (1, "link", None)}
    assert out["/text"].markdown.startswith("plain")


def test_store_and_status(spark):
    s = snaps(spark).withColumn("status", F.when(F.col("url") == f"{S}/d", 304).otherwise(F.col("status")))
    s = SN.prepare_snapshots(s.select("url", "status", "content_type", "body", "fetched_at"))
    now = F.lit(dt.datetime(2024, 5, 2))
    text = "Some words about a pier, and about its boats, which are out at sea."
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 5, 1)
    rows = [("/a", new, "http", "stored"), ("/b", old, "http", "another text"), ("/c", old, "http", text + "\n\n[l](/d)"), ("/d", old, "http", "kept")]
    store = spark.createDataFrame([(f"{S}{u}", t, x, "T" + u, md) for u, t, x, md in rows],
                                  "url string, cached_at timestamp, source string, title string, markdown string").select(
        cache_key(F.col("url")).alias("cache_key"), "*", content_hash(F.col("markdown")).alias("content_hash"))
    run = lambda **kw: {r.url.removeprefix(S): r for r in CP.crawl_snapshots(
        spark.createDataFrame([(f"{S}/",)], "url string"), s, max_depth=0, deny=["/deny/"], store=store, now=now, **kw).collect()}
    out = run()
    home = "" if "" in out else "/"
    assert {u: out[u].status for u in (home, "/a", "/b", "/c", "/d")} == {home: "new", "/a": "unchanged", "/b": "changed", "/c": "unchanged", "/d": "unchanged"}
    assert out["/a"].markdown == "stored" and out["/b"].markdown.startswith("Some words") and out["/d"].markdown == "kept"
    assert "/never" in out and "/never" not in run(expand_hits=False)
    assert ST.DEFAULT_TTL_SECONDS == 72 * 3600
