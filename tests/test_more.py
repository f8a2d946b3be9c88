import json
import os
import tempfile

from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.operators import crawl as CR
from pagelake.operators import extract as X
from pagelake.plans import composite as CP
from pagelake.sources import snapshots as SN


def test_rules_table_and_json(spark):
    rules = spark.createDataFrame([(2, "reddit", "never"), (1, r"^https://www\.reddit\.com/(.*)$", "https://old.reddit.com/${1}")],
                                  "rule_ord int, match string, replace string")
    r = U.rules_from_table(rules)
    df = spark.createDataFrame([("https://www.reddit.com/r/go",)], "url string")
    assert df.select(U.rewrite_url("url", r).alias("u")).first().u == "https://old.reddit.com/r/go"
    bad = spark.createDataFrame([(1, "(unclosed", "x")], "rule_ord int, match string, replace string")
    try:
        U.rules_from_table(bad)
        raise AssertionError("bad regex must fail")
    except ValueError as e:
        assert "url_rewrites[0]" in str(e)
    d = tempfile.mkdtemp(prefix="pl-rules-")
    with open(os.path.join(d, "rules.json"), "w") as f:
        json.dump([{"match": "^http://", "replace": "https://"}], f)
    assert U.read_rules_json(spark, os.path.join(d, "rules.json")) == [("^http://", "https://")]


def test_content_type_and_snapshots(spark):
    rows = [("https://x/a", 200, "text/html; charset=UTF-8", b"<html><body>hi</body></html>"),
            ("https://x/b.pdf", 200, "application/pdf", b"%PDF-1.4 ..."),
            ("https://x/c", 200, "", b"%PDF-1.7 binary"),
            ("https://x/d", 200, "application/json", b'{"a":1}'),
            ("https://x/e", 304, "", b""),
            ("https://x/f", 404, "text/html", b"nope"),
            ("https://x/g", 200, "application/octet-stream", b"  <!DOCTYPE html><p>x")]
    snaps = SN.prepare_snapshots(spark.createDataFrame(rows, "url string, status int, content_type string, body binary"))
    got = {r.url: r for r in snaps.select("url", "not_modified", "error_kind",
                                          X.content_type(F.col("content_type"), F.col("body")).alias("ct")).collect()}
    assert got["https://x/a"].ct == "text/html"
    assert got["https://x/b.pdf"].ct == "application/pdf" and got["https://x/c"].ct == "application/pdf"
    assert got["https://x/d"].ct == "application/json"
    assert got["https://x/e"].not_modified and got["https://x/e"].error_kind is None
    assert got["https://x/f"].error_kind == "not_found"
    assert got["https://x/g"].ct == "text/html"


def test_scrape_batch_errors_llms_and_store(spark):
    html = "<html><head><title>Home</title></head><body><p>" + "word " * 80 + "</p></body></html>"
    snaps = SN.prepare_snapshots(spark.createDataFrame([
        ("https://site.test/", 200, "text/html", html),
        ("https://site.test/llms.txt", 200, "text/plain; charset=utf-8", "# Site\nllm text"),
        ("https://site.test/doc.pdf", 200, "application/pdf", "%PDF-1.4"),
        ("https://site.test/gone", 404, "text/html", "x"),
        ("https://site.test/page", 200, "text/html", html)],
        "url string, status int, content_type string, body string"))
    urls = spark.createDataFrame([(0, "https://site.test/"), (1, "https://site.test/doc.pdf"), (2, "https://site.test/gone"),
                                  (3, "https://site.test/missing"), (4, "https://site.test/page")], "input_pos int, url string")
    now = F.expr("TIMESTAMP '2025-01-01 00:00:00'")
    res, delta = CP.scrape_batch(urls, snaps, None, now)
    got = {r.input_pos: r for r in res.collect()}
    assert got[0].title == "llms.txt" and got[0].markdown.startswith("# Site")
    assert got[1].error_kind == "precondition"
    assert got[2].error_kind == "not_found" and got[3].error_kind == "not_found"
    assert got[4].title == "Home" and got[4].source == "http" and "word word" in got[4].markdown
    store = delta.cache()
    assert store.count() == 2
    res2, _ = CP.scrape_batch(urls.filter("input_pos = 4"), snaps, store, now)
    assert res2.first().from_store
    store.unpersist()


def test_cap_runs_and_sinks(spark):
    res = spark.createDataFrame([(f"https://s/{i:03d}", i % 3, None if i != 5 else "boom") for i in range(40)],
                                "url string, depth int, error string")
    kept, stopped = CR.cap_pages(res, max_pages=10)
    assert kept.count() == 10 and stopped == "max_pages"
    assert kept.agg(F.max("depth")).first()[0] == 0
    kept, stopped = CR.cap_pages(res, max_pages=500)
    assert kept.count() == 39 and stopped is None
    runs = spark.createDataFrame([("b", "2024-01-02"), ("a", "2024-01-03")], "id string, started_at string")
    assert [r.id for r in CR.list_runs(runs).collect()] == ["a", "b"]
    out = tempfile.mkdtemp(prefix="pl-sink-")
    df = spark.createDataFrame([("https://s/1", "T", 3, "new", "link", None)],
                               "url string, title string, words int, status string, source string, body string")
    CR.to_json_lines(df, out + "/j")
    line = spark.read.text(out + "/j").first().value
    assert json.loads(line) == {"url": "https://s/1", "title": "T", "words": 3, "status": "new", "source": "link"}
    CR.to_tsv(df, ["url", "title", "body"], out + "/t")
    assert spark.read.text(out + "/t").first().value == "https://s/1\tT\t"


def test_lang_stars_absolutize(spark):
    from pagelake.operators import codegrep as CG
    from pagelake.operators import nodes as N
    assert CG.normalize_lang("golang") == "Go" and CG.normalize_lang("rust") == "Rust" and CG.normalize_lang("") is None
    files = spark.createDataFrame([("org/a", "x.go", "Go", "package x\nfunc Find() {}\n", False, False),
                                   ("org/b", "y.go", "golang", "// find me\n", True, False),
                                   ("org/c", "z.py", "Python", "def find(): pass\n", False, True)],
                                  "repo string, path string, language string, text string, archived boolean, fork boolean")
    got = [(r.repo, r.line_no, r.snippet) for r in CG.grep_code(files, "find", lang="go").collect()]
    assert got == [("org/a", 2, "func Find() {}")]
    assert CG.grep_code(files, "find", include_archived=True, include_forks=True).count() == 3
    assert [r.line_no for r in CG.grep_code(files, r"def \w+\(", regexp=True).collect()] == []
    stars = spark.createDataFrame([("org/a", 5)], "repo string, stars int")
    s = {r.repo: r.stars for r in CG.add_stars(CG.grep_code(files, "find", include_archived=True), stars).collect()}
    assert s == {"org/a": 5, "org/b": None}
    pages = spark.createDataFrame([(1, "https://ex.com/d/p", '<a href="../x">x</a><img src="i.png">')],
                                  "page_id long, url string, html string")
    nodes = N.absolutize_attrs(N.html_nodes(pages), pages)
    got = sorted(v for r in nodes.filter("tag in ('a','img')").collect() for k, v in r.attrs.items())
    assert got == ["https://ex.com/d/i.png", "https://ex.com/x"]


def test_converter_hook_and_store_versions(spark):
    from pagelake.operators import store as ST
    snaps = SN.prepare_snapshots(spark.createDataFrame(
        [("https://s/doc.pdf", 200, "application/pdf", "%PDF-1.4 hello")], "url string, status int, content_type string, body string"))
    urls = spark.createDataFrame([(0, "https://s/doc.pdf")], "input_pos int, url string")
    conv = lambda df: df.select("input_pos", F.lit("pdf").alias("title"), F.lit("converted text").alias("markdown"))
    res, delta = CP.scrape_batch(urls, snaps, None, F.expr("TIMESTAMP '2025-01-01 00:00:00'"), converter=conv)
    r = res.first()
    assert (r.title, r.markdown, r.error) == ("pdf", "converted text", None)
    root = tempfile.mkdtemp(prefix="pl-store-")
    ST.write_version(delta, root, 1)
    ST.write_version(delta.withColumn("title", F.lit("v2")), root, 2)
    assert ST.read_store(spark, root).first().title == "v2"
    assert ST.read_store(spark, root, version=1).first().title == "pdf"


def test_linked_site_crawl_and_filters(spark):
    pages = [f"https://site.test/p{i}" for i in range(1, 6)]
    edges = spark.createDataFrame([(a, b + "#frag") for a in pages for b in pages if a != b] +
                                  [(pages[0], "https://other.test/x"), (pages[0], "https://site.test/p1/?utm_source=z")],
                                  "src_url string, dst_url string")
    seeds = spark.createDataFrame([(pages[0],)], "url string")
    out = {r.url: (r.depth, r.source) for r in CR.crawl(seeds, edges, max_depth=3).collect()}
    assert out == {pages[0]: (0, "seed"), **{p: (1, "link") for p in pages[1:]}}   # each page once
    out = {r.url for r in CR.crawl(seeds, edges, max_depth=3, deny=[r"/p3$"]).collect()}
    assert "https://site.test/p3" not in out and len(out) == 4
    out = {r.url for r in CR.crawl(seeds, edges, max_depth=3, allow=["/p2", "/p1"]).collect()}
    assert out == {pages[0], pages[1]}
    try:
        CR.crawl(seeds, edges, deny=["(bad"])
        raise AssertionError("bad deny must fail")
    except ValueError:
        pass


def test_rank_lists(spark):
    from pagelake.operators import fuse
    df = spark.createDataFrame([("q", 0, 5, "b"), ("q", 0, 2, "a"), ("q", 1, 9, "c")],
                               "query_id string, backend_ord int, pos int, url string")
    got = sorted((r.backend_ord, r.url, r.rank) for r in fuse.rank_lists(df).collect())
    assert got == [(0, "a", 1), (0, "b", 2), (1, "c", 1)]


def test_crawl_with_warm_store(spark):
    from pagelake.functions.text import cache_key
    pages = [f"https://site.test/p{i}" for i in range(1, 6)]
    edges = spark.createDataFrame([(a, b) for a in pages for b in pages if a != b], "src_url string, dst_url string")
    seeds = spark.createDataFrame([(pages[0],)], "url string")
    store = spark.createDataFrame([(pages[0], "2024-12-31 00:00:00", "http"), (pages[2], "2024-12-31 00:00:00", "http_shell")],
                                  "url string, cached_at string, source string") \
        .select(cache_key("url").alias("cache_key"), F.col("cached_at").cast("timestamp").alias("cached_at"), "source")
    now = F.expr("TIMESTAMP '2025-01-01 00:00:00'")
    warm = {r.url: r.status for r in CR.crawl(seeds, edges, store=store, now=now).collect()}
    assert warm[pages[0]] == "unchanged" and warm[pages[2]] == "new" and len(warm) == 5
    parity = {r.url: r.status for r in CR.crawl(seeds, edges, store=store, now=now, expand_hits=False).collect()}
    assert parity == {pages[0]: "unchanged"}      # a hit is not expanded (T7)
