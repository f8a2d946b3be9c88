from pyspark.sql import functions as F

from pagelake.operators import cookies as CK
from pagelake.operators import health as H
from pagelake.operators import store as ST
from pagelake.sources import payloads as PL

NOW = "TIMESTAMP '2025-01-01 00:00:00'"


def test_cookie_lines_and_scope(spark):
    lines = [
        (1, "example.com\tFALSE\t/\tFALSE\t0\tsid\tabc"),
        (2, "#HttpOnly_.example.com\tTRUE\t/docs\tTRUE\t0\ttok\tv\twith\ttabs"),
        (3, "# a comment"),
        (4, ""),
        (5, "bad_domain!\tTRUE\t/\tFALSE\t0\tx\ty"),
        (6, "example.com\tMAYBE\t/\tFALSE\t0\tx\ty"),
        (7, "example.com\tTRUE\tnoslash\tFALSE\t0\tx\ty"),
        (8, "example.com\tTRUE\t/\tFALSE\t100\told\tz"),
        (9, "example.com\tTRUE\t/\tFALSE\t-5\tneg\tz\r"),
        (10, "example.com\tTRUE\t/\tFALSE\t0\t\tnoname"),
    ]
    df = spark.createDataFrame(lines, "line_no int, line string")
    parsed = CK.parse_cookie_lines(df, F.expr(NOW)).cache()
    st = {r.jar_ord: r.status for r in parsed.collect()}
    assert st[1] == "ok" and st[2] == "ok" and st[8] == "expired"
    assert all(st[i] == "skip" for i in (3, 4, 5, 6, 7, 9, 10))
    row2 = parsed.filter("jar_ord = 2").first()
    assert row2.http_only and row2.value == "v\twith\ttabs" and not row2.host_only and row2.domain == "example.com"
    counts = CK.jar_counts(parsed).first()
    assert (counts.live, counts.expired) == (2, 1)
    jar = parsed.filter("status = 'ok'")
    urls = spark.createDataFrame([("https://example.com/docs/a",), ("http://example.com/docs",),
                                  ("https://sub.example.com/docs/x",), ("https://example.com/docsx",)], "url string")
    got = {r.url: r.cookie_header for r in CK.match_cookies(urls, jar, F.expr(NOW)).collect()}
    assert got["https://example.com/docs/a"] == "tok=v\twith\ttabs; sid=abc"   # longest path first
    assert got["http://example.com/docs"] == "sid=abc"                          # secure needs https
    assert got["https://sub.example.com/docs/x"] == "tok=v\twith\ttabs"         # host-only sid not shared
    assert got["https://example.com/docsx"] == "sid=abc"                        # path boundary
    parsed.unpersist()


def test_health_rollup(spark):
    rows = [("search", "brave", 1, 3, "ok", "", 10, True), ("search", "brave", 2, 3, "misconfigured", "401", 12, True),
            ("search", "brave", 3, 3, "misconfigured", "403", 9, True),
            ("search", "exa", 1, 2, "ok", "", 5, False), ("search", "exa", 2, 2, "ok", "", 6, False),
            ("code", "gh", 1, 1, "skipped", "", 0, True)]
    df = spark.createDataFrame(rows, "surface string, backend string, key_ord int, n_keys int, status string, "
                                     "detail string, latency_ms long, required boolean")
    r = {(x.surface, x.backend): x for x in H.health_rollup(df).collect()}
    assert r[("search", "brave")].status == "misconfigured"
    assert r[("search", "brave")].detail == "key 2 of 3: 401; key 3 of 3: 403"
    assert r[("search", "exa")].detail == "2 keys accepted"
    assert H.failing_surfaces(H.health_rollup(df)).first().failing == 1


def test_store_ttl_and_upsert(spark):
    rows = [("k1", "2024-12-30 00:00:00", "http", "new md", "<html>"),
            ("k1", "2024-12-01 00:00:00", "http", "old md", "<old>"),
            ("k2", "2024-12-31 12:00:00", "http_shell", "shell", ""),
            ("k3", "2024-12-31 12:00:00", "", "legacy", "")]
    store = spark.createDataFrame(rows, "cache_key string, cached_at string, source string, markdown string, "
                                        "raw_html string").withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    latest = {r.cache_key: r.markdown for r in ST.latest_per_key(store).collect()}
    assert latest == {"k1": "new md", "k2": "shell", "k3": "legacy"}
    now = F.expr(NOW)
    st = ST.latest_per_key(store)
    fresh = {r.cache_key: r.f for r in st.select("cache_key", ST.is_fresh(F.col("cached_at"), now, 72 * 3600)
                                                  .alias("f")).collect()}
    assert fresh == {"k1": True, "k2": True, "k3": True}
    stale = {r.cache_key: r.s for r in st.select("cache_key", ST.stale_for_render(F.col("source"), True)
                                                  .alias("s")).collect()}
    assert stale == {"k1": False, "k2": True, "k3": True}
    up = ST.upsert(store, spark.createDataFrame([("k1", "2024-12-31 00:00:00", "browser", "newer", "<x>")],
                                                 store.schema.simpleString().replace("timestamp", "string"))
                   .withColumn("cached_at", F.col("cached_at").cast("timestamp")), keep_raw=False)
    r = up.filter("cache_key = 'k1'").first()
    assert r.markdown == "newer" and r.raw_html is None


def test_payload_shapes(spark):
    raw = spark.createDataFrame([
        ("q", "brave", 0, '{"web":{"results":[{"title":"T1","url":"https://a","description":"d1"},'
                          '{"title":"T2","url":"https://b","description":"d2"}]}}'),
        ("q", "searxng", 1, '{"results":[{"title":"S","url":"https://s","content":"c"}]}'),
        ("q", "firecrawl", 2, '{"success":true,"data":{"web":[{"title":"x","url":""},{"title":"F","url":"https://f"}]}}'),
    ], "query_id string, backend string, backend_ord int, body string")
    got = [(r.backend, r.rank, r.url, r.description) for r in PL.normalize_search(raw).orderBy("backend_ord", "rank").collect()]
    assert got == [("brave", 1, "https://a", "d1"), ("brave", 2, "https://b", "d2"), ("searxng", 1, "https://s", "c"),
                   ("firecrawl", 1, "https://f", "")]
    sse = spark.createDataFrame([("event: x\ndata: {\"a\":1}\n\ndata: \ndata: {\"a\":2}\n",)], "b string")
    assert sse.select(PL.sse_last_data(F.col("b")).alias("d")).first().d == '{"a":2}'


def test_url_lists_and_limits(spark):
    import tempfile, os
    d = tempfile.mkdtemp(prefix="pl-urls-")
    with open(os.path.join(d, "urls.txt"), "w") as f:
        f.write("  https://a.example/ \n\n# comment\nhttps://b.example\n")
    got = [r.url for r in PL.read_url_list(spark, os.path.join(d, "urls.txt")).orderBy("input_pos").collect()]
    assert got == ["https://a.example/", "https://b.example"]
    df = spark.createDataFrame([('["https://x", "https://y"]',), ("[]",), ("not json",)], "body string")
    rows = PL.urls_from_json(df).collect()
    assert sorted(r.url for r in rows if r.url) == ["https://x", "https://y"]
    assert sum(1 for r in rows if r.error_kind == "validation") == 2
    assert PL.backend_limit("brave", 50) == 20 and PL.backend_limit("brave", 0) == 0
    assert PL.backend_limit("github", 0) == 30 and PL.backend_limit("github", 101) == 30
    assert PL.backend_limit("keenable", -1) == 0
