"""SURVEY §2.12 semantics traps, one test each where we own the behaviour."""

from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions import urls as U
from pagelake.operators import fuse
from pagelake.operators import nodes as N
from pagelake.operators import shell as SH


def _lists(spark, rows):
    return spark.createDataFrame(
        [("q", b, o, r, u.upper(), f"https://t.example/{u}", "", "") for b, o, r, u in rows],
        "query_id string, backend string, backend_ord int, rank int, title string, url string, "
        "description string, content string")


def test_t1_exact_rrf_tie_decided_by_chain(spark):
    # ranks 3,3,3,17 and 6,6,6,6 have exactly equal RRF sums (2/33)
    rows = []
    for o, b in enumerate("abcd"):
        rows.append((b, o, 3 if o < 3 else 17, "x"))
        rows.append((b, o, 6, "y"))
    # filler so ranks exist as given
    for o, b in enumerate("abcd"):
        for r in range(1, 18):
            if not any(x[0] == b and x[2] == r for x in rows):
                rows.append((b, o, r, f"f{b}{r}"))
    out = fuse.rrf_fuse(_lists(spark, rows), depth=20).orderBy("fused_rank").collect()
    order = [r.url.rsplit("/", 1)[1] for r in out[:2]]
    assert order == ["x", "y"]                 # same tie group, 4 backends each, best rank 3 < 6
    assert abs(out[0].score - out[1].score) < 1e-9


def test_t3_t5_url_parsing_and_encoding(spark):
    df = spark.createDataFrame([("https://e.com/a b/c?q=%zz",), ("https://e.com/p?k=a~b*c d",)], "u string")
    got = [r.k for r in df.select(U.canonical_url("u").alias("k")).collect()]
    assert got == ["https://e.com/a b/c?q=%zz", "https://e.com/p?k=a~b%2Ac+d"]


def test_t6_nested_blocks_counted_repeatedly(spark):
    html = "<html><body><main><article><p>" + "word " * 10 + "</p></article></main></body></html>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    sig = SH.shell_signals(N.html_nodes(pages)).first()
    one = len(("word " * 10).strip())
    assert sig.vis_bytes == 3 * one + 2           # main, article and p each contribute the text


def test_t2_bytes_not_characters(spark):
    df = spark.createDataFrame([("é" * 15,)], "s string")
    r = df.select(F.octet_length("s").alias("b"), F.length("s").alias("c"),
                  T.truncate("s", 10).alias("t")).first()
    assert (r.b, r.c) == (30, 15) and r.t.startswith("é" * 10)


def test_t13_host_case(spark):
    df = spark.createDataFrame([("https://EXAMPLE.com/x",)], "u string")
    r = df.select(U.passes_filters("u", "example.com").alias("crawl_ok"),
                  U.canonical_url("u").alias("key")).first()
    assert r.crawl_ok is False and r.key == "https://example.com/x"
