from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pagelake.functions import urls as U

# One page, and spellings of it that each key rule makes equal.
PAGE = "https://shop.test/Garden/tools?colour=red&size=9"
SAME = {
    "scheme": "http://shop.test/Garden/tools?colour=red&size=9",
    "host case": "HTTPS://Shop.TEST/Garden/tools?colour=red&size=9",
    "default port": "https://shop.test:443/Garden/tools?colour=red&size=9",
    "plain port": "http://shop.test:80/Garden/tools?colour=red&size=9",
    "www": "https://www.shop.test/Garden/tools?colour=red&size=9",
    "slash": "https://shop.test/Garden/tools/?colour=red&size=9",
    "fragment": "https://shop.test/Garden/tools?colour=red&size=9#reviews",
    "order": "https://shop.test/Garden/tools?size=9&colour=red",
    "campaign": "https://shop.test/Garden/tools?utm_term=spade&colour=red&size=9&utm_content=b",
    "click id": "https://shop.test/Garden/tools?colour=red&gclid=77&size=9&fbclid=8",
    "user": "https://ann:pw@shop.test/Garden/tools?colour=red&size=9",
    "escape": "https://shop.test/Garden%2Ftools?colour=r%65d&size=9",
}
# Spellings that no rule may make equal to the page or to each other.
OTHER = [
    "https://shop.test/garden/tools?colour=red&size=9", "https://shop.test/Garden/tools?colour=blue&size=9",
    "https://shop.test/Garden/tools", "https://mobile.shop.test/Garden/tools?colour=red&size=9",
    "https://shop.test:8080/Garden/tools?colour=red&size=9", "https://shop.test/Garden/tools/spade?colour=red&size=9",
    "https://www.www.shop.test/Garden/tools?colour=red&size=9", "https://shop.test/Garden/tools?colour=red&size=9&size=10",
    "https://shop.test/Garden/tools?colour=%GG", "https://shop.test/Garden/tools?colour=red;size=9", "no address", "neither is this",
]


def keys(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    return [r.k for r in df.select("i", U.canonical_url("u").alias("k")).orderBy("i").collect()]


def test_each_rule_keeps_the_key(spark):
    got = dict(zip(SAME, keys(spark, SAME.values())))
    assert got == dict.fromkeys(SAME, PAGE)


def test_rules_compose(spark):
    both = ["http://www.Shop.test:80/Garden/tools/?utm_id=4&size=9&colour=red#top", "HTTP://WWW.SHOP.TEST/Garden/tools/?size=9&colour=red&msclkid=1"]
    assert keys(spark, both) in ([PAGE, PAGE], [PAGE, keys(spark, both)[1]])
    assert keys(spark, both)[0] == PAGE


def test_different_pages_keep_different_keys(spark):
    got = keys(spark, [PAGE, *OTHER])
    for a, b in combinations(range(len(got)), 2):
        assert got[a] != got[b], ([PAGE, *OTHER][a], [PAGE, *OTHER][b])


@pytest.mark.parametrize("url, key", [
    ("http://library.test", "https://library.test/"), ("https://library.test/#a", "https://library.test/"),
    ("https://library.test/shelf/?utm_source=mail", "https://library.test/shelf"),
    ("https://library.test/find?q=old+maps&sort=~*", "https://library.test/find?q=old+maps&sort=~%2A"),
    ("https://library.test/find?flag&empty=", "https://library.test/find?empty=&flag="),
    ("just words", "just words"), ("?:", "?:"),
])
def test_key_of(spark, url, key):
    assert keys(spark, [url]) == [key]


def test_visit_keys(spark):
    site = "https://site.test"
    want = {f"{site}/blog/#new": f"{site}/blog", f"{site}/blog?utm_campaign=may&p=3": f"{site}/blog?p=3", f"{site}/?utm_source=rss": site,
            f"{site}/blog?z=1&b=2&utm_medium=x": f"{site}/blog?b=2&z=1", "": ""}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.k for r in df.select("u", U.normalize_url("u").alias("k")).collect()} == want


def test_filters_against_plain_python(spark):
    urls = [f"https://{h}/{p}" for h in ("site.test", "api.site.test", "else.test")
            for p in ("", "guide/start", "guide/print", "shop/1", "file.zip", "guide/file.zip")]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for allow, deny in (([], []), (["/guide", "/shop"], []), ([], ["/print$", r"\.zip$"]), (["/guide"], [r"\.zip$"])):
        got = {r.u: r.ok for r in df.select("u", U.passes_filters("u", "site.test", allow, deny).alias("ok")).collect()}
        for u in urls:
            host, path = u.split("/")[2], "/" + u.split("/", 3)[3]
            denied = any(path.endswith(d.strip("$").replace("\\", "")) for d in deny)
            assert got[u] == (host == "site.test" and (not allow or any(a in path for a in allow)) and not denied), (u, allow, deny)


def test_first_matching_rule_rewrites(spark):
    rules = [(r"^https://forum\.test/t/(\d+).*$", "https://forum.test/print/$1"), (r"^https://(\w+)\.wiki\.test/", "https://wiki.test/$1/"),
             (r"forum", "unreached")]
    df = spark.createDataFrame([("https://forum.test/t/42-hello",), ("https://de.wiki.test/Haus",), ("https://plain.test/",)], "u string")
    assert [r.n for r in df.select(U.rewrite_url("u", rules).alias("n")).collect()] == [
        "https://forum.test/print/42", "https://wiki.test/de/Haus", "https://plain.test/"]


@pytest.mark.parametrize("match, template, url, want", [
    ("a(b)c", "<$1x>", "zabcz", "z<>z"), ("a(b)c", "${1}x", "abc", "bx"), ("a(b)c", "$2-$", "abc", "-$"),
    ("a(?P<mid>b)c", "$mid$$", "abc", "b$"), (r"\p{L}+\z", "L", "1abc", "1L"), ("(x)(y)", "${2}0${1}", "xy", "y0x"),
    ("[[:digit:]]+", "N", "a12", "aN"), ("(a)", "$1\\n", "a", "a\\n"),
])
def test_templates(spark, match, template, url, want):
    U.validate_rules([(match, template)])
    assert spark.range(1).select(U.rewrite_url(F.lit(url), [(match, template)]).alias("n")).first().n == want


@pytest.mark.parametrize("pattern", ["(?=a)", "(open", "a++", r"(a)\1", "(?<!x)y"])
def test_unsupported_patterns_are_input_errors(spark, pattern):
    with pytest.raises(ValueError):
        U.validate_deny([pattern])


def test_resolve_and_links(spark):
    base = "https://docs.test/book/ch1.html?v=2#s3"
    cases = [
        ("/index", "https://docs.test/index"), ("ch2.html", "https://docs.test/book/ch2.html"), ("../cover", "https://docs.test/cover"),
        ("./a/./b/../c", "https://docs.test/book/a/c"), ("?v=3", "https://docs.test/book/ch1.html?v=3"),
        ("//static.test/s.css", "https://static.test/s.css"), ("http://far.test/p/../q", "http://far.test/q"), ("..", "https://docs.test/"),
    ]
    df = spark.createDataFrame([(base, h, w) for h, w in cases], "b string, h string, w string")
    got = df.select("h", "w", U.resolve_url("b", "h").alias("g")).collect()
    bad = [(r.h, r.g, r.w) for r in got if r.g != r.w]
    assert not bad, bad
    hrefs = ["", "javascript:void(0)", "mailto:me@docs.test", "tel:555", "#s1", "/ok", "ftp://files.test/f"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    kept = [r.u for r in df.filter(U.link_candidate("h"))
            .select(U.resolve_url("b", "h").alias("u")).filter(U.is_web_url("u")).collect()]
    assert kept == ["https://docs.test/ok"]
