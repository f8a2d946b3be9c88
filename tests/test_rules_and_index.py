"""Rules as a table (D6) and the trigram index of code search."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.functions.literals import required_literal, term_grams
from pagelake.operators import codegrep as CG
from pagelake.operators import codeindex as CI
from pagelake.operators import rewrite as RW

RULES = "rule_ord long, match string, replace string"


@pytest.mark.parametrize("pattern,literal", [
    (r"^https?://www\.Shop\.test/", "://www.shop.test/"), (r"a|bcd", ""), (r"(?i)Foo\(", "foo("), (r"(?P<n>Foo)bars", "bars"),
    (r"x(abc)?yz", "yz"), (r"x(abc)+y", "abc"), (r"ab+cde", "cde"), (r"abc*d", "ab"), (r"abc{0,2}d", "ab"), (r"[abc]def[^]]gh", "def"),
    (r"\x41bcd", "bcd"), (r"\p{Lu}oo", "oo"), (r"(a|bcd)efg", "efg"), (r"(?u)abc", ""), (r"(abc", ""), (r"", ""), (r"é12", "12"), (r"\Qabc\Exyz", "xyz"),
    (r"(?:abc(?:def|g)h)i", "abc"), (r"[[:alpha:]\]]xyz", "xyz"), (r"abc??d", "ab"), (r"abc{2}d", "abc"),
])
def test_what_a_pattern_requires(pattern, literal):
    assert required_literal(pattern) == literal


def test_each_match_contains_the_required_text():
    texts = ["https://www.shop.test/a?b=1", "abcabcd", "aabbcc", "x", "xyabcyz", "ABCdef"]
    for pattern in [r"a+b", r"(ab)?c", r"(?:a|b)c", r"ab?c", r"[^a]b", r"x.?y", r"(?i)abc(def)?", r"sh(o)p\.", r"a{0}b", r"a{1,}b"]:
        for text in texts:
            if re.search(pattern, text):
                assert required_literal(pattern) in text.lower()


def test_rules_from_a_table_equal_the_short_list(spark):
    rules = [(10 * i, rf"^https://site{i}\.test/(\w+)", f"https://m{i}.test/$1") for i in range(600)]
    rules += [(5, r"(?i)SITE7\.TEST/special", "site7.test/x"), (9_000, r"\d$", "N"), (9_001, r"[^/]$", "Z"), (9_002, "^", "p:")]
    rules += [(9_500 + i, rf"[{i % 7}]{{{i + 1}}}x", "") for i in range(2 * RW.OPEN_BLOCK)]   # no text of three characters
    urls = [f"https://site{i}.test/page{i}" for i in range(0, 700, 3)] + ["https://site7.test/special", "https://SITE7.test/special", "", "a/", "é", None]
    urls += ["https://site3.test/dup"] * 3
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "n int, url string, fetch_url string")
    table = spark.createDataFrame(rules[::-1] + [(None, "x", "y"), (1, None, "y")], RULES)
    got = {r.n: (r.fetch_url, r.rule_ord) for r in RW.rewrite_by_table(df, table).collect()}
    ordered = [(m, r) for _, m, r in sorted(rules)[:60]] + [(m, r) for _, m, r in sorted(rules)[-2 * RW.OPEN_BLOCK - 3:]]
    assert len(got) == len(urls)
    few = df.where(F.col("n") < 14).select("n", U.rewrite_url("url", ordered[:63]).alias("f")).collect()
    assert {r.n: r.f for r in few} == {n: got[n][0] for n in range(14)}

    def brute(u):
        for at, match, rep in sorted(rules):
            if re.search(match, u):
                return re.sub(match, rep.replace("$1", r"\1"), u), at
        return u, None
    for i, u in enumerate(urls):
        assert got[i] == ((None, None) if u is None else brute(u)), u


def test_rules_without_rows_and_bad_rules(spark):
    urls = spark.createDataFrame([("https://a.test/",)], "url string")
    none = RW.rewrite_by_table(urls, spark.createDataFrame([], RULES))
    assert [tuple(r) for r in none.collect()] == [("https://a.test/", "https://a.test/", None)]
    assert RW.rewrite_by_table(urls.limit(0), spark.createDataFrame([(1, "a", "b")], RULES)).count() == 0
    for bad in ("(?=x)", "never(seen"):
        with pytest.raises(Exception):
            RW.rewrite_by_table(urls, spark.createDataFrame([(7, bad, "")], RULES)).collect()


def test_rules_meet_urls_by_equi_joins(spark):
    urls = spark.range(10).select(F.concat(F.lit("https://s"), F.col("id").cast("string"), F.lit(".test/")).alias("url"))
    rules = spark.range(10).select(F.col("id").alias("rule_ord"), F.concat(F.lit("s"), F.col("id").cast("string"), F.lit(r"\.test")).alias("match"), F.lit("").alias("replace"))
    plan = RW.rewrite_by_table(urls, rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


FILES = [("r", f"f{i}.go", "go", f"package p{i}\n// Number {i}\nfunc Find{i % 7}(x int) {{ return x }}\n") for i in range(60)] + [
    ("r", "empty", "go", ""), ("r", "null", "go", None), ("r", "two", "go", "ab"), ("q", "same", "py", "def find3(): pass"), ("q", "same", "py", "def find3(): pass"),
    ("q", "acc", "py", "# größe\nx = 'ÄRGER find'"), ("q", "long", "py", "needle " + "word " * 200_000)]


@pytest.mark.parametrize("term,regexp", [
    ("find3", False), ("FIND", False), ("needle", False), ("absent term", False), ("zq", False), ("ärger", False), ("größe", False), ("return x }", False),
    (r"func\s+Find[35]\(", True), (r"(?i)FIND3", True), (r"^x", True), (r"Find3|needle", True), (r"absent\d+", True), ("", False)])
def test_the_index_answers_like_a_scan(spark, index, term, regexp):
    root, files = index
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(CI.search(spark, root, term, regexp)) == rows(CG.grep_code(files, term, regexp=regexp))


def test_a_search_reads_the_blocks_that_it_needs(spark, index):
    root, _ = index
    assert spark.read.parquet(f"{root}/files").select("block").distinct().count() > 3
    assert {tuple(r) for r in CI.candidates(spark, root, "needle").join(CI._files(spark, root), ["block", "file"]).select("path").collect()} == {("long",)}
    assert CI.candidates(spark, root, "zq") is None and CI.candidates(spark, root, "absent term").count() == 0
    df = CI.search(spark, root, "needle")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    none = spark.read.parquet(f"{root}/files").where("path IN ('empty', 'null', 'two')").select("block", "file")
    posted = spark.read.parquet(f"{root}/postings").select("block", F.explode("files").alias("file"), "gram")
    assert none.count() == 3 and posted.join(none, ["block", "file"]).count() == 0 and posted.count() == posted.distinct().count()
    assert term_grams("abcab", 3) == ["abc", "bca", "cab"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    files = spark.createDataFrame(FILES, "repo string, path string, language string, text string")
    root = str(tmp_path_factory.mktemp("index") / uuid.uuid4().hex)
    CI.build(files.repartition(7), root)
    return root, files


def test_an_index_of_no_files(spark, tmp_path):
    files = spark.createDataFrame([], "repo string, path string, language string, text string")
    CI.build(files, str(tmp_path / "none"))
    assert CI.search(spark, str(tmp_path / "none"), "find").count() == 0
    with pytest.raises(ValueError):
        CI.build(files.withColumn("block", F.lit(1)), str(tmp_path / "clash"))


def test_grams_of_urls_are_never_broadcast(spark, tmp_path):
    # a table of a few bytes a URL, whose grams are a hundred times as much
    urls = spark.range(200).select(F.concat(F.lit("https://site.example.com/a/long/path/of/page/"), F.col("id").cast("string")).alias("url"))
    urls.write.parquet(f"{tmp_path}/urls")
    rules = spark.createDataFrame([(1, r"page/1(\d)$", "first/$1"), (2, "[0-9]$", "$0/")], RULES)
    out = RW.rewrite_by_table(spark.read.parquet(f"{tmp_path}/urls"), rules)
    assert not [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin [gram" in x or "BroadcastHashJoin [_b" in x]
    got = {r.url.rsplit("/", 1)[1]: (r.fetch_url.split("/page/")[-1].split(".com/a/long/path/of/")[-1], r.rule_ord) for r in out.collect()}
    assert len(got) == 200 and got["15"] == ("first/5", 1) and got["150"] == ("150/", 2)
