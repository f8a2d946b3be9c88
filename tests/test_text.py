from pyspark.sql import functions as F

from pagelake.functions import text as T

MARKS = {"**{}**": "{}", "__{}__": "{}", "*{}*": "{}", "_{}_": "{}", "`{}`": "{}", "[{}](http://a.test/x)": "{}", "***{}***": "{}",
         "![{}](pic.jpg)": ""}
WORDS = ["river", "two words", "x1"]
STRIP_CASES = [(m.format(w), w if p else "") for m, p in MARKS.items() for w in WORDS] + [
    ("## " + w, w) for w in WORDS] + [
    ("* milk\n* *cold* tea", "* milk\n* cold tea"),
    ("The **deep** `lake` and [its shore](shore.html).", "The deep lake and its shore."),
    ("```\n**kept** as is\n```", "```\n**kept** as is\n```"),
    ("_one_ ```a _b_``` __two__ ```*c*``` *three*", "one ```a _b_``` two ```*c*``` three"),
]


def test_strip_markdown(spark):
    df = spark.createDataFrame(STRIP_CASES, "i string, w string")
    got = df.select("i", "w", T.strip_markdown("i").alias("g")).collect()
    bad = [(r.i, r.g, r.w) for r in got if r.g != r.w]
    assert not bad, bad


def test_truncate_counts_code_points(spark):
    df = spark.createDataFrame([("héllo wörld",), ("short",)], "s string")
    got = [r.t for r in df.select(T.truncate("s", 5).alias("t")).collect()]
    assert got == ["héllo\n\n[truncated]", "short"]
    assert [r.t for r in df.select(T.truncate("s", 0).alias("t")).collect()] == ["héllo wörld", "short"]


def test_words_lines_hash(spark):
    df = spark.createDataFrame([("  a b\tc\n\nd  ", "\n \n  first line  \nsecond")], "a string, b string")
    r = df.select(T.word_count("a").alias("w"), T.first_line("b").alias("f"),
                  T.content_hash(F.lit("abc")).alias("h"), T.normalize_ws("a").alias("n")).first()
    assert r.w == 4
    assert r.f == "first line"
    assert r.h == "ba7816bf8f01cfea"
    assert r.n == "a b c d"


def test_best_and_matched_line(spark):
    text = "\n  def foo():\n    return Bar\n--- Snippet 2 (Line 40) ---\nbar again"
    df = spark.createDataFrame([(text, "const x = 1;\nlet y = find(z);\n", 22)], "t string, f string, o int")
    r = df.select(T.best_line("t", 10, "bar").alias("b"), T.best_line("t", 10, "nothing").alias("n"),
                  T.matched_line("f", "o").alias("m"), T.matched_line("f", F.lit(-1)).alias("m2")).first()
    assert (r.b.line, r.b.line_no) == ("return Bar", 12)
    assert (r.n.line, r.n.line_no) == ("def foo():", 11)
    assert r.m == "let y = find(z);"
    assert r.m2 == "const x = 1;"


def test_redirect_pipe_errors_ttl(spark):
    df = spark.createDataFrame(
        [("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fex.com%2Fa%3Fb%3D1&rut=x",), ("https://plain.org/x",)], "u string")
    got = [r.u for r in df.select(T.unwrap_redirect("u").alias("u")).collect()]
    assert got == ["https://ex.com/a?b=1", "https://plain.org/x"]
    df = spark.createDataFrame([("| a |\n|---|\n| 1 |", "timeout"), ("plain", "weird")], "m string, r string")
    got = df.select(T.has_pipe_table("m").alias("p"), T.error_kind("r").alias("k")).collect()
    assert [(r.p, r.k) for r in got] == [(True, "cancelled"), (False, "upstream")]
    assert T.parse_ttl_seconds("72h") == 259200
    assert T.parse_ttl_seconds("bogus") == 3600
    assert T.parse_ttl_seconds("1h30m") == 5400
