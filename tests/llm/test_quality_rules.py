import re

import duckdb
from pyspark.sql import functions as F

from pagelake.llm import quality_rules as q
from tests.llm.helpers import SF, empty_docs, odd_docs, sf_docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 8)} if len(set(wins)) < len(wins) else set()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_equals_brute_force_on_odd_and_given_texts(spark):
    extra = [(100, "a b c d e f g h " * 3 + "x y z " * 9 + "\nq\nq\n q\n", "", "", 0), (101, "w " * 30, "", "", 0),
             (102, " ".join(f"u{i}" for i in range(25)), "", "", 0)]
    odd = odd_docs(spark).union(spark.createDataFrame(extra, odd_docs(spark).schema))
    odd = odd.where(F.length("text").isNull() | (F.length("text") < 20000) & ~F.col("text").startswith("long"))
    for docs in (odd, sf_docs(spark)):
        texts = sorted(((r.doc_id is None, r.doc_id), brute(r.text)) for r in docs.collect())
        got = sorted(((r.doc_id is None, r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
                     for r in q.op1(docs).collect())
        assert got == texts


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = q.op1(sf_docs(spark))
    want = con.execute(f"select {', '.join(df.columns)} from ({q.ORACLE})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_policies_and_ablation_follow_the_bits(spark):
    led = q.ledger(sf_docs(spark)).cache()
    rows = led.collect()
    kept = q.apply_policy(led, q.V1).where("kept").count()
    assert kept == sum(r.failed & q.V1.mask() == 0 for r in rows)
    names = list(q.RULES)
    for r in q.ablation(led, q.V1).collect():
        bit = 1 << names.index(r.rule)
        assert r.n_failed == sum(bool(x.failed & bit) for x in rows)
        assert r.n_failed_alone == sum(x.failed == bit for x in rows)
        assert r.n_kept_without == sum(x.failed & ~bit == 0 for x in rows)
    led.unpersist()


def test_clean_documents_stay_and_columns_too(spark):
    docs = sf_docs(spark).withColumn("failed", F.lit("mine"))
    out = q.filter_stage(docs)
    assert out.columns == docs.columns
    judged = {r.doc_id for r in q.op1(docs).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == judged


def test_empty(spark):
    assert q.op1(empty_docs(spark)).count() == 0
    assert {r.n_failed for r in q.ablation(q.ledger(empty_docs(spark)), q.V1).collect()} == {0}


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = q.op1(sf_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
