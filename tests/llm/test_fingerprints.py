"""Operator 11 against sets of shingles in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagelake.llm import fingerprints as P
from tests.llm.helpers import empty_docs, odd_docs, sf_docs

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_against_shingle_sets(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in sf_docs(spark).collect()), reverse=True)
    got = {r.doc_id: r for r in P.op11(sf_docs(spark)).collect()}
    assert len(got) == len(rows)
    off = []
    for k, (i, text) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(text)
        edited = text[:n - n // 3] + after[:n // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        off += [abs(got[i].near_edited - jaccard(text, edited)), abs(got[i].near_next - jaccard(text, after))]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.03


def test_equal_texts_and_changed_order(spark):
    docs = sf_docs(spark)
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(7)
    prints = P.fingerprints(twice).groupBy(F.col("doc_id") % 1000).agg(F.count_distinct("fingerprint").alias("n"))
    assert prints.agg(F.max("n")).first()[0] == 1
    a = sorted(P.op11(docs).collect())
    assert a == sorted(P.op11(docs.repartition(5)).collect())


@pytest.mark.parametrize("same", [0, 3, 20, 60, 100])
def test_estimate_has_no_bias(spark, same):
    """The mean over many pairs of sparse sets, most bins of which are empty."""
    rng = random.Random(same)
    pairs, want = [], []
    for _ in range(150):
        common = [f"c{rng.random()}" for _ in range(same)]
        pair = [common + [f"{side}{rng.random()}" for _ in range(20)] for side in "ab"]
        pairs.append(tuple(" ".join(w) for w in pair))
        want.append(same / (same + 40))
    df = spark.createDataFrame(pairs, "a string, b string")
    made = df.select(*[P.fingerprint(F.col(c), words=1).alias(c) for c in "ab"])
    mean = made.agg(F.avg(P.likeness(F.col("a"), F.col("b")))).first()[0]
    assert abs(mean - want[0]) < 0.02


def test_single_shingles_do_not_agree_by_one_chance(spark):
    df = spark.createDataFrame([(f"word{i}", f"other{i}") for i in range(600)], "a string, b string")
    made = df.select(*[P.fingerprint(F.col(c)).alias(c) for c in "ab"]).select(P.likeness(F.col("a"), F.col("b")).alias("l"))
    assert made.agg(F.max("l")).first()[0] < 0.1


def test_sixteen_bits(spark):
    df = spark.createDataFrame([("a b c d e f g h", "a b c d e f g x")], "a string, b string")
    made = df.select(*[P.fingerprint(F.col(c), words=1, bits=16).alias(c) for c in "ab"])
    row = made.select(F.length("a"), P.likeness(F.col("a"), F.col("b"), bits=16)).first()
    assert row[0] == 512 and abs(row[1] - 7 / 9) < 0.15
    with pytest.raises(ValueError):
        P.fingerprint(F.col("a"), bits=5)


def test_odd_inputs(spark):
    docs = odd_docs(spark)
    wide = docs.withColumns({"i": F.lit("x"), "z": F.lit(1), "next": F.lit(2), "fp": F.lit(3)})
    rows = P.op11(wide.unionByName(wide)).collect()
    assert len(rows) == 2 * docs.count() and P.op11(empty_docs(spark)).columns == COLUMNS
    assert P.op11(empty_docs(spark)).collect() == []
    by_id = {r.doc_id: r for r in rows}
    assert all(sorted(map(str, rows)).count(str(r)) == 2 for r in rows)
    assert by_id[0].fingerprint == by_id[1].fingerprint == by_id[2].fingerprint == ""
    assert by_id[4].fingerprint == by_id[5].fingerprint != ""
    assert by_id[1].near_next == 1.0 and by_id[1].n_chars == 0
    # the last of all is followed by the first
    first, last = by_id[14], by_id[None]
    text = "a row without an id"
    assert last.edited_sha256 == hashlib.sha256((text[:13] + docs.where("doc_id = 14").first().text[:6]).encode()).hexdigest()
    assert first.fingerprint != last.fingerprint


def test_very_long_text(spark):
    words = " ".join(str(i % 30011) for i in range(300_000))
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in P.fingerprints(docs).collect()}
    same = sum(a == b for a, b in zip(*(map("".join, zip(got[k][::2], got[k][1::2])) for k in (1, 2))))
    assert same >= 126 and len(got[3]) == 256


def test_native(spark):
    plan = P.op11(sf_docs(spark))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan
