"""Operator 13 against a search of every period, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.llm import periodic_runs as P
from tests.llm.helpers import empty_docs, odd_docs, sf_docs

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute(words):
    out, seen = [], set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and (s, i + q) not in seen:      # smaller periods come first
                seen.add((s, i + q))
                out.append((s, i + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(docs):
    return [list(zip(r.start.tolist(), r.length.tolist(), r.period.tolist())) for r in P.find_runs(docs)]


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    for n in (1, 2, 8, 64):
        a, b = (rng.integers(0, P.PRIME, n).astype(np.uint64) for _ in range(2))
        assert (P.transform(P.transform(a[None]), inverse=True)[0] == a).all()
        product = P.transform(P.transform(a[None]) * P.transform(b[None]) % np.uint64(P.PRIME), inverse=True)[0]
        want = [sum(int(a[i]) * int(b[(k - i) % n]) for i in range(n)) % P.PRIME for k in range(n)]
        assert product.tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4))
def test_any_short_words(docs):
    assert found(docs) == [brute(d) for d in docs]


@pytest.mark.parametrize("seed", range(6))
def test_planted_repeats(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(40):
        words = []
        while len(words) < rng.choice([0, 30, 300, 1500]):
            if rng.random() < 0.5:
                words += [b"%d" % rng.randrange(rng.choice([2, 50])) for _ in range(rng.randrange(40))]
            else:
                unit = [b"%d" % rng.randrange(rng.choice([2, 9])) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 31, 64, 70]))]
                words += (unit * 9)[:rng.randrange(3 * len(unit), 9 * len(unit))]
        docs.append(words)
    assert found(docs) == [brute(d) for d in docs]


def test_runs_nested_in_a_long_period():
    docs = [([b"a"] * 20 + [b"x"]) * 6, [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 3, [b"a", b"b"] * 4,
            [b"%d" % (i % 100) for i in range(401)], [b"%d" % (i % 100) for i in range(399)]]
    assert found(docs) == [brute(d) for d in docs]


@pytest.mark.parametrize("words,runs", [
    ([b"a"] * 400_000, [(0, 400_000, 1)]),
    ([b"%d" % (i % 50_000) for i in range(400_000)], [(0, 400_000, 50_000)]),
    ([b"%d" % i for i in range(400_000)], []),
])
def test_very_long_texts(words, runs):
    assert found([words]) == [runs]


def test_contract(spark):
    rows = [(r.doc_id, r.text) for r in sf_docs(spark).collect()]
    got = {r.doc_id: r for r in P.op13(sf_docs(spark)).collect()}
    assert P.op13(sf_docs(spark)).columns == COLUMNS and len(got) == len(rows)
    changed = 0
    for i, text in rows:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            changed += 1
        runs = brute(words)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want = (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
                hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())
        assert tuple(got[i]) == want
    assert changed and any(r.n_runs for r in got.values())


def test_odd_inputs(spark):
    docs = odd_docs(spark).withColumns({"start": F.lit(1), "words": F.lit("x"), "collapsed": F.lit(None)})
    rows = P.op13(docs.unionByName(docs)).collect()
    assert len(rows) == 2 * docs.count()
    assert all(sorted(map(str, rows)).count(str(r)) == 2 for r in rows)
    by_id = {r.doc_id: r for r in P.runs_of(docs).collect()}
    assert (by_id[0].n_words, by_id[0].collapsed, by_id[0].period) == (0, "", [])
    assert (by_id[10].start, by_id[10].length, by_id[10].period, by_id[10].collapsed) == ([0], [3000], [1], "long")
    assert by_id[None].collapsed == "a row without an id"
    assert P.op13(empty_docs(spark)).collect() == []


def test_batches_do_not_meet(spark, monkeypatch):
    texts = ["a b"] * 5 + ["a b a b a b a b", "b a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    assert [len(r.start) for r in P.runs_of(docs).orderBy("doc_id").collect()] == [0] * 5 + [1, 0]
