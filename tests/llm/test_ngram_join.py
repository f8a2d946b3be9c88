import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import ngram_join as nj
from pagelake.llm.components import components
from tests.llm.helpers import SCHEMA, empty_docs, odd_docs, sf_docs


def brute(rows, k=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                n = len(sets[i] & sets[j])
                if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is None, d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))))


def got(docs, sim=nj.Similarity()):
    return sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_components(docs, sim).collect())


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def near_copies(seed, n=160):
    """Families of edited copies around the threshold, and a shared passage."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    texts = []
    for f in range(4):
        base = [f"{rnd.choice('abcdef')}{rnd.randrange(40)}" for _ in range(rnd.choice([6, 30, 90]))]
        for _ in range(n // 8):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    for i in range(n // 4):
        texts.append(" ".join(passage + [f"r{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))]))
    texts += texts[: n // 8] + ["A b C d E"] * 12 + ["a B c d e"] * 3 + ["a b c"] * 3 + ["a b c d"] * 2
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_on_near_copies(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], SCHEMA)
    assert got(docs) == brute(rows)


def test_equals_brute_force_on_given_and_odd_texts(spark):
    for docs in (sf_docs(spark), odd_docs(spark).withColumn("class", F.lit(1)), empty_docs(spark)):
        assert got(docs) == brute(rows_of(docs))


def test_repeated_ids_are_separate_documents(spark):
    rows = near_copies(5, 40)
    rows = [(d % 30, t) for d, t in rows]
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], SCHEMA)
    want = [(d, n, c) for _, d, n, c in brute(rows)]
    assert [(d, n, c) for _, d, n, c in got(docs)] == want


def test_alternating_sets(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words + ([f"z{i}"] if i % 2 else []))) for i in range(40)] + [(100 + i, f"other {i} text here now") for i in range(5)]
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], SCHEMA)
    assert got(docs) == brute(rows)


@pytest.mark.parametrize("size", [1, 300, 2000])
def test_clusters_of_many_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", size)
    rows = near_copies(9, 80)
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], SCHEMA)
    assert got(docs) == brute(rows)


@pytest.mark.parametrize("star", [1, 10 ** 6])
def test_long_lists_in_blocks(spark, monkeypatch, star):
    monkeypatch.setattr(nj, "STAR", star)
    monkeypatch.setattr(nj, "BLOCK_CLASSES", 5)
    monkeypatch.setattr(nj, "AT_ONCE", 7)
    rows = near_copies(9, 80)
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], SCHEMA)
    assert got(docs, nj.Similarity(5, 80)) == brute(rows, 5, 80)


def test_phrases_that_texts_share_join_nothing(spark, monkeypatch):
    """Texts of common phrases: nearly all share some with others, hardly any is a near copy."""
    rnd = random.Random(3)
    phrases = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(60)}" for _ in range(10)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(phrases, k=12))) for i in range(400)]
    rows += [(400 + i, f"{rows[i][1]} and more") for i in range(20)]
    sizes, texts = [], nj._class_texts

    def seen(docs, clusters, *more):
        sizes.extend(r["count"] for r in clusters.groupBy("cluster").count().collect())
        return texts(docs, clusters, *more)

    monkeypatch.setattr(nj, "_class_texts", seen)
    assert got(spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], SCHEMA)) == brute(rows)
    assert sorted(sizes) == [2] * 20


def test_pipeline_form_keeps_one_of_each(spark):
    docs = sf_docs(spark).withColumn("component_id", F.lit(0))
    kept = nj.first_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for _, d, _, c in brute(rows_of(docs)) if d == c}
    assert {r.doc_id for r in kept.collect()} == want


def test_components_of_paths_stars_and_repeats(spark):
    rnd = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 90)] + [(7, 7), (3, 2), (2, 3)]
    edges += [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {n: find(n) for n in parent} and len(out) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_hashes_follow_the_words():
    for text, n in (("a b c d e", 2), ("a b c d a b c d", 4), ("a", 1), ("", 0), (None, 0), ("a a a a a a", 1)):
        assert len(nj.shingles(text, 4)) == n
    assert np.array_equal(nj.shingles("A b\tc D", 4), nj.shingles("a b\nC d", 4))
    assert not np.array_equal(nj.shingles("a b c", 4), nj.shingles("a b c d", 4))
