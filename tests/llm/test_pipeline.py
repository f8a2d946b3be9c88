import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagelake.llm import ngram_join, tokens
from tests.llm.helpers import SF, SCHEMA, empty_docs, odd_docs, sf_docs
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_pii import brute as personal
from tests.llm.test_quality_rules import brute as measures


def clean(text):
    words, chars, symbols, dup, repeated = measures(text)
    lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    return not (words < 20 or 100 * repeated > 30 * words or symbols > words or 2 * dup > lines
                or chars > 40 * words or 2 * chars < 3 * words)


def masked(text):
    spans = sorted((s, e, k) for k, s, e in personal(text))
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += [text[done:s], f"[{k.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def test_stages_follow_a_brute_force_version(spark):
    docs = sf_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect() if clean(r.text)]
    first = {d for _, d, _, c in components(rows) if d == c}
    want = {d: masked(t) for d, t in rows if d in first}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "ngram_join", "pii", "best_fit_packing"]
    out = docs
    for name in list(stages)[:-1]:
        out = stages[name](spark, out, SF)
        assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert {d: r.text for d, r in texts.items()} == want
    assert all(r.n_chars == len(r.text) for r in texts.values())
    tok = tokens.loaded(tokens.default_path("word_bpe_49k.json"))
    lengths, bins = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        lengths[r.doc_id] += r.length
        bins[r.sequence_id] += r.length
    assert lengths == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert max(bins.values()) <= 2048 and len(bins) <= np.ceil(sum(bins.values()) / 2048 * 1.05) + 1


def test_odd_and_empty_tables_pass_all_stages(spark):
    for docs in (odd_docs(spark).withColumns({"group": F.lit("x"), "_m": F.lit(1), "_masked": F.lit(2), "later_id": F.lit(3), "a.b": F.lit(4)}), empty_docs(spark),
                 spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)), None, None, None)] * 3, SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, stage(spark, docs, SF)
            assert docs.columns == before or name == "best_fit_packing"
        docs.collect()


def numbered(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, len(t)) for d, t in rows], SCHEMA)


def test_near_copies_take_five_words_and_four_fifths(spark):
    rows = []
    for f in range(12):
        words = [f"f{f}w{i}" for i in range(100)]
        rows.append((10 * f, " ".join(words)))
        rows.append((10 * f + 1, " ".join(words + [f"f{f}x{i}" for i in range(14 + f)])))
        edited = list(words)
        for k in range(1 + f % 3):
            edited[20 + 30 * k] = f"f{f}y{k}"
        rows.append((10 * f + 2, " ".join(edited)))
    stage = dict(corpus_pipeline.STAGES)["ngram_join"]
    want = {d for _, d, _, c in components(rows, 5, 80) if d == c}
    assert want != {d for _, d, _, c in components(rows) if d == c} and 71 not in want
    assert {r.doc_id for r in stage(spark, numbered(spark, rows), SF).collect()} == want


def test_near_copies_keep_one_row_of_each_document_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, d), (None, d), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, SF)
    assert kept.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(
        [(1, a), (5, b), (7, c), (None, d), (9, None), (9, None)], key=key)


def test_near_copies_verify_no_texts_that_share_phrases_only(spark, monkeypatch):
    rnd = random.Random(4)
    phrases = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(60)}" for _ in range(10)) for _ in range(200)]
    rows = [(i, " ".join(rnd.choices(phrases, k=12))) for i in range(300)]
    rows.append((300, rows[7][1] + " again"))
    sizes, texts = [], ngram_join._class_texts

    def seen(docs, clusters, *more):
        sizes.extend(r["count"] for r in clusters.groupBy("cluster").count().collect())
        return texts(docs, clusters, *more)

    monkeypatch.setattr(ngram_join, "_class_texts", seen)
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, numbered(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    assert sizes == [2]
