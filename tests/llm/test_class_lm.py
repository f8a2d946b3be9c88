import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm import class_lm as lm
from tests.llm.helpers import empty_docs, odd_docs, sf_docs


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_base_columns_equal_brute_force(spark):
    for docs in (sf_docs(spark), odd_docs(spark), odd_docs(spark).where("doc_id = 4").withColumn("c", F.lit(0)), empty_docs(spark)):
        rows = docs.collect()
        train = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1
        c = Counter()
        for r in rows:
            if train(r.doc_id):
                c.update([*words(r.text), None])
        n, v = sum(c.values()), len(c)
        got = {r.doc_id: r for r in lm.op8(docs).collect()}
        assert len(got) == len(rows)
        for r in rows:
            toks = [*words(r.text), None]
            g = got[r.doc_id]
            assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (not train(r.doc_id), len(toks), sum(c[t] > 0 for t in toks), n)
            want = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks)
            assert math.isclose(g.base_score, want, rel_tol=1e-9)
            assert math.isfinite(g.score) and g.score <= 0


def test_moves_score_what_a_move_brings():
    rng = np.random.default_rng(1)
    n, k = 12, 4
    big = rng.integers(0, 30, (n + 1, n + 1))
    classes = np.append(rng.integers(0, k, n), k)

    def table(cl):
        t = np.zeros((k + 1, k + 1), np.int64)
        np.add.at(t, (cl[:, None].repeat(n + 1, 1), cl[None].repeat(n + 1, 0)), big)
        return t

    items = np.arange(n)
    after = np.array([[big[i, classes == c].sum() for c in range(k + 1)] for i in items])
    before = np.array([[big[classes == c, i].sum() for c in range(k + 1)] for i in items])
    own = np.array([big[i, i] for i in items])
    best, gain = lm._best_moves(items, after, before, own, classes, table(classes))
    for i in items:
        tried = []
        for c in range(k):
            moved = classes.copy()
            moved[i] = c
            tried.append(lm.objective(table(moved)))
        assert math.isclose(max(tried) - lm.objective(table(classes)), gain[i], abs_tol=1e-6)
        assert math.isclose(tried[best[i]], max(tried), abs_tol=1e-6)


def test_probabilities_sum_to_one_and_beat_the_base(spark):
    docs = sf_docs(spark)
    vocab = lm.vocabulary(docs)
    model = lm.train(docs, vocab)
    assert np.allclose((10.0 ** model.log_next).sum(1), 1)
    # the words of a class and its one unseen word share its probability
    seen = {}
    items = lm.Items(model.words)
    for r in vocab.where("first AND c > 0").collect():
        k = model.classes[items[bytes(r.word)]]
        total = model.class_count[k] + 0.5 * (model.class_words[k] + 1)
        seen[k] = seen.get(k, 0.5 / total) + (r.c + 0.5) / total
    assert np.allclose(list(seen.values()), 1)
    held = lm.score(docs, model, vocab).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    again = lm.score(docs, lm.train(docs, vocab), vocab)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, lm.op8(docs).collect()))


def test_exchange_raises_the_objective(spark):
    docs = sf_docs(spark)
    vocab = lm.vocabulary(docs)
    none, some = (lm.train(docs, vocab, lm.Settings(rounds=r)) for r in (0, 6))
    bigrams = lm.item_bigrams(docs, some.words)
    value = [lm.objective(lm.class_table(bigrams, m.classes, 49)) for m in (none, some)]
    assert value[1] > value[0]


def test_single_words_are_counted_and_moved_by_their_own_neighbours(spark):
    docs = sf_docs(spark)
    vocab = lm.vocabulary(docs)
    model = lm.train(docs, vocab)
    items, k = lm.Items(model.words), len(model.log_next)
    table = lm.class_table(lm.item_bigrams(docs, model.words), model.classes, k)
    like = np.log((table + 5) / (np.outer(table.sum(1), table.sum(0)) / table.sum() + 5))
    score = {}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            ws = [None, *words(r.text), None]
            kinds = [k - 1 if w is None else model.classes[items[w.encode()]] for w in ws]
            for a, b, ka, kb in zip(ws, ws[1:], kinds, kinds[1:]):
                if a is not None:
                    score[a] = score.get(a, 0) + (like[:, kb] if a != b else np.diag(like))
                if b not in (None, a):
                    score[b] = score.get(b, 0) + like[ka]
    got = lm.block_words(docs, lm.split).join(model.singles.placed, "at").select("word", "class").distinct().collect()
    for r in got:
        w, was = bytes(r.word).decode(), model.classes[items[bytes(r.word)]]
        if w not in score or items[bytes(r.word)] < len(model.words):
            assert r["class"] == was
        else:
            assert score[w][r["class"]] >= score[w][:-1].max() - 1e-6
    assert len(got) == vocab.select("word").distinct().count()


def test_rare_words_of_one_shape_get_classes_of_their_own(spark):
    # nouns and verbs of one shape, each far below the share of an item, where a common noun or verb may stand
    rng = np.random.default_rng(3)
    pick = lambda x, common: f"{x}{rng.integers(100, 400)}x" if rng.random() < 0.5 else common
    texts = (" ".join(f"the {pick('n', 'cat')} now he {pick('v', 'runs')} it" for _ in range(10)) for _ in range(800))
    docs = lm.stable(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    vocab = lm.vocabulary(docs)
    few = lm.Settings(classes=7, min_share=0.02)
    model = lm.train(docs, vocab, few)
    assert len(model.words) < 10
    by_word = lm.block_words(docs, lm.split).join(model.singles.placed, "at").where("c > 1").select("word", "class").distinct().collect()
    of = {bytes(r.word): r["class"] for r in by_word}
    assert len(of) == len(by_word) > 500
    nouns, verbs = (Counter(k for w, k in of.items() if len(w) == 5 and w[:1] == x).most_common(1)[0] for x in (b"n", b"v"))
    assert nouns[0] != verbs[0] and nouns[1] > 250 and verbs[1] > 250
    old = lm.class_table(lm.item_bigrams(docs, model.words), model.classes, 8)
    assert lm.objective(model.singles.table) > lm.objective(old)


def test_single_classes_make_probabilities(spark):
    docs = sf_docs(spark)
    vocab = lm.vocabulary(docs)
    model = lm.train(docs, vocab)
    last = model.singles
    assert np.allclose((10.0 ** last.log_next).sum(1), 1)
    whole = last.class_count + 0.5 * (last.class_words + 1)
    known = lm.block_words(docs, lm.split).join(last.placed, "at").where("first AND c > 0").collect()
    seen = Counter()
    for r in known:
        seen[r["class"]] += (r.c + 0.5) / whole[r["class"]]
    assert all(math.isclose(p + 0.5 / whole[k], 1) for k, p in seen.items())
    # a document by hand
    of = {bytes(r.word): (r.c, r["class"]) for r in lm.block_words(docs, lm.split).join(last.placed, "at").collect()}
    got = {r.doc_id: r for r in lm.score(docs, model, vocab).collect()}
    for r in docs.limit(20).collect():
        path = [of[w.encode()] for w in words(r.text)]
        k = [48, *(x[1] for x in path), 48]
        want = sum(math.log10((c + 0.5) / whole[j]) for c, j in path) + sum(last.log_next[a, b] for a, b in zip(k, k[1:]))
        assert math.isclose(got[r.doc_id].score, want, rel_tol=1e-9)
