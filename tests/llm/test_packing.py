import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.llm import packing, tokens
from tests.llm.helpers import empty_docs, odd_docs, sf_docs


def check_bins(lengths, place, offset, limits):
    bins = defaultdict(list)
    for n, b, o in zip(lengths, place, offset):
        bins[b].append((o, n))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limits.tokens and len(parts) <= limits.documents
        assert sum(n * n for _, n in parts) <= (limits.attention or limits.tokens**2)
    return len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120), st.sampled_from(["norm", "dot"]),
       st.sampled_from([packing.Limits(64), packing.Limits(64, 3), packing.Limits(64, 64, 3600), packing.Limits(64, 5, 3700)]))
def test_every_constraint_holds(lengths, rule, limits):
    arr = np.array(lengths, np.int64)
    check_bins(lengths, *packing.best_fit(arr, limits, rule), limits)


def test_few_bins():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 4000)
    used = check_bins(lengths, *packing.best_fit(lengths), packing.Limits())
    assert used <= 1.03 * lengths.sum() / 2048 + 1
    pairs = np.concatenate([np.arange(1, 1024), 2048 - np.arange(1, 1024)])
    assert check_bins(pairs, *packing.best_fit(pairs), packing.Limits()) == 1023


def test_pieces_and_sequences_equal_the_library(spark):
    tok = tokens.loaded(tokens.default_path("word_bpe_49k.json"))
    for docs in (sf_docs(spark), odd_docs(spark)):
        rows = packing.op6(docs).collect()
        by_doc = defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
        got = {}
        for d in docs.collect():
            ids = tok.encode(d.text or "", add_special_tokens=False).ids + [0]
            parts = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
            for r in parts:
                part = ids[r.start:r.start + r.length]
                assert r.start == 2048 * r.piece and r.length == len(part) and (r.length == 2048 or r is parts[-1])
                assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
                got[d.doc_id, r.piece] = part
        assert len(rows) == len(got)
        lens, seq, off = zip(*((r.length, r.sequence_id, r.offset) for r in rows))
        check_bins(lens, seq, off, packing.Limits())
        whole = packing.pack(packing.pieces(docs, with_ids=True))
        for r in packing.sequences(whole).collect():
            assert len(r.ids) == 4 * r.length <= 4 * 2048


def test_empty_and_repeated_rows(spark):
    assert packing.op6(empty_docs(spark)).count() == 0
    docs = odd_docs(spark).union(odd_docs(spark)).withColumn("piece", F.lit(9)).withColumn("offset", F.lit(9))
    assert packing.op6(docs).select("doc_id", "piece").count() == 2 * packing.op6(odd_docs(spark)).count()


def packed_lengths(spark, lengths, **kw):
    cut = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)],
                                "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    rows = packing.pack(cut, **kw).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted(enumerate(map(int, lengths)))
    return check_bins(*zip(*((r.length, r.sequence_id, r.offset) for r in rows)), kw.get("limits", packing.Limits()))


def test_groups_leave_no_underfull_bins_behind(spark):
    small = packing.Limits(64)
    assert packed_lengths(spark, [1] * 6400, limits=small, group_pieces=100) <= 102
    short = np.random.default_rng(1).integers(1, 20, 3000)
    assert packed_lengths(spark, short, limits=small, group_pieces=60) <= 1.04 * short.sum() / 64 + 1
    assert packed_lengths(spark, [33] * 300, limits=small, group_pieces=20) == 300
    assert packed_lengths(spark, [1] * 300, limits=packing.Limits(64, 3), group_pieces=40) <= 102


def test_groups_hold_many_sequences_by_default(spark):
    assert packed_lengths(spark, [1] * 20_000) == 10
