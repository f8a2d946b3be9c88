import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.llm import token_files as tf
from pagelake.llm import tokens
from tests.llm.helpers import empty_docs, odd_docs, sf_docs


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32), st.sampled_from([1, 2, 30, 5000, 65536]), st.sampled_from([1, 7, 64, 4096]))
def test_round_trip(n, seed, top, block):
    rng = np.random.default_rng(seed)
    if block == 1:
        n %= 300
    ids = np.minimum(rng.geometric(min(1, 8 / top), n) - 1, top - 1).astype(tokens.ID)
    data = tf.compress(ids, block)
    assert np.array_equal(tf.decompress(data), ids)


def test_every_id_and_long_runs():
    ids = np.concatenate([np.arange(65536), np.zeros(20000), np.tile([1, 2, 3], 9000), np.full(3, 65535)]).astype(tokens.ID)
    data = tf.compress(ids)
    assert np.array_equal(tf.decompress(data), ids)


def test_blocks_stand_alone_and_damage_is_found():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 900, 5000).astype(tokens.ID)
    data = tf.compress(ids, 512)
    for some in ([3], [0, 9], [2, 5, 6]):
        want = np.concatenate([ids[k * 512:(k + 1) * 512] for k in some])
        assert np.array_equal(tf.decompress(data, np.array(some)), want)
    for at in (5, 40, len(data) - 300):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(Exception):
            tf.decompress(bytes(bad))
    with pytest.raises(ValueError):
        tf.decompress(data[:-2])


def test_it_compresses_text(spark):
    enc = tokens.encoder(tokens.default_path("byte_bpe_50k.json"), "byte")
    ids = np.frombuffer(b"".join(enc.encode([r.text for r in sf_docs(spark).collect()])), tokens.ID)
    ratio = len(tf.compress(ids)) / (2 * len(ids))
    assert ratio < 0.75
    assert len(tf.compress(np.tile(ids[:500], 8))) < 0.45 * 2 * 4000


def test_files_equal_the_library(spark):
    tok = tokens.loaded(tokens.default_path("byte_bpe_50k.json"))
    twice = odd_docs(spark).union(odd_docs(spark)).withColumn("start", F.lit(1)).repartition(5)
    for docs in (sf_docs(spark), odd_docs(spark), twice, empty_docs(spark)):
        rows = sorted((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect())
        want, start = {}, 0
        got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in tf.op9(docs).collect()}
        by_id = {}
        for _, d, t in rows:
            ids = tok.encode(t, add_special_tokens=False).ids + [2]
            by_id.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at = {d: [] for d in by_id}
        for (d, s), v in sorted(got.items(), key=lambda x: x[0][1]):
            assert s == start
            start += v[0]
            at[d].append(v)
        assert {d: sorted(v) for d, v in at.items()} == {d: sorted(v) for d, v in by_id.items()}
        order = [d for d, _ in sorted(got, key=lambda x: x[1])]
        assert order == sorted(order, key=lambda d: (d is not None, d or 0))
        assert not want


def test_blocks_are_settled_once_an_id(monkeypatch):
    calls = []
    real = tf._settled
    monkeypatch.setattr(tf, "_settled", lambda low, size: calls.append(0) or real(low, size))
    rng = np.random.default_rng(4)
    ids = np.where(rng.random(6000) < 0.5, 7, rng.integers(0, 65536, 6000)).astype(tokens.ID)
    data = tf.compress(ids, 512)
    assert len(calls) == 512
    assert np.array_equal(tf.decompress(data), ids) and len(calls) == 1024
    size = np.array([1, 3, 1 << 29, 1 << 40], np.int64)  # the smallest interval is large enough after one word
    out = real(np.array([5, (1 << 30) - 1, 12345, 0]), size)
    size[out] <<= tf._WORD
    assert (size >= tf._LEAST).all()


def test_carries_run_over_full_words():
    out = tf._Writer(2)
    full = (1 << tf._WORD) - 1
    out.lanes, out.words = [np.array([0, 1], np.int32)] * 3, [np.array([5, 7]), np.array([full, 1]), np.array([full, 2])]
    out.low[:] = 1 << tf._STATE, 0
    words, sizes = out.finish()
    assert sizes.tolist() == [5, 5]
    assert words.tolist() == [6, 0, 0, 0, 0, 7, 1, 2, 0, 0]


def test_rows_of_a_chunk():
    rows = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * tf.CHUNK_BYTES * 2, "", "c"])})
    assert [x.num_rows for x in tf._chunks(rows)] == [2, 1, 2]
    assert not list(tf._chunks(rows.slice(0, 0)))
