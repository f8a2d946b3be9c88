import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import blocks, bpe, tokens
from tests.llm.helpers import empty_docs, odd_docs, sf_docs

PATH = tokens.default_path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_equal_the_library(spark):
    tok = tokens.loaded(PATH)
    for docs in (sf_docs(spark), odd_docs(spark), odd_docs(spark).repartition(40), empty_docs(spark)):
        want = []
        for r in docs.collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id is None, r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
        got = [(r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5(docs).collect()]
        assert sorted(got) == sorted(want)


def test_small_blocks_and_hot_words(spark, monkeypatch):
    tok = tokens.loaded(PATH)
    docs = sf_docs(spark).select("doc_id", F.concat_ws(" ", F.lit("the the"), "text", F.lit("the")).alias("text"), F.lit(1).alias("block"))
    small = {"chars": 5000}
    monkeypatch.setattr(bpe, "block_words", lambda d, s: blocks.block_words(d, s, **small))
    monkeypatch.setattr(bpe, "block_texts", lambda d, s: blocks.block_texts(d, s, **small))
    monkeypatch.setattr(bpe, "CHUNK", 300)
    out = bpe.decode(bpe.encode(docs)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(texts)
    for r in out:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, tokens.ID).tolist() == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_changed_documents_are_noticed(spark):
    docs, other = sf_docs(spark), sf_docs(spark).withColumn("text", F.concat("text", F.lit(" more words")))
    words = bpe.word_table(blocks.block_words(docs, bpe.split), PATH)
    use = lambda rows, ids, lengths, places: rows
    with pytest.raises(Exception, match="changed between two reads"):
        blocks.restore(words, blocks.block_texts(other, bpe.split), use, words.schema).collect()


def test_only_scans_of_files_are_read_twice(spark):
    """A text of as many words that comes otherwise the second time can't happen:
    what isn't a scan is written first."""
    docs = sf_docs(spark)
    scan = docs.where("doc_id >= 0").withColumn("text", F.upper("text"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" in blocks.stable(scan).inputFiles()[0] and "upper" in plan(blocks.stable(scan))
    changing = docs.withColumn("text", F.concat_ws(" ", F.lit("alpha"), (F.rand() * 1e9).cast("int").cast("string")))
    for moved in (docs.repartition(3), docs.unionByName(docs), docs.join(docs.select("doc_id"), "doc_id"), docs.orderBy("text"), changing):
        once = blocks.stable(moved)
        assert all("llm-" in f for f in once.inputFiles()) and once.columns == ["doc_id", "text"]


def test_packed_places_come_back():
    rng = np.random.default_rng(0)
    for top in (1, 199, 201, 14_000, 15_000, 1 << 20, 1 << 27):
        places = rng.integers(0, top, 5000).astype(np.uint32)
        assert np.array_equal(blocks._unpacked(blocks._packed(places), blocks._packed_size(places), len(places)), places)
    none = np.empty(0, np.uint32)
    assert len(blocks._unpacked(blocks._packed(none), 0, 0)) == 0
