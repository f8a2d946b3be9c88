import zlib

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm import sharding
from tests.llm.helpers import empty_docs, odd_docs, sf_docs


def test_curve_visits_neighbours_once_each():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.indices([1 << bits] * dims).reshape(dims, -1)
        index = sharding.hilbert_index(list(grid), bits)
        assert sorted(index) == list(range(1 << bits * dims))
        path = grid[:, np.argsort(index)]
        assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()


def check(rows, docs, n_shards=8):
    assert len(rows) == len(docs)
    counts = np.bincount([r.shard for r in rows], minlength=n_shards) if rows else np.zeros(n_shards)
    assert counts.max() - counts.min() <= 1
    for s in range(n_shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(int(counts[s])))
    want = sorted((d.doc_id is None, d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in rows) == want
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_law_slots_and_order(spark):
    for docs in (sf_docs(spark), odd_docs(spark), odd_docs(spark).union(odd_docs(spark)).withColumn("curve", F.lit(1)), empty_docs(spark)):
        check(sharding.op10(docs).collect(), docs.collect())


def test_runs_prune_in_every_dimension(spark):
    docs = sf_docs(spark)
    placed = sharding.hilbert_shards(docs)
    ranges = sharding.shard_ranges(placed).collect()
    sizes = sorted(r["size"] for r in placed.collect())
    spread = np.mean([r.max_size - r.min_size for r in ranges]) / (sizes[-1] - sizes[0])
    langs = np.mean([(r.min_lang != r.max_lang) for r in ranges])
    assert spread < 0.9 or langs < 0.9
    assert sum(r.n_rows for r in ranges) == len(sizes)


def test_written_shards_keep_all_documents(spark, tmp_path):
    docs = sf_docs(spark)
    sharding.write_shards(docs, sharding.hilbert_shards(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
