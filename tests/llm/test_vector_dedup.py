import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import vector_dedup as v
from tests.llm.helpers import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    ok = [i for i, (_, e) in enumerate(rows) if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n = len(rows)
    links = np.zeros((n, n), bool)
    for dim in {len(rows[i][1]) for i in ok}:
        same = [i for i in ok if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in same], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        links[np.ix_(same, same)] = x @ x.T >= threshold
    np.fill_diagonal(links, False)
    label = np.arange(n)
    while True:
        new = np.array([min(label[i], label[links[i]].min(initial=n)) for i in range(n)])
        if (new == label).all():
            break
        label = new
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[label[i]] = min(d, first.get(label[i], d))
    return sorted((d is None, d, int(links[i].sum()), first.get(label[i])) for i, (d, _) in enumerate(rows))


def got(df, settings=None):
    return sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id) for r in v.near_duplicates(df, settings).collect())


def frame(spark, rows):
    return spark.createDataFrame([(d, e, 0) for d, e in rows], SCHEMA)


def near(rng, x, cosine):
    e = rng.normal(size=x.shape)
    e -= (e @ x) / (x @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * e * np.linalg.norm(x) / np.linalg.norm(e)


def cases(seed, dim=64):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(150)]
    for k in range(60):
        rows.append(near(rng, rows[k % 20], rng.uniform(0.945, 0.955)))
    rows += [3 * rows[5]] + [rows[7]] * 30 + [near(rng, rows[9], 0.99) for _ in range(90)]
    path = rows[11]
    for _ in range(25):
        path = near(rng, path, 0.96)
        rows.append(path)
    order = rng.permutation(len(rows))
    return [(int(i), [float(c) for c in np.float32(rows[o])]) for i, o in enumerate(order)]


@pytest.mark.parametrize("dim", [64, 20])
def test_equals_brute_force(spark, dim):
    rows = cases(dim, dim)
    assert got(frame(spark, rows)) == brute(rows)


def test_large_buckets_are_compared_in_blocks(spark):
    rows = cases(3)
    s = v.Settings(block=16)
    assert got(frame(spark, rows), s) == brute(rows)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(df.withColumn("class", F.lit(1)).withColumn("n_links", F.lit(1))) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (9, [-1.0, 0.0]), (10, [1.0]), (11, [5.0]), (12, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None),
            (13, [1e-30, 0.0]), (14, [3e38, 1e38]), (15, [1.5e38, 5e37]), (16, [-0.0, 1.0]), (17, [0.0, 1.0])]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, [])) == []


def test_recall_at_the_threshold_at_every_size():
    rng = np.random.default_rng(0)
    for size, dim in ((1000, 64), (10**6, 64), (10**9, 128), (10**6, 384)):
        x = rng.normal(size=(600, dim))
        y = np.array([near(rng, r, 0.95) for r in x])
        x, y = (a / np.linalg.norm(a, axis=1)[:, None] for a in (x, y))
        s = v.Settings.for_size(size, dim)
        a, b = v.bucket_keys(x, s), v.bucket_keys(y, s)
        assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= 0.99
