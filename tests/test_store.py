"""Order of the store's writes: versions, deltas and compactions in one log."""

import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest

from pagelake.operators import commits as C
from pagelake.operators import store as ST
from pagelake.streaming import incremental as K

SCHEMA = "cache_key string, cached_at timestamp, source string, title string, raw_html string"


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="pl-store-") + "/s"


@pytest.fixture
def rows(spark):
    def make(*pairs, at="2024-01-01 00:00:00"):
        import datetime
        when = datetime.datetime.fromisoformat(at)
        return spark.createDataFrame([(k, when, "http", t, None) for k, t in pairs], SCHEMA)
    return make


def titles(spark, root, **kw):
    return {r.cache_key: r.title for r in ST.read_store(spark, root, **kw).collect()}


def test_a_version_made_of_a_delta_is_newer_than_it(spark, root, rows):
    ST.write_version(ST.upsert(None, rows(("a", "v1"), ("b", "v1"))), root, 1)
    ST.write_delta(rows(("a", "d0"), ("c", "d0")), root)
    ST.write_version(ST.upsert(ST.read_store(spark, root), rows(("a", "v2"))), root, 2)
    assert titles(spark, root) == {"a": "v2", "b": "v1", "c": "d0"}
    assert titles(spark, root, version=1) == {"a": "v1", "b": "v1"}
    with pytest.raises(ValueError):
        ST.read_store(spark, root, version=9)


def test_a_delta_committed_while_a_version_is_made_is_kept(spark, root, rows):
    ST.upsert_store(rows(("a", "v1"), ("b", "v1")), root)
    seen = C.last(spark, root)
    old = ST.read_store(spark, root, as_of=seen, keep_order=True)
    ST.write_delta(rows(("a", "d"), ("c", "d")), root)
    ST.write_version(ST.upsert(old, rows(("a", "v2")), keep_order=True), root, as_of=seen)
    assert titles(spark, root) == {"a": "v2", "b": "v1", "c": "d"}


def test_order_survives_compaction(spark, root, rows):
    ST.upsert_store(rows(("a", "v1"), ("b", "v1")), root)
    ST.write_delta(rows(("a", "d1")), root)
    ST.write_delta(rows(("b", "old"), at="2023-01-01 00:00:00"), root)
    ST.compact(spark, root)
    assert ST.compact(spark, root) is None
    assert titles(spark, root) == {"a": "d1", "b": "v1"}
    order = {r.cache_key: r.write_ord for r in ST.read_store(spark, root, keep_order=True).collect()}
    assert order == {"a": 2, "b": 1}
    ST.write_delta(rows(("a", "d2")), root)
    assert titles(spark, root) == {"a": "d2", "b": "v1"}
    gone = ST.expire(spark, root)
    assert len(gone) == 3 and titles(spark, root) == {"a": "d2", "b": "v1"}
    assert C.live(C.entries(spark, root))[0]["version"] == 2


def test_tokens_commit_once_and_uncommitted_folders_do_not_count(spark, root, rows):
    assert ST.write_delta(rows(("a", "x")), root, "s-0", "s#0")
    assert not ST.write_delta(rows(("a", "again")), root, "s-0", "s#0")
    rows(("z", "nobody committed this")).write.parquet(f"{root}/batch=lost")
    assert titles(spark, root) == {"a": "x"}
    assert titles(spark, tempfile.mkdtemp()) == {}


def test_two_writers_take_two_numbers(spark, root):
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda i: C.commit(spark, root, {"kind": "delta", "path": f"batch={i}"}), range(12)))
    assert sorted(got) == list(range(1, 13)) and [e["n"] for e in C.entries(spark, root)] == list(range(1, 13))


def test_two_streams_into_one_store(spark, root, rows):
    for name in ("p", "q"):
        src = tempfile.mkdtemp()
        rows((name, "first"), ("both", name)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        K.store_upsert_stream(stream, root, f"{root}-{name}").awaitTermination()
    assert titles(spark, root) == {"p": "first", "q": "first", "both": "q"}
