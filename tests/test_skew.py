"""Hot keys: results must equal a straightforward formulation when one key
holds a large share of all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelake.operators import crawl as CR
from pagelake.operators import store as ST


def test_prefix_sum_equals_plain_window_on_hot_host(spark):
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), (F.col("id") % 50).cast("string")))
        .alias("host"),
        (F.lit(1_700_000_000) + F.col("id") * 7).cast("timestamp").alias("at"),
        F.col("id").alias("seq"),
        ((F.col("id") % 5) != 0).alias("is_shell"))
    arr = rows.withColumn("bucket", F.date_trunc("minute", "at"))
    got = CR.force_render_history(arr).select("seq", "prior_total", "prior_shells", "force_render")
    w = Window.partitionBy("host").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select(
        "seq", F.coalesce(F.count("*").over(w), F.lit(0)).cast("long").alias("prior_total"),
        F.coalesce(F.sum(F.col("is_shell").cast("int")).over(w), F.lit(0)).cast("long").alias("prior_shells"))
    plain = plain.withColumn("force_render", (F.col("prior_total") >= 10)
                             & (F.col("prior_shells") / F.greatest("prior_total", F.lit(1)) > 0.8))
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_latest_per_key_hot_key(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("cache_key"),
        (F.lit(1_700_000_000) + F.col("id")).cast("timestamp").alias("cached_at"),
        F.lit("http").alias("source"), F.col("id").cast("string").alias("markdown"))
    got = {r.cache_key: r.markdown for r in ST.latest_per_key(rows).collect()}
    assert got["hot"] == "4998" and len(got) == 2501


def test_crawl_partition_invariance(spark):
    from pagelake.plans import derived as D
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    seeds, edges, _ = D.site_graph(pages)
    a = {(r.url, r.depth) for r in CR.crawl(seeds, edges, max_depth=0, num_partitions=1).collect()}
    b = {(r.url, r.depth) for r in CR.crawl(seeds, edges, max_depth=0, num_partitions=13).collect()}
    assert a == b and len(a) > 10
