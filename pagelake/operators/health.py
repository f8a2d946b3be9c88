"""Health-check rollups (E10, E11) over a ``health_checks`` table::

    surface STRING, backend STRING, key_ord INT, n_keys INT, status STRING,
    detail STRING, latency_ms BIGINT, required BOOLEAN

One row per probed key. A pool (surface, backend) reports its worst status;
the details of the worst rows are joined with ``; `` and carry key ordinals
(never key values); an all-ok pool of several keys says "N keys accepted".
One ``groupBy`` per pool — the group is one pool's keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed status priority (higher is worse)
STATUS_PRIORITY = {"misconfigured": 5, "unreachable": 4, "no_key": 3, "ok": 2, "skipped": 1}


def _priority(col: str):
    m = F.create_map(*[x for k, v in STATUS_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(col)], F.lit(0))


def health_rollup(checks: DataFrame) -> DataFrame:
    """``surface, backend, status, detail, required`` per pool."""
    c = checks.withColumn("_p", _priority("status"))
    g = c.groupBy("surface", "backend").agg(
        F.max_by("status", "_p").alias("status"), F.max("_p").alias("_w"), F.count("*").alias("_n"), F.bool_or("required").alias("required"))
    # only rows that the detail names are gathered
    worst = (c.where(F.col("detail") != "").join(g.select("surface", "backend", F.col("_w").alias("_p")), ["surface", "backend", "_p"])
             .groupBy("surface", "backend").agg(F.array_sort(F.collect_list(F.struct("key_ord", "n_keys", "detail"))).alias("_rows")))
    g = g.join(worst, ["surface", "backend"], "left").withColumn("_rows", F.coalesce("_rows", F.array()))
    details = F.array_join(F.transform("_rows", lambda r: F.format_string("key %d of %d: %s", r["key_ord"],
                                                                        r["n_keys"], r["detail"])), "; ")
    detail = (F.when(details != "", details)
              .when((F.col("status") == "ok") & (F.col("_n") > 1), F.format_string("%d keys accepted", F.col("_n")))
              .otherwise(F.lit("")))
    return g.select("surface", "backend", "status", detail.alias("detail"), "required")


def failing_surfaces(rollup: DataFrame) -> DataFrame:
    """Number of required checks whose status is not ok/skipped."""
    return rollup.agg(F.count_if(F.col("required") & ~F.col("status").isin("ok", "skipped")).alias("failing"))
