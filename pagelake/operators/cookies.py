"""Cookie jars (A12, E13) and cookie scope matching.

Scope matching is a theta join in the reference (domain equal, or a parent
domain suffix). Here each request host is exploded into its suffixes
(bounded by the number of labels) and equi-joined to the jar on
``domain`` — no nested loop; the path, secure and expiry rules are
residual predicates. Spark broadcasts the jar only when its size estimate
is under the broadcast threshold, else shuffles both sides on ``domain``
(AQE splits a hot domain).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

_IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
_LABEL = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"


def _is_ip(h: Column) -> Column:
    return h.rlike(_IPV4) | h.contains(":")


def parse_cookie_lines(lines: DataFrame, now: Column, line_col: str = "line",
                       ord_col: str = "line_no") -> DataFrame:
    """Netscape cookie lines → ``jar_ord, domain, host_only, path,
    secure, http_only, expires, name, value, status`` with ``status`` in
    ok / skip / expired (malformed lines are skipped, never errors)."""
    raw = F.regexp_replace(F.col(line_col), "\r$", "")
    http_only = raw.startswith("#HttpOnly_")
    body = F.when(http_only, F.substring(raw, 11, 1 << 30)).otherwise(raw)
    f = F.split(body, "\t", 7)
    dom_field = F.get(f, 0)
    dom = F.lower(F.regexp_replace(dom_field, r"^\.", ""))
    dom_ok = (
        (dom_field != "") & (go_trim_eq(dom_field)) & (dom != "") & ~dom.startswith(".") & ~dom.endswith(".")
        & (_is_ip(dom) | ((F.length(dom) <= 253) & F.forall(F.split(dom, r"\."), lambda l: l.rlike(_LABEL))))
    )
    sub = F.upper(F.get(f, 1))
    sec = F.upper(F.get(f, 3))
    path = F.get(f, 2)
    exp = F.get(f, 4)
    exp_ok = exp.rlike(r"^[+]?[0-9]{1,18}$")
    exp_n = F.when(exp_ok, exp.cast("long"))
    name = F.get(f, 5)
    well_formed = (
        (F.trim(raw) != "") & (http_only | ~raw.startswith("#")) & (F.size(f) == 7) & dom_ok
        & sub.isin("TRUE", "FALSE") & path.startswith("/") & ~path.rlike("[\u0000\r\n]")
        & sec.isin("TRUE", "FALSE") & exp_ok & (name != "")
    )
    expired = well_formed & (exp_n > 0) & (exp_n <= F.unix_seconds(now.cast("timestamp")))
    status = F.when(~F.coalesce(well_formed, F.lit(False)), "skip").when(expired, "expired").otherwise("ok")
    return lines.select(
        F.col(ord_col).alias("jar_ord"), dom.alias("domain"), (sub == "FALSE").alias("host_only"),
        path.alias("path"), (sec == "TRUE").alias("secure"), http_only.alias("http_only"),
        F.when(exp_n > 0, F.timestamp_seconds(exp_n)).alias("expires"),
        name.alias("name"), F.get(f, 6).alias("value"), status.alias("status"))


def read_cookies(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """The cookies of a jar file or folder, ``jar_ord`` rising with the
    lines; other columns as of ``parse_cookie_lines``."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("line_no"))
    return parse_cookie_lines(lines, now)


def go_trim_eq(c: Column) -> Column:
    from ..functions.text import go_trim
    return go_trim(c) == c


def jar_counts(parsed: DataFrame) -> DataFrame:
    """Live and expired cookie counts."""
    return parsed.agg(F.count_if(F.col("status") == "ok").alias("live"),
                      F.count_if(F.col("status") == "expired").alias("expired"))


def match_cookies(urls: DataFrame, jar: DataFrame, now: Column, url_col: str = "url",
                  order_cols: Sequence[str] = ("jar_ord",)) -> DataFrame:
    """D5 + G6: per request URL, the matching cookies in serialization order
    (longest path first, ties in jar order) as ``cookies ARRAY<STRUCT>``
    and a ``cookie_header``. URLs with no cookie keep a row (empty)."""
    p = U.url_parts(F.col(url_col))
    req = urls.select(
        F.col(url_col).alias("url"),
        F.lower(F.regexp_replace(p["host"], r"\.$", "")).alias("host"),
        F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]).alias("req_path"),
        (p["scheme"] == "https").alias("secure_req"),
    )
    req = req.distinct()
    labels = F.split("host", r"\.")
    # the host itself and every parent suffix: a.b.c → a.b.c, b.c, c
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    live = jar.filter(F.col("expires").isNull() | (F.col("expires") > now))
    # every host has its top-level label among its suffixes: a key most of the
    # data shares, which hardly any cookie uses. Distinct hosts meet the jar's
    # domains first, and requests only join the domains that cookies have.
    domains = (req.select("host").distinct().select("host", F.explode(suffixes).alias("domain"))
               .join(live.select("domain").distinct(), "domain", "left_semi"))
    j = req.join(domains, "host").join(live, "domain")
    domain_ok = (F.col("host") == F.col("domain")) | (~F.col("host_only") & ~_is_ip(F.col("host")))
    path_ok = (F.col("req_path") == F.col("path")) | (
        F.col("req_path").startswith(F.col("path"))
        & (F.col("path").endswith("/")
           | (F.substring(F.col("req_path"), F.length(F.col("path")) + 1, 1) == "/")))
    sec_ok = ~F.col("secure") | F.col("secure_req")
    m = j.filter(domain_ok & path_ok & sec_ok)
    key = F.struct((-F.length("path")).alias("k0"), *[F.col(c).alias(f"k{i + 1}") for i, c in enumerate(order_cols)],
                   F.col("name").alias("name"), F.col("value").alias("value"))
    per_url = m.groupBy("url").agg(F.array_sort(F.collect_list(key)).alias("_c"))
    out = req.select("url").distinct().join(per_url, "url", "left")
    cookies = F.coalesce(F.transform("_c", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))),
                         F.array().cast("array<struct<name:string,value:string>>"))
    return out.select("url", cookies.alias("cookies")).select(
        "url", "cookies", F.size("cookies").alias("n_cookies"),
        F.array_join(F.transform("cookies", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ")
        .alias("cookie_header"))


def cookies_for_hosts(pages: DataFrame) -> DataFrame:
    """Fixture jar from the page hosts: a host-only session cookie per host
    and a secure cookie on each host's parent domain scoped to ``/en``."""
    h = pages.select(F.lower(U.hostname("url")).alias("h")).filter(F.col("h").isNotNull()).distinct()
    parent = F.when(F.size(F.split("h", r"\.")) >= 3, F.regexp_replace("h", r"^[^.]+\.", "")).otherwise(F.col("h"))
    a = h.select(F.col("h").alias("domain"), F.lit(True).alias("host_only"), F.lit("/").alias("path"),
                 F.lit(False).alias("secure"), F.lit(None).cast("timestamp").alias("expires"),
                 F.lit("sid").alias("name"), F.col("h").alias("value"))
    b = h.select(parent.alias("domain"), F.lit(False).alias("host_only"), F.lit("/en").alias("path"),
                 F.lit(True).alias("secure"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("expires"),
                 F.lit("pref").alias("name"), parent.alias("value"))
    return a.unionByName(b).distinct()
