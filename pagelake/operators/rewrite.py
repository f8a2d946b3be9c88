"""Rewrite rules as a table, first match per URL, for rule sets of any size.

``functions.urls.rewrite_url`` compiles a short list into one ``CASE``. Here
the rules stay a table (``rule_ord, match, replace``) and nothing of it
reaches the driver. A rule's pattern requires some plain text; the rule is
keyed by one gram of it, the one that the fewest URLs hold. URLs meet the
rules by an equi join on their grams, and the pattern is tried on what shares
a gram and contains the whole text. Rules that require no text of three
characters must be tried on every URL: they are tried in blocks of
``OPEN_BLOCK``, however many there are.

Joins with grams name their strategy: the engine takes what ``explode`` gives for
no larger than what it is given, and would broadcast every gram of every URL.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.literals import ascii_grams, required_literal
from ..session import ensure_checkpoint_dir

#: Rules without a required text that one row of the join carries.
OPEN_BLOCK = 256
#: Gram lengths: rules of at least the first many required characters use it.
LONG, SHORT = 8, 3

_COMPILED = "rule_ord long, java string, rep string, literal string"


def _compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rules in batches:
        rows = []
        for at, match, replace in zip(rules["rule_ord"], rules["match"], rules["replace"]):
            try:
                pattern = U.Pattern(match)
            except ValueError as e:
                raise ValueError(f"url_rewrites[{at}]: {e}") from e
            rows.append((at, pattern.java, U._go_replacement(replace, pattern), required_literal(match)))
        yield pd.DataFrame(rows, columns=["rule_ord", "java", "rep", "literal"])


def compile_rules(rules: DataFrame) -> DataFrame:
    """``rule_ord, java, rep, literal``: the engine's form of every rule. A
    pattern that does not compile fails the job that reads the rules, whether
    or not a URL would reach it. A rule whose order or pattern is null is no
    rule; a null replacement is empty. Of rules with the same pattern the first
    is kept, as the others never count."""
    known = rules.select(F.col("rule_ord").cast("long").alias("rule_ord"), F.col("match").cast("string").alias("match"),
                         F.coalesce(F.col("replace").cast("string"), F.lit("")).alias("replace")).dropna(subset=["rule_ord", "match"])
    first = known.groupBy("match").agg(F.min(F.struct("rule_ord", "replace")).alias("r"))
    made = first.select("r.rule_ord", "match", "r.replace").mapInPandas(_compiled, _COMPILED)
    # a pattern that matches the empty text requires none; asking compiles each
    return made.withColumn("literal", F.when(F.rlike(F.lit(""), F.col("java")), F.lit("")).otherwise(F.col("literal")))


def _grams(text: Column) -> Column:
    return F.concat(ascii_grams(text, LONG), ascii_grams(text, SHORT))


def _keyed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules with the gram of their text that the fewest URLs hold. A rule
    with a gram that no URL holds matches none, and is left out."""
    own = F.when(F.length("literal") >= LONG, ascii_grams(F.col("literal"), LONG)).otherwise(ascii_grams(F.col("literal"), SHORT))
    pairs = rules.select("*", F.explode(own).alias("gram"))
    wanted = pairs.select("gram").distinct()
    held = urls.select(F.explode(_grams(F.col("_url"))).alias("gram")).join(wanted.hint("shuffle_hash"), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    best = pairs.join(held.hint("shuffle_hash"), "gram", "left").groupBy("rule_ord", "java", "rep", "literal").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return best.where("best.n > 0").select("rule_ord", "java", "rep", "literal", "best.gram")


def rewrite_by_table(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """C4 with rules from a table: all columns of ``urls`` and ``fetch_url``,
    ``rule_ord`` (columns of those names are replaced). Of the rules that
    match, the one of the smallest order counts (ties: by pattern, then
    replacement); all its matches are replaced. URLs without one, or null, are
    left as they are with a null ``rule_ord``. Rows that repeat a URL all stay."""
    if url_col in ("fetch_url", "rule_ord"):
        raise ValueError(f"{url_col} names a column of the result")
    ensure_checkpoint_dir(urls.sparkSession)
    compiled = compile_rules(rules).checkpoint()   # read three times
    open_rules = compiled.where(F.length("literal") < SHORT)
    n_open = open_rules.count()
    distinct = urls.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    keyed = _keyed(compiled.where(F.length("literal") >= SHORT), distinct)
    rule = F.struct("rule_ord", "java", "rep").alias("rule")
    found = (distinct.select("_url", F.explode(_grams(F.col("_url"))).alias("gram")).join(keyed.hint("merge"), "gram")
             .where(F.contains(F.lower("_url"), F.col("literal"))).where(F.rlike("_url", "java"))
             .select("_url", rule))
    if n_open:
        blocks = -(-n_open // OPEN_BLOCK)
        dealt = open_rules.withColumn("_b", F.pmod(F.xxhash64("rule_ord", "java", "rep"), F.lit(blocks)))
        packed = dealt.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "java", "rep"))).alias("_rules"))
        # few blocks are copied to as many shares of the URLs as there are partitions
        shares = max(1, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        tried = distinct.withColumn("_s", F.pmod(F.xxhash64("_url"), F.lit(shares))).withColumn("_b", upto(blocks)).join(
            packed.withColumn("_s", upto(shares)).hint("merge"), ["_b", "_s"])
        first = F.get(F.filter("_rules", lambda r: F.rlike(F.col("_url"), r["java"])), 0)
        found = found.unionByName(tried.select("_url", first.alias("rule")).where(F.col("rule").isNotNull()))
    best = found.groupBy("_url").agg(F.min("rule").alias("_rule"))
    kept = urls.drop("fetch_url", "rule_ord")
    joined = kept.join(best, kept[url_col] == F.col("_url"), "left")
    out = F.when(F.col("_rule").isNull(), F.col(url_col)).otherwise(
        F.regexp_replace(F.col(url_col), F.col("_rule.java"), F.col("_rule.rep")))
    return joined.withColumn("_out", out).withColumn("_ord", F.col("_rule.rule_ord")).drop("_url", "_rule").withColumnsRenamed(
        {"_out": "fetch_url", "_ord": "rule_ord"})
