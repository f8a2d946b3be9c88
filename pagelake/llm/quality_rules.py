"""Operator 1, quality rules: a rule bitmask ledger.

Every rule is evaluated once per document; the ledger stores one bit per
failed rule next to the measurements. Policies are versioned bit masks over
the ledger, so a change of policy, and the ablation of each of its rules, are
bitwise aggregations that never read the texts again.

The main path is DataFrame functions only and has no shuffle: repeated
windows are found inside the row by sorting window hashes. Two different
windows of one text are taken for equal only if their 64-bit hashes collide.

Defined results: a null or empty text has no words and fails
``too_few_words``; repeated rows and null ids are judged row by row; an empty
table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import GAP_PATTERN, free_name, let

#: Words in a window whose second appearance counts as repetition.
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules in bit order: a rule's bit is its place here, so add new ones at the
#: end. Each is an SQL condition over MEASURES that holds when the text fails.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_heavy": "n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version name and the rules that reject a document under it."""

    version: str
    rejects: tuple[str, ...] = field(default_factory=tuple)

    def mask(self, rules: dict[str, str] = RULES) -> int:
        names = list(rules)
        return sum(1 << names.index(r) for r in set(self.rejects))


BASE = Policy("base", ("too_few_words", "repeated_windows"))
V1 = Policy("v1", BASE.rejects + ("symbol_heavy", "duplicate_lines", "long_words", "short_words"))


def _window_hashes(words: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def count(s: Column) -> Column:
        n = F.size(s)
        same = lambda e, j: F.get(s, j)["h"] == e["h"]
        hits = F.filter(s, lambda e, i: F.coalesce(same(e, i - 1), F.lit(False))
                        | ((i + 1 < n) & F.coalesce(same(e, i + 1), F.lit(False))))
        places = F.sort_array(F.transform(hits, lambda e: e["p"]))
        start = F.struct(F.lit(0).cast("int").alias("sum"), F.lit(-WINDOW).cast("int").alias("last"))
        return F.aggregate(
            places, start,
            lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")),
            lambda a: a["sum"])

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(by_hash, count)


def _repeat_words(words: Column) -> Column:
    return let(_window_hashes(words), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def measure(text: Column) -> Column:
    """Struct of MEASURES (longs) of one text."""
    whole = F.coalesce(text, F.lit(""))
    symbols = F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", ""))

    def of_words(words: Column) -> list[Column]:
        return [F.size(words).alias("n_words"),
                F.char_length(F.array_join(words, "")).alias("word_chars"),
                _repeat_words(words).alias("n_repeat_words")]

    def of_lines(lines: Column) -> list[Column]:
        return [F.size(lines).alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")]

    words = F.array_remove(F.split(whole, GAP_PATTERN), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = let(words, lambda x: F.struct(*of_words(x)))
    n = let(lines, lambda x: F.struct(*of_lines(x)))
    return let(w, lambda a: let(n, lambda b: F.struct(
        *[src[m].cast("bigint").alias(m) for m, src in
          (("n_words", a), ("word_chars", a))],
        symbols.cast("bigint").alias("n_symbols"),
        *[src[m].cast("bigint").alias(m) for m, src in
          (("n_lines", b), ("n_dup_lines", b), ("n_repeat_words", a))])))


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``doc_id``, MEASURES and ``failed`` (bit i: rule i failed)."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")
    measured = docs.select("doc_id", measure(F.col("text")).alias("m")).select("doc_id", "m.*")
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            for i, cond in enumerate(rules.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def apply_policy(led: DataFrame, policy: Policy, rules: dict[str, str] = RULES) -> DataFrame:
    """The ledger with ``kept`` and ``policy``."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("bigint"))
    return led.withColumns({"kept": hit == 0, "policy": F.lit(policy.version)})


def ablation(led: DataFrame, policy: Policy, rules: dict[str, str] = RULES) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that fail it
    alone, and that the policy would keep without it. One pre-aggregation by
    bit pattern (at most 2^rules rows); then bit tests on the patterns."""
    mask = policy.mask(rules)
    pattern = F.col("failed").bitwiseAND(F.lit(mask).cast("bigint"))
    counts = led.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    names = list(rules)
    used = [(r, 1 << names.index(r)) for r in names if r in policy.rejects]
    aggs = []
    for r, bit in used:
        fails = F.col("pattern").bitwiseAND(F.lit(bit).cast("bigint")) != 0
        rest = F.col("pattern").bitwiseAND(F.lit(mask & ~bit).cast("bigint")) == 0
        aggs.append(F.struct(
            F.lit(r).alias("rule"),
            F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(fails & rest, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(rest, F.col("n"))), F.lit(0)).alias("n_kept_without")))
    return counts.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns under policy v1."""
    judged = apply_policy(ledger(docs), V1)
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask()).cast("bigint")) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "n_lines", "failed")


def filter_stage(docs: DataFrame) -> DataFrame:
    """Documents that policy v1 keeps, with all their columns."""
    m = free_name(docs, "_m")
    bad = " OR ".join(f"({RULES[r]})" for r in V1.rejects)
    for name in MEASURES:
        bad = bad.replace(name, f"{m}.{name}")
    return docs.withColumn(m, measure(F.col("text"))).where(~F.expr(bad)).drop(m)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
             + 4 * (n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
             + 16 * (word_chars > 40 * n_words)::BIGINT + 32 * (2 * word_chars < 3 * n_words)::BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed::BIGINT AS failed
FROM f
"""
