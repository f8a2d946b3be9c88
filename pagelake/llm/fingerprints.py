"""Operator 11, document fingerprints: one-permutation MinHash.

Each shingle of five words is hashed once. The top bits of a hash name its
bin, and a bin keeps its least hash. Empty bins are filled by optimal
densification (Shrivastava, "Optimal Densification for Fast and Accurate
Minwise Hashing", 2017): an empty bin goes through the bins in an order that
hashing draws for it, and copies the first that isn't empty; here that is the
non-empty bin of the least hash of (empty bin, bin), which needs no loop and
always ends. Of each bin the low-order bits are kept, packed as hexadecimal
digits; those of a copy are hashed with the bin's number, so that two short
texts with few shingles don't agree in all copies by one chance. Unrelated bins
agree by chance once in 2^bits; ``likeness`` takes that share off, which makes it
an estimate of the Jaccard similarity of the shingle sets.

The main path is DataFrame functions only, and all of a fingerprint is made
inside its row, so ``fingerprints`` has no shuffle.

Defined results: letters A to Z are lower-cased; a text of fewer than five
words is one shingle; a null or empty text, or one of blanks, has the
fingerprint '', which is like '' (1.0) and unlike all others (0.0); repeated
rows and null ids are taken row by row; an empty table gives an empty one; other
columns are ignored. A very long text takes memory in proportion to its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import GAP_PATTERN, let, written

#: Words of a shingle.
WORDS = 5

#: Bins are 2^BIN_BITS; BITS of each are stored (8 or 16).
BIN_BITS, BITS = 7, 8

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of the word shingles, repeats included."""
    whole = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    hashed = F.transform(F.array_remove(F.split(whole, GAP_PATTERN), ""), lambda w: F.xxhash64(w))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, words))))

    return let(hashed, of)


def _bin(h: Column, bin_bits: int) -> Column:
    return F.shiftright(h, 64 - bin_bits) + F.lit(1 << (bin_bits - 1)).cast("bigint")


def _minima(hashes: Column, bin_bits: int) -> Column:
    """The least hash of each non-empty bin, by bin."""
    return let(F.sort_array(hashes), lambda s: F.filter(
        s, lambda h, i: (i == 0) | (F.shiftright(F.get(s, i - 1), 64 - bin_bits) != F.shiftright(h, 64 - bin_bits))))


def _filled(minima: Column, bin_bits: int, bits: int) -> Column:
    """Low-order bits of every bin, by bin."""
    low = lambda h: h.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    bins = F.sequence(F.lit(0).cast("bigint"), F.lit((1 << bin_bits) - 1).cast("bigint"))

    def of(m: Column) -> Column:
        own = F.transform(m, lambda h: F.struct(_bin(h, bin_bits).alias("b"), low(h).alias("v")))

        def copied(b: Column) -> Column:
            first = F.array_min(F.transform(m, lambda h: F.struct(F.xxhash64(b, _bin(h, bin_bits)).alias("g"), h.alias("h"))))
            return F.struct(b.alias("b"), low(F.xxhash64(first["h"], b)).alias("v"))

        empty = F.array_except(bins, F.transform(m, lambda h: _bin(h, bin_bits)))
        return F.when(F.size(m) == 1 << bin_bits, own).otherwise(F.sort_array(F.concat(own, F.transform(empty, copied))))

    return let(minima, of)


def fingerprint(text: Column, words: int = WORDS, bin_bits: int = BIN_BITS, bits: int = BITS) -> Column:
    """The packed fingerprint of a text."""
    if bits not in (8, 16):
        raise ValueError("bits are 8 or 16")
    digits = bits // 4
    packed = lambda m: F.array_join(F.transform(
        _filled(m, bin_bits, bits), lambda x: F.lpad(F.lower(F.hex(x["v"])), digits, "0")), "")
    return let(_minima(shingles(text, words), bin_bits), lambda m: F.when(F.size(m) == 0, F.lit("")).otherwise(packed(m)))


def likeness(a: Column, b: Column, bin_bits: int = BIN_BITS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets, 0 to 1."""
    n, width, chance = 1 << bin_bits, bits // 8, 2.0 ** -bits
    same = lambda x, y: F.size(F.filter(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.substring(x, i * width + 1, F.lit(width)) == F.substring(y, i * width + 1, F.lit(width))))
    share = let(F.struct(F.unhex(a).alias("x"), F.unhex(b).alias("y")), lambda s: same(s["x"], s["y"])) / F.lit(float(n))
    return (F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, words: int = WORDS, bin_bits: int = BIN_BITS, bits: int = BITS) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row."""
    return docs.select("doc_id", fingerprint(F.col("text"), words, bin_bits, bits).alias("fingerprint"))


#: A row's key: its id (0 where null), whether that is null, and a hash of its
#: text. None of them is null, so keys join by plain equality.
KEY = ("i", "z", "x")


def following(keys: DataFrame) -> DataFrame:
    """For each distinct row of KEY and ``n``: the next key, ``next`` (a struct),
    by descending id (null last), then text hash; the first one comes after the
    last. Keys are dealt out by range, and the only rows that one task sees of all
    ranges are their first ones."""
    order = [F.col("z"), F.col("i").desc(), F.col("x")]
    dealt = written(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("next", F.lead(F.struct(*KEY)).over(Window.partitionBy("part").orderBy(*order)))
    firsts = dealt.groupBy("part").agg(F.min_by(F.struct(*KEY), F.struct("z", F.bitwise_not("i").alias("d"), "x")).alias("key"))
    ahead = Window.orderBy("part")
    least = F.first("key").over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    firsts = firsts.select("part", F.coalesce(F.lead("key").over(ahead), least).alias("other"))
    # the last key of a range has no next one inside
    ends = inside.where("next IS NULL").join(firsts, "part").withColumn("next", F.col("other")).drop("other")
    return inside.where("next IS NOT NULL").unionByName(ends).drop("part")


def op11(docs: DataFrame) -> DataFrame:
    """The contract's columns. Rows that repeat an id with another text follow
    each other by a hash of the text; equal rows count once in the order and get
    the same results.

    The texts are shuffled once, by key; both joins read that shuffle. One sends
    the head of each document, a third of its predecessor's length, to the
    predecessor."""
    whole = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("z"), F.xxhash64("text").alias("x"),
                       whole.alias("text"))
    keys = rows.select(*KEY, F.char_length("text").alias("n")).distinct()
    wanted = following(keys).select("next.*", F.struct(*KEY).alias("to"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    printed = rows.withColumn("fp", fingerprint(F.col("text")))
    heads = printed.join(wanted, list(KEY)).select(
        "to.*", F.struct("k", "fp", F.substring("text", F.lit(1), F.col("k")).alias("head")).alias("next"))
    # a key of several rows sends one head
    both = printed.join(heads.groupBy(*KEY).agg(F.max("next").alias("next")), list(KEY))
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("next.k")), F.col("next.head"))
    out = both.select(F.when(~F.col("z"), F.col("i")).alias("doc_id"), "text", "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    out = out.withColumn("efp", fingerprint(F.col("edited")))
    return out.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
