"""Operator 8, language-model scoring: Brown class-based n-grams.

P(text) is the product over its tokens of P(class | class before) times
P(word | class). Exchange clustering puts words into classes so that the class
bigrams lose little of the word bigrams' mutual information.

* Counts: every distinct word of the training documents is counted
  (``blocks``: one row per distinct word and block is shuffled).
* Items: a word that makes up at least ``min_share`` of all training tokens is
  an item of its own; there can be no more than 1 / min_share of them, which
  bounds what tasks get by broadcast. Rarer words share an item per shape
  (length, letters, end), a fixed small set, to begin with.
* Bigrams of items are counted over all training documents, and items are
  exchanged between classes in rounds: each round scores the move of every
  item to every class from its class neighbours (grouped sums in Spark, at
  most 2 * classes numbers an item) and carries out the gainful moves of a
  part of the items, since moves made at the same time spoil each other.
* Single words: then every rarer word of the training documents, however many
  there are, leaves its shape's class for the class that is likeliest for its
  own neighbours. Its class neighbours are counted block by block and summed by
  word (``neighbours``, ``single_moves``); the moves hold if the class bigrams,
  counted anew over all words, are better for it, else half of them, and so on.
  Only words that no training document has keep the class of their shape.
* Smoothing: class transitions interpolate with the class unigrams by
  ``prior`` observations; a word has (c + 0.5) / (N + 0.5 (V + 1)) within its
  class, so that each class keeps half a count for all words it never saw.

Defined results: a null or empty text is its end token alone; a null id counts
as the empty id text; repeated rows are learnt from and scored row by row; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.blocks import block_texts, block_words, restore, stable
from pagelake.llm.common import doc_texts, written

HELD_OUT = 1
FOLDS = 5
SHAPES = 64
#: Rarer words whose shape a task remembers. Speed only.
SHAPED = 300_000


@dataclass(frozen=True)
class Settings:
    classes: int = 48
    rounds: int = 6
    min_share: float = 2e-4
    prior: float = 5.0


def split(text: str) -> list[bytes]:
    """Words of the contract: bytes.lower and bytes.split know ASCII only."""
    return text.encode().lower().split()


def is_training(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS != HELD_OUT for i in ids.to_pylist()], bool)


def shape(word: bytes) -> int:
    """Length (8 steps), kind of the last byte (4), any byte beyond ASCII (2)."""
    last = word[-1]
    end = 0 if 97 <= last <= 122 else 1 if 48 <= last <= 57 else 2 if last < 128 else 3
    return (min(len(word) // 3, 7) * 4 + end) * 2 + (not word.isascii())


class Items(dict):
    """Item of a word: its own, or that of its shape (after the words)."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.words = len(words)

    def __missing__(self, word: bytes) -> int:
        item = self.words + shape(word)
        if len(self) < SHAPED:
            self[word] = item
        return item


def vocabulary(docs: DataFrame) -> DataFrame:
    """The words with ``c``, the word's count in training documents, and
    ``blocks``, the blocks that have it: a row for each word, so ``first``, by
    which callers take one row of each, is true. Written: used several times."""
    words = block_words(docs, split, counted=is_training)
    sums = words.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks"))
    return written(sums.withColumn("first", F.lit(True)))


def _item_totals(vocab: DataFrame, words: list[bytes]) -> np.ndarray:
    """Count and distinct words of each item, from every counted word."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(words)
        c, v = np.zeros(len(words) + SHAPES, np.int64), np.zeros(len(words) + SHAPES, np.int64)
        for b in batches:
            at = np.fromiter(map(items.__getitem__, b.column("word").to_pylist()), np.int64, b.num_rows)
            np.add.at(c, at, b.column("c").to_numpy())
            np.add.at(v, at, 1)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(c[some]), pa.array(v[some])], names=["item", "c", "v"])

    counted = vocab.where("first AND c > 0").select("word", "c").mapInArrow(total, "item long, c long, v long")
    out = np.zeros((2, len(words) + SHAPES), np.int64)
    for r in counted.groupBy("item").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        out[:, r.item] = r.c, r.v
    return out


def item_bigrams(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """a, b, n: neighbours among the items of all training documents; the item
    after the shapes is the end of a text, and the start of the next."""
    end = len(words) + SHAPES
    size = end + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(words)
        held, n_held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(pairs), 100_000):
                p = pairs[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(p // size), pa.array(p % size), pa.array(n[at:at + 100_000])],
                                                 names=["a", "b", "n"])

        for b in batches:
            for text, used in zip(b.column("text"), is_training(b.column("doc_id"))):
                if not used:
                    continue
                ws = split(text.as_py() or "")
                seq = np.empty(len(ws) + 2, np.int64)
                seq[0] = seq[-1] = end
                seq[1:-1] = np.fromiter(map(items.__getitem__, ws), np.int64, len(ws))
                held.append(seq[:-1] * size + seq[1:])
                n_held += len(seq)
                if n_held > 5_000_000:
                    yield from flush()
                    held, n_held = [], 0
        if held:
            yield from flush()

    pairs = doc_texts(docs).mapInArrow(count, "a long, b long, n long")
    return written(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")))


def _entropy(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def objective(table: np.ndarray) -> float:
    """What exchange raises: the class bigrams' mutual information, unscaled."""
    return float(_entropy(table).sum() - _entropy(table.sum(0)).sum() - _entropy(table.sum(1)).sum())


def _best_moves(items: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, classes: np.ndarray,
                table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best class of each item and its gain. after[k]: how often each class
    follows item k; before[k]: precedes it; own[k]: item k follows itself."""
    n = table.shape[0]
    best, gain = classes[items].copy(), np.zeros(len(items))
    for k, item in enumerate(items):
        a = classes[item]
        out, into = after[k].copy(), before[k].copy()
        out[a] -= own[k]
        into[a] -= own[k]
        rest = table.copy()
        rest[a] -= out
        rest[:, a] -= into
        rest[a, a] -= own[k]
        rows, cols = rest.sum(1) + into, rest.sum(0) + out  # the item's neighbours stay where they are
        n_out, n_in = out.sum() + own[k], into.sum() + own[k]
        # entropy gained by adding the item to class c, for all c at once
        row = (_entropy(rest + out) - _entropy(rest)).sum(1)
        col = (_entropy(rest + into[:, None]) - _entropy(rest)).sum(0)
        d = np.diag(rest)
        cross = _entropy(d + out + into + own[k]) - _entropy(d + out) - _entropy(d + into) + _entropy(d)
        score = row + col + cross - (_entropy(rows + n_out) - _entropy(rows)) - (_entropy(cols + n_in) - _entropy(cols))
        score[n - 1] = -np.inf  # the end of a text stays alone
        c = int(np.argmax(score))
        if score[c] > score[a] + 1e-9:
            best[k], gain[k] = c, score[c] - score[a]
    return best, gain


def class_table(bigrams: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Class bigram counts: classes squared numbers."""
    spark = bigrams.sparkSession
    small = spark.createDataFrame(list(enumerate(classes.tolist())), "item long, class long")
    sums = (bigrams.join(F.broadcast(small.toDF("a", "ca")), "a").join(F.broadcast(small.toDF("b", "cb")), "b")
            .groupBy("ca", "cb").agg(F.sum("n").alias("n")))
    out = np.zeros((n_classes, n_classes), np.int64)
    for r in sums.collect():
        out[r.ca, r.cb] = r.n
    return out


def exchange(bigrams: DataFrame, counts: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """(class of each item, class bigram table). The last item and the last
    class are the end of a text. Items and classes are bounded; the bigrams,
    which are not, stay in Spark."""
    spark = bigrams.sparkSession
    n_items, n_classes = len(counts) + 1, settings.classes + 1
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    classes = np.append(rank % settings.classes, settings.classes)
    table = class_table(bigrams, classes, n_classes)
    schema = "item long, best long, gain double"
    for turn in range(settings.rounds):
        small = spark.createDataFrame(list(enumerate(classes.tolist())), "item long, class long")
        follow = (bigrams.where("a <> b").join(F.broadcast(small), F.col("b") == F.col("item"))
                  .groupBy(F.col("a").alias("item"), "class").agg(F.sum("n").alias("n")).withColumn("side", F.lit(0)))
        lead = (bigrams.where("a <> b").join(F.broadcast(small), F.col("a") == F.col("item"))
                .groupBy(F.col("b").alias("item"), "class").agg(F.sum("n").alias("n")).withColumn("side", F.lit(1)))
        itself = bigrams.where("a = b").select(F.col("a").alias("item"), F.lit(0).cast("long").alias("class"), "n", F.lit(2).alias("side"))
        sides = follow.unionByName(lead).unionByName(itself).where(
            (F.col("item") < n_items - 1) & (F.pmod(F.xxhash64("item"), F.lit(3)) == turn % 3))

        def moves(rows: pa.Table) -> pa.Table:
            items, at = np.unique(rows.column("item").to_numpy(), return_inverse=True)
            side, c, n = (rows.column(x).to_numpy() for x in ("side", "class", "n"))
            nums = np.zeros((3, len(items), table.shape[0]), np.int64)
            np.add.at(nums, (side, at, c), n)
            own = nums[2, :, 0]
            best, gain = _best_moves(items, nums[0] + _onto(own, classes[items], table), nums[1] + _onto(own, classes[items], table),
                                     own, classes, table)
            return pa.table({"item": items, "best": best, "gain": gain})

        found = sides.groupBy(F.pmod(F.xxhash64("item", F.lit(7)), F.lit(32)).alias("part")).applyInArrow(moves, schema)
        gainful = sorted(((r.gain, r.item, r.best) for r in found.where("gain > 0").collect()), reverse=True)
        share = len(gainful)
        while share:  # all gainful moves, else the better half of them, and so on
            tried = classes.copy()
            for _, item, best in gainful[:share]:
                tried[item] = best
            new = class_table(bigrams, tried, n_classes)
            if objective(new) > objective(table):
                classes, table = tried, new
                break
            share //= 2
    return classes, table


def _onto(own: np.ndarray, classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(own), table.shape[0]), np.int64)
    out[np.arange(len(own)), classes] = own
    return out


#: The largest number of times that one entry of ``neighbours`` has.
_MOST = 65535


def neighbours(words: list[bytes], classes: np.ndarray):
    """For ``block_words``: the class neighbours of each word of a block that
    shares an item, as pairs of 16-bit numbers (code, times). Codes: classes
    that follow the word, classes before it, the word itself after it."""
    n_classes = int(classes.max()) + 1
    codes = 2 * n_classes + 1

    def about(block: list[bytes], texts: list[np.ndarray]) -> pa.Array:
        n = len(block)
        item = np.fromiter(map(Items(words).__getitem__, block), np.int64, n)
        kind = np.append(classes[item], n_classes - 1)
        single = np.append(item >= len(words), False)
        end, found, held, size = np.array([n], np.uint32), [], [], 0
        for k, t in enumerate(texts):
            held += [end, t]
            size += len(t)
            if size < 1_000_000 and k + 1 < len(texts):
                continue
            seq = np.concatenate([*held, end]).astype(np.int64)
            held, size = [], 0
            a, b = seq[:-1], seq[1:]
            same = a == b
            out, into, own = single[a] & ~same, single[b] & ~same, single[a] & same
            key, times = np.unique(np.concatenate([a[out] * codes + kind[b[out]], b[into] * codes + n_classes + kind[a[into]],
                                                   a[own] * codes + codes - 1]), return_counts=True)
            pieces = -(-times // _MOST)
            whole = np.repeat(key << 16 | _MOST, pieces)
            whole[np.cumsum(pieces) - 1] += times - pieces * _MOST
            found.append(whole)
        whole = np.concatenate(found) if found else np.empty(0, np.int64)
        del found
        whole.sort()
        ends = np.searchsorted(whole, np.arange(n + 1) * codes << 16).astype(np.int32) * np.int32(4)
        pairs = np.empty((len(whole), 2), "<u2")
        pairs[:, 1] = whole & 0xFFFF
        whole >>= 16
        whole %= codes
        pairs[:, 0] = whole
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(pairs.tobytes())])

    return about


def likeness(table: np.ndarray, prior: float) -> np.ndarray:
    """For each code of ``neighbours`` and each class, the log of how much more
    often the two meet than by chance. ``prior`` observations by chance keep
    small classes, which any word's own few neighbours suit, from drawing all."""
    chance = table.sum(1, keepdims=True) * (table.sum(0) / max(1, table.sum()))
    m = np.log((table + prior) / (chance + prior))
    return np.concatenate([m.T, m, np.diag(m)[None]])


def single_moves(word: np.ndarray, code: np.ndarray, times: np.ndarray, own: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The class of each word that its neighbours are likeliest in, its own if
    none is better. Entries (word, code, times) are ascending and distinct."""
    best = own.copy()
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    for at in range(0, len(firsts), 20_000):
        some = firsts[at:at + 20_000]
        e = slice(some[0], firsts[at + 20_000] if at + 20_000 < len(firsts) else len(word))
        score = np.add.reduceat(like[code[e]] * times[e, None], some - some[0], axis=0)
        score[:, -1] = -np.inf  # the end of a text stays alone
        w, top, every = word[some], score.argmax(1), np.arange(len(some))
        best[w] = np.where(score[every, top] > score[every, own[w]] + 1e-9, top, own[w])
    return best


#: Shares of the single words' moves that are tried, of SHARES[0].
SHARES = (8, 4, 2, 1, 0)
#: Block words that one group of the moves takes, about.
MOVE_ROWS = 200_000


def single_words(docs: DataFrame, vocab: DataFrame, words: list[bytes], classes: np.ndarray, like: np.ndarray) -> DataFrame:
    """The block words: at; c: the word's count; first: true on one row of each
    word; was and best: the class of the word's item and its own; turn: what
    share of the moves it belongs to."""
    near = block_words(docs, split, counted=is_training, about=neighbours(words, classes))
    codes = len(like)
    schema = "at long, c long, first boolean, was int, best int, turn int"

    def moves(rows: pa.Table) -> pa.Table:
        of = rows.column("word").combine_chunks().dictionary_encode()
        names, word = of.dictionary.to_pylist(), of.indices.to_numpy().astype(np.int64)
        c = np.zeros(len(names), np.int64)
        np.add.at(c, word, rows.column("n").to_numpy())
        was = classes[np.fromiter(map(Items(words).__getitem__, names), np.int64, len(names))]
        about = rows.column("about").to_pylist()
        pairs = np.frombuffer(b"".join(about), "<u2").reshape(-1, 2).astype(np.int64)
        key = np.repeat(word, [len(x) >> 2 for x in about]) * codes + pairs[:, 0]
        key, place = np.unique(key, return_inverse=True)
        times = np.zeros(len(key), np.int64)
        np.add.at(times, place, pairs[:, 1])
        best = single_moves(key // codes, key % codes, times, was, like)
        first = np.zeros(len(word), bool)
        first[np.unique(word, return_index=True)[1]] = True
        turn = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % SHARES[0]
        return pa.table({"at": rows.column("at"), "c": c[word], "first": first, "was": was[word].astype(np.int32),
                         "best": best[word].astype(np.int32), "turn": turn[word].astype(np.int32)})

    parts = max(32, (vocab.agg(F.sum("blocks")).first()[0] or 0) // MOVE_ROWS)
    return written(near.groupBy(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part")).applyInArrow(moves, schema))


@dataclass(frozen=True)
class Model:
    """Bounded by 1 / min_share words and classes squared transitions: the
    items' classes; ``singles`` is what single words' classes made of it."""

    words: list[bytes]
    classes: np.ndarray
    log_next: np.ndarray
    class_count: np.ndarray
    class_words: np.ndarray
    train_tokens: int
    train_words: int
    end_count: int
    singles: Singles | None = None


@dataclass(frozen=True)
class Singles:
    """Classes of all words: ``placed`` (at, c, first, class) as in
    ``single_words``, ``paths`` as in ``class_paths``."""

    placed: DataFrame
    paths: DataFrame
    table: np.ndarray
    log_next: np.ndarray
    class_count: np.ndarray
    class_words: np.ndarray


def _log_next(table: np.ndarray, prior: float) -> np.ndarray:
    row, col = table.sum(1, keepdims=True), table.sum(0)
    unigram = (col + 0.5) / (col + 0.5).sum()
    return np.log10((table + prior * unigram) / (row + prior))


def train(docs: DataFrame, vocab: DataFrame, settings: Settings = Settings()) -> Model:
    n_train = int(doc_texts(docs).select("doc_id").mapInArrow(
        lambda bs: (pa.RecordBatch.from_arrays([pa.array([int(is_training(b.column("doc_id")).sum())])], names=["n"]) for b in bs),
        "n long").agg(F.sum("n")).first()[0] or 0)
    sums = vocab.where("first AND c > 0").agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, distinct = int(sums[0] or 0) + n_train, int(sums[1]) + (n_train > 0)
    least = max(1, -(-tokens * settings.min_share // 1))
    frequent = vocab.where(F.col("first") & (F.col("c") >= int(least))).select("word", "c").collect()
    words = [bytes(r.word) for r in sorted(frequent, key=lambda r: (-r.c, r.word))]
    totals = _item_totals(vocab, words)
    classes, table = exchange(item_bigrams(docs, words), totals[0], settings)
    count, known = (np.bincount(classes[:-1], t, settings.classes + 1) for t in totals)
    model = Model(words, classes, _log_next(table, settings.prior), count, known, tokens, distinct, n_train)
    moves = single_words(docs, vocab, words, classes, likeness(table, settings.prior))
    for share in SHARES:  # all moves, else half of them, and so on
        placed = moves.select("at", "c", "first", F.when(F.col("turn") < share, F.col("best")).otherwise(F.col("was")).alias("class"))
        by_class = placed.where("first AND c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
        count, known = np.zeros(settings.classes + 1), np.zeros(settings.classes + 1)
        for r in by_class:
            count[r["class"]], known[r["class"]] = r.c, r.v
        paths = class_paths(docs, placed, replace(model, class_count=count, class_words=known))
        new = path_table(paths, settings.classes + 1)
        if not share or objective(new) > objective(table):
            return replace(model, singles=Singles(placed, paths, new, _log_next(new, settings.prior), count, known))
    raise AssertionError("the last share is 0")


def class_paths(docs: DataFrame, placed: DataFrame, model: Model) -> DataFrame:
    """Every document: counts, base score, the sum of the words' probabilities
    within their classes, and the classes, a number of ``path_type`` each."""
    kind = docs.schema["doc_id"]
    schema = T.StructType([kind, *(T.StructField(n, t()) for n, t in (
        ("held_out", T.BooleanType), ("n_tokens", T.LongType), ("n_known", T.LongType), ("base_score", T.DoubleType),
        ("word_score", T.DoubleType), ("path", T.BinaryType)))])
    path_type = _path_type(len(model.class_count))

    def sums(rows: pa.Table, ids: pa.Array, lengths: np.ndarray, places: np.ndarray) -> pa.Table:
        c, k = rows.column("c").to_numpy().astype(np.float64), rows.column("class").to_numpy()
        whole = model.train_tokens + 0.5 * (model.train_words + 1)
        base = np.log10((c + 0.5) / whole)
        base_end = np.log10((model.end_count + 0.5) / whole)
        word = np.log10((c + 0.5) / (model.class_count[k] + 0.5 * (model.class_words[k] + 1)))
        k = k.astype(path_type)
        out, known, paths = np.empty((2, len(lengths))), np.empty(len(lengths), np.int64), []
        at = 0
        for d, n in enumerate(lengths):
            here = places[at:at + n]
            at += n
            out[0, d] = base[here].sum() + base_end
            out[1, d] = word[here].sum()
            known[d] = np.count_nonzero(c[here]) + (model.end_count > 0)
            paths.append(k[here].tobytes())
        return pa.table({
            "doc_id": ids, "held_out": pa.array(~is_training(ids)), "n_tokens": pa.array(lengths + 1, pa.int64()),
            "n_known": pa.array(known), "base_score": pa.array(out[0]), "word_score": pa.array(out[1]), "path": pa.array(paths, pa.binary())})

    return written(restore(placed.select("at", "c", "class"), block_texts(docs, split), sums, schema))


def _path_type(n_classes: int) -> np.dtype:
    return np.min_scalar_type(n_classes - 1).newbyteorder("<")


def _steps(path: bytes, n_classes: int) -> np.ndarray:
    """Class bigrams of a text, from the end before it to its own."""
    k = np.frombuffer(path, _path_type(n_classes))
    whole = np.full(len(k) + 2, n_classes - 1, np.int64)
    whole[1:-1] = k
    return whole[:-1] * n_classes + whole[1:]


def path_table(paths: DataFrame, n_classes: int) -> np.ndarray:
    """Class bigram counts of the training documents: classes squared numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_classes ** 2, np.int64)
        for b in batches:
            for path in b.column("path"):
                n += np.bincount(_steps(path.as_py(), n_classes), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["step", "n"])

    out = np.zeros(n_classes ** 2, np.int64)
    steps = paths.where("NOT held_out").select("path").mapInArrow(count, "step long, n long")
    for r in steps.groupBy("step").agg(F.sum("n").alias("n")).collect():
        out[r.step] = r.n
    return out.reshape(n_classes, n_classes)


def score(docs: DataFrame, model: Model, vocab: DataFrame) -> DataFrame:
    """Every document: counts, base score and the model's score. ``docs`` and
    ``vocab`` are those the model was trained with; it has their paths."""
    last = model.singles
    n_classes, log_next, train_tokens = len(last.class_count), last.log_next.ravel(), model.train_tokens
    kind = docs.schema["doc_id"]
    schema = T.StructType([kind, *(T.StructField(n, t()) for n, t in (
        ("held_out", T.BooleanType), ("n_tokens", T.LongType), ("n_known", T.LongType), ("train_tokens", T.LongType),
        ("base_score", T.DoubleType), ("score", T.DoubleType)))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = np.array([log_next[_steps(p.as_py(), n_classes)].sum() for p in b.column("path")])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
                + [pa.array(np.full(b.num_rows, train_tokens)), b.column("base_score"),
                   pa.array(b.column("word_score").to_numpy() + steps)], names=schema.names)

    return last.paths.mapInArrow(add, schema)


def op8(docs: DataFrame) -> DataFrame:
    docs = stable(docs)
    vocab = vocabulary(docs)
    return score(docs, train(docs, vocab), vocab)
