"""Operator 3, token counts: the whole-token shortcut.

``whole_tokens`` proves offline, once per file, which vocabulary strings the
merges turn into exactly one token when they stand alone as a pre-token. A
text's count is then the number of its pre-tokens in that set plus the merged
length of each of the rest; only the rest ever reach the merge loop.

Pre-tokens come from the library's own normalizer and splitter, per blank
separated stretch; plain ASCII stretches take an equal expression. Each worker
remembers the counts of stretches seen (bounded, speed only).

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows and null ids are counted row by row; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelake.llm.common import doc_texts
from pagelake.llm.tokens import CACHE_WORDS, default_path, loaded, word_units

LIMIT = 2048

#: The file's own split on lower-case ASCII without white space.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Control characters that count as white space there.
_ODD = re.compile(r"[\x00-\x20\x7f]")


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens (in the file's byte letters, without the end mark) that the
    merges make into one token."""
    tok = loaded(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    bare = (v.removesuffix(end) for v in model["vocab"] if v.endswith(end))
    return frozenset(b for b in bare if b and len(tok.model.tokenize(b)) == 1)


class Counts:
    """Token counts of texts under one ``word`` file."""

    def __init__(self, path: str):
        self.tok, self.whole, self.seen = loaded(path), whole_tokens(path), {"": 0}
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def pre_tokens(self, part: str) -> list[str]:
        if part.isascii() and not _ODD.search(part):
            return _ASCII.findall(part.lower())
        norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    def stretch(self, word: str) -> int:
        n, parts = 0, [word]
        if self.special and "<" in word:
            parts = self.special.split(word)
        for k, part in enumerate(parts):
            if k % 2:
                n += 1
                continue
            for p in self.pre_tokens(part):
                n += 1 if p in self.whole else len(self.tok.model.tokenize(p))
        return n

    def text(self, text: str) -> int:
        total = 0
        for word, times in Counter(word_units(text)).items():
            n = self.seen.get(word)
            if n is None:
                if len(self.seen) >= CACHE_WORDS:
                    self.seen = {"": 0}
                n = self.seen[word] = self.stretch(word)
            total += n * times
        return total


_counts: dict[str, Counts] = {}


def counter(path: str) -> Counts:
    if path not in _counts:
        _counts[path] = Counts(path)
    return _counts[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    path = path or default_path("word_bpe_49k.json")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [c.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_texts(docs).mapInArrow(count, schema)


def op3(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
