import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import token_counts, tokens
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs, sf_docs

WORD, BYTE = tokens.default_path("word_bpe_49k.json"), tokens.default_path("byte_bpe_50k.json")
KINDS = {"word": WORD, "byte": BYTE}
PIECES = ["a", "Don't", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\u0085", " ", " ", "<|endoftext|>", "<|startoftext|>", "12", "é",
          "é", "́", "İ", "ΣΑΣ", "'s", "'", "…", "日本", "​", "\U0001f44d", "ß", "ẞ", "x", "...", "̸", "="]


def same(kind, text):
    want = tokens.loaded(KINDS[kind]).encode(text, add_special_tokens=False).ids
    got = np.frombuffer(tokens.encoder(KINDS[kind], kind).encode([text])[0], tokens.ID).tolist()
    assert got == want


@pytest.mark.parametrize("kind", KINDS)
def test_units_hold_for_every_code_point(kind):
    for lo in range(0, 0x30000, 64):
        cs = [chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000]
        same(kind, "".join(f"a{c}b {c} {c}{c}\n{c}\n {c}. " for c in cs))


@pytest.mark.parametrize("kind", KINDS)
def test_odd_texts(kind):
    for t in ODD_TEXTS:
        same(kind, t or "")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_units_compose(text):
    same("word", text)
    same("byte", text)
    assert token_counts.counter(WORD).text(text) == len(tokens.loaded(WORD).encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proved():
    whole = token_counts.whole_tokens(WORD)
    tok = tokens.loaded(WORD)
    assert len(whole) > 30_000
    for w in sorted(whole)[::500]:
        assert len(tok.model.tokenize(w)) == 1


def test_counts_equal_the_library(spark):
    tok = tokens.loaded(WORD)
    for docs in (sf_docs(spark), odd_docs(spark)):
        want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids))
                      for r in docs.collect())
        got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.op3(docs).collect())
        assert got == want
    assert token_counts.op3(empty_docs(spark)).count() == 0


def test_counts_on_every_code_point():
    c, tok = token_counts.counter(WORD), tokens.loaded(WORD)
    for lo in range(0, 0x20000, 64):
        t = "".join(f"a{chr(x)}b {chr(x)} {chr(x)}1 " for x in range(lo, lo + 64) if not 0xD800 <= x < 0xE000)
        assert c.text(t) == len(tok.encode(t, add_special_tokens=False).ids), hex(lo)


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    enc = tokens.UnitEncoder(WORD, "word")
    texts = [t or "" for t in ODD_TEXTS]
    want = [tokens.loaded(WORD).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, tokens.ID).tolist() for b in enc.encode(texts)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([*PIECES, "\v", "\f", "\x01", "　"]), max_size=25).map("".join), max_size=9))
def test_batches_equal_the_library(texts):
    ids, n = tokens.encoder(BYTE, "byte").batch(pa.array(texts, pa.string()))
    want = [tokens.loaded(BYTE).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == want


def test_a_batch_looks_up_its_distinct_units_once():
    enc = tokens.UnitEncoder(BYTE, "byte", room=3)
    asked = []
    enc.tokenize = lambda part: asked.append(part) or enc.tok.model.tokenize(part)
    texts = ["the cat, the dog", " the cat", None, "élan the dog"] * 50
    ids, n = enc.batch(pa.array(texts, pa.string()))
    assert len(asked) <= 10
    want = [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == want
