"""Tokenizer files and exact word units, shared by operators 3, 5, 6 and 9.

A unit is a stretch of text whose ids do not depend on its neighbours, so the
ids of a text are the ids of its units in order:

* ``word``: the file drops white space and splits at it, so the stretches
  between blanks are units (other white space may stay inside a unit);
* ``byte``: a unit is a stretch of non-blanks with at most one blank before
  it, or a run of blanks; special strings are cut out first.

``tests/llm`` holds both against the library on all code points.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids below 65,536 in both files, so two bytes hold one.
ID = np.dtype("<u2")

#: Words a worker remembers (about 250 MB); then it starts anew. Speed only.
CACHE_WORDS = 1_200_000

#: White space of the byte-level split. Fixed by Unicode's White_Space.
_BLANK = "\t\n\v\f\r \x85\xa0" + "".join(map(chr, (
    0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BYTE_UNITS = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


_loaded: dict[str, object] = {}


def loaded(path: str):
    if path not in _loaded:
        _loaded[path] = load(path)
    return _loaded[path]


def word_units(text: str) -> list[str]:
    """Stretches between blanks; empty ones stay, they have no ids."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def byte_units(text: str, special: str = "<|endoftext|>") -> list[str]:
    if special not in text:
        return _BYTE_UNITS.findall(text)
    out: list[str] = []
    for k, part in enumerate(text.split(special)):
        out += [special] * bool(k) + _BYTE_UNITS.findall(part)
    return out


_IS_BLANK = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
#: What ``unit_starts`` does not cut: longer blanks and special strings.
_APART = f"[{''.join(c for c in _BLANK if not c.isascii())}]|<\\|endoftext\\|>"


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where byte units start in the UTF-8 bytes of texts one after another;
    ``at``: where each text starts, and the end of the last one."""
    blank = _IS_BLANK.take(data)
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    start = first[:-1].copy()
    enters, leaves = blank[1:] & ~blank[:-1], blank[:-1] & ~blank[1:]
    start[1:] |= enters | leaves & (data[:-1] != 0x20)
    start[:-1] |= leaves & ~first[1:-1]  # the last blank before a word of the same text
    return np.flatnonzero(start)


UNITS: dict[str, Callable[[str], list[str]]] = {"word": word_units, "byte": byte_units}


#: Byte letters of bytes that don't stand for themselves: a fixed rule of
#: byte-level vocabularies.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}
_BLANK_LETTER = chr(_LETTERS[0x20])


def _plain_letters(tok, lower: bool) -> str:
    """Latin letters beyond ASCII that the file's normalizer, one by one, does
    no more to than Python's ``lower``, and that its splitter has as letters."""
    out = []
    for c in map(chr, range(0xC0, 0x250)):
        same = tok.normalizer is None or (tok.normalizer.normalize_str(c) == c.lower() and len(c.lower()) == 1)
        if c.isalpha() and same and len(tok.pre_tokenizer.pre_tokenize_str(f"a{c.lower() if lower else c}b")) == 1:
            out.append(c)
    return "".join(out)


def _packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian 16-bit numbers; for few of them quicker than numpy."""
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Letters(dict):
    """The byte letters of a character, by its code point; a line feed stays."""

    def __missing__(self, c: int) -> str:
        self[c] = out = "\n" if c == 0x0A else chr(c).encode().decode("latin-1").translate(_LETTERS)
        return out


class _Known(dict):
    """Remembers up to ``room`` values, then starts anew."""

    def __init__(self, value: Callable[[str], bytes], room: int):
        super().__init__()
        self.value, self.room = value, room

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.room:
            self.clear()
        self[key] = out = self.value(key)
        return out


class UnitEncoder:
    """Ids of texts as little-endian 16-bit strings, unit by unit. Units of
    plain letters, digits and ASCII signs are split here by the file's own
    pattern and go to its merges part by part; all others to the library."""

    def __init__(self, path: str, kind: str, room: int | None = None):
        self.tok, self.units, self.lower = loaded(path), UNITS[kind], kind == "word"
        self.tokenize, self.letters = self.tok.model.tokenize, _Letters()
        self.id_bytes = np.zeros(1 << 8 * ID.itemsize, np.int64)
        for token, k in self.tok.get_vocab().items():
            self.id_bytes[k] = len(token)
        safe = _plain_letters(self.tok, self.lower)
        self.odd = re.compile(f"[^ !-;=-~{safe}]").search
        marks = "'s|'t|'re|'ve|'m|'ll|'d|"
        if self.lower:
            letters = "a-z" + "".join(sorted(set(safe.lower())))
            pattern = f"{marks}[{letters}]+|[0-9]|[^{letters}0-9]+"
        else:
            pattern = f"{marks} ?[A-Za-z{safe}]+| ?[0-9]+| ?[^A-Za-z0-9 {safe}]+| +"
        self.split = re.compile(pattern).findall
        room = room or CACHE_WORDS
        self.known, self.parts = _Known(self.unit, room), _Known(self._part, room)
        # of batches: units that several had, and that one had
        self.often: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if part.isascii():
            letters = part.replace(" ", _BLANK_LETTER)
        else:
            letters = part.translate(self.letters)
        return _packed([t.id for t in self.tokenize(letters)])

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of distinct units of the kind ``byte``, all parts in one go;
        where a unit's ids end is told by the bytes they stand for."""
        plain = [u for u in units if not self.odd(u)]
        out = {u: self.unit(u) for u in units if self.odd(u)} if len(plain) < len(units) else {}
        parts: list[str] = []
        for u in plain:
            if u[1:].isalpha() and (u[0] == " " or u[0].isalpha()):
                parts.append(u)
            else:
                parts += self.split(u)
        letters = "\n".join(parts).translate(self.letters).split("\n")
        ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(map(self.tokenize, letters))), ID)
        ends = np.cumsum(self.id_bytes.take(ids))
        want = np.cumsum([len(u.encode()) for u in plain])
        if len(plain) and (not len(ids) or ends[-1] != want[-1]):  # bytes without an id
            return {u: self.unit(u) for u in units}
        to, data = (ID.itemsize * (np.searchsorted(ends, want) + 1)).tolist(), ids.tobytes()
        out.update(zip(plain, [data[a:b] for a, b in zip([0, *to], to)]))
        return out

    def _look_up(self, units: list[str]) -> list[bytes]:
        """Ids of a batch's distinct units. Where there is no room for more,
        those that only one batch had are forgotten first."""
        often, once, room = self.often, self.once, self.known.room
        if len(often) + len(once) >= room:
            once.clear()
            if 4 * len(often) >= 3 * room:
                often.clear()
        out = list(map(often.get, units))
        rest = [u for u, x in zip(units, out) if x is None]
        found = {u: x for u in rest if (x := once.pop(u, None)) is not None}
        often.update(found)
        new = self._units([u for u in rest if u not in found])
        once.update(new)
        found.update(new)
        return [found[u] if x is None else x for u, x in zip(units, out)]

    def unit(self, unit: str) -> bytes:
        """Ids of one unit."""
        if not unit:
            return b""
        if self.odd(unit):
            return _packed(self.tok.encode(unit, add_special_tokens=False).ids)
        if self.lower:
            unit = unit.lower()
            if unit.isalpha():
                return self.parts[unit]
        elif unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return self._part(unit)
        return b"".join(map(self.parts.__getitem__, self.split(unit)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, self.units(t))) if t else b"" for t in texts]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and their number in each text,
        for files of the kind ``byte``. The distinct units of all texts are
        looked up once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        apart = np.flatnonzero(pc.match_substring_regex(texts, _APART).to_numpy(zero_copy_only=False))
        plain = texts
        if len(apart):
            plain = pc.if_else(pa.array(np.isin(np.arange(len(texts)), apart)), "", texts)
        at = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset:plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        cuts = unit_starts(data, at)
        units = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(data))
        units = units.dictionary_encode()
        index = units.indices.to_numpy()
        parts = self._look_up(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // ID.itemsize
        n = sizes.take(index)
        ends = np.append(0, np.cumsum(n))
        first = (np.cumsum(sizes) - sizes).take(index) - ends[:-1]
        ids = np.frombuffer(b"".join(parts), ID).take(np.repeat(first, n) + np.arange(ends[-1]))
        lengths = np.diff(ends.take(np.searchsorted(cuts, at)))
        if len(apart):
            pieces = np.split(ids, np.cumsum(lengths)[:-1])
            for k, x in zip(apart, self.encode(texts.take(pa.array(apart)).to_pylist())):
                pieces[k] = np.frombuffer(x, ID)
                lengths[k] = len(pieces[k])
            ids = np.concatenate(pieces)
        return ids, lengths


_encoders: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, kind: str, room: int | None = None) -> UnitEncoder:
    """One per worker process, kept between its tasks."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = UnitEncoder(path, kind, room)
    return _encoders[path, kind]
