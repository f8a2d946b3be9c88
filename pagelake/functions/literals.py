"""Literals that a pattern requires, and grams to look them up by.

A regular expression can only be tried row by row, but most hold some plain
text that every match must contain. Rules (D6) and code search (J14) join on
short grams of that text first and try the expression on what is left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"\\(?:[xpP]\{[^}]*\}|x[0-9A-Fa-f]{2}|[pP].|0[0-7]{1,3}|Q.*?(?:\\E|$)|.)", re.S)
_REPEAT = re.compile(r"(?:([*?])|\+|\{(\d+)(?:,\d*)?\})\??")
_CLASS = re.compile(r"\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", re.S)
_FLAGS = re.compile(r"\(\?([A-Za-z]*)(?:-[A-Za-z]*)?([:)])")
_NAMED = re.compile(r"\(\?P?<\w+>")


class _Unknown(Exception):
    """Something in the pattern that is not read here."""


def _sequence(p: str, i: int) -> tuple[list[str], int]:
    """Runs of plain text that each match of ``p[i:]`` contains, up to the
    end of its group; none if it has alternatives."""
    runs, run, alternatives = [], "", False

    def cut() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(p) and p[i] != ")":
        c, inner, plain = p[i], [], ""
        if c == "|":
            alternatives = True
            cut()
            i += 1
            continue
        if c == "(":
            flags = _FLAGS.match(p, i)
            named = _NAMED.match(p, i)
            if flags and set(flags[1]) - set("imsUd"):
                raise _Unknown
            if flags and flags[2] == ")":
                i = flags.end()
                continue
            if p.startswith("(?", i) and not flags and not named:
                raise _Unknown
            head = flags or named
            inner, i = _sequence(p, head.end() if head else i + 1)
            if i >= len(p):
                raise _Unknown
            i += 1
        elif c == "[":
            found = _CLASS.match(p, i)
            if not found:
                raise _Unknown
            i = found.end()
        elif c == "\\":
            found = _ESCAPE.match(p, i)
            if not found:
                raise _Unknown
            i = found.end()
            if len(found[0]) == 2 and not found[0][1].isalnum():
                plain = found[0][1]
        else:
            plain = "" if c in ".^$*+?{}" else c
            i += 1
        if not plain.isascii():
            plain = ""
        repeat = _REPEAT.match(p, i)
        if repeat:
            i = repeat.end()
            if repeat[1] or (repeat[2] and int(repeat[2]) == 0):
                plain, inner = "", []
        run += plain
        if repeat or not plain:
            cut()
        runs += inner
    cut()
    return ([] if alternatives else runs), i


def required_literal(pattern: str) -> str:
    """The longest text that every match of the pattern contains, in lower
    case and ASCII; '' where none is known. Compare it with lower-cased text:
    that holds whether or not the pattern heeds case."""
    try:
        runs, end = _sequence(pattern, 0)
    except _Unknown:
        return ""
    return max(runs, key=len, default="").lower() if end == len(pattern) else ""


def ascii_grams(text: Column, n: int) -> Column:
    """Distinct ASCII pieces of ``n`` characters of the lower-cased text, at
    every place; linear in its length. Null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?s)(?=([\x00-\x7F]{%d}))" % n), 1)
    return F.array_distinct(found)


def term_grams(literal: str, n: int) -> list[str]:
    """``ascii_grams`` of a parameter."""
    pieces = {literal[i:i + n] for i in range(len(literal) - n + 1)}
    return sorted(g for g in pieces if g.isascii())
