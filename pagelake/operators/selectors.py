"""CSS selectors as one bit-set automaton over a page in document order.

Every compound of every selector is a bit. A compound may match a node where its
tests hold and where the compound before it matched what its combinator names:
an ancestor, the parent, the last sibling or an earlier sibling. These sets come
down the tree and along the siblings as integers, so all selectors are decided
in one pass, each node is seen once, and depth costs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: A test of node ``i`` of a page.
Test = Callable[["object", int], bool]

_IDENT = r"-?(?:[A-Za-z_]|[^\x00-\x7F]|\\.)(?:[\w-]|[^\x00-\x7F]|\\.)*"
_TOKEN = re.compile(
    rf"""(?P<ws>\s+)|(?P<comb>[>+~])|(?P<comma>,)|(?P<star>\*)|\#(?P<id>(?:[\w-]|[^\x00-\x7F]|\\.)+)|\.(?P<cls>{_IDENT})
    |:(?P<pseudo>{_IDENT})(?P<open>\()?
    |\[\s*(?P<attr>[A-Za-z_:][-\w:.]*)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s"'\]=]+))\s*)?\]
    |(?P<tag>{_IDENT})""", re.X)

_ATTR_TESTS = {
    "=": lambda v, x: v == x,
    "^=": lambda v, x: x != "" and v.startswith(x),
    "$=": lambda v, x: x != "" and v.endswith(x),
    "*=": lambda v, x: x != "" and x in v,
    "~=": lambda v, x: x in v.split(),
    "|=": lambda v, x: v == x or v.startswith(x + "-"),
}


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


@dataclass
class Compound:
    combinator: str = ""            # to the compound before: ' ', '>', '+', '~'; '' for the first
    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    tests: list[Test] = field(default_factory=list)

    def empty(self) -> bool:
        return self.tag is None and not (self.ids or self.classes or self.tests)

    def matches(self, page, i: int) -> bool:
        """All of the compound's own tests (not its context)."""
        if self.tag not in (None, "*") and page.tag[i] != self.tag:
            return False
        a = page.attrs[i]
        if self.ids and any(a.get("id") != x for x in self.ids):
            return False
        if self.classes:
            have = a.get("class", "").split()
            if any(c not in have for c in self.classes):
                return False
        return all(t(page, i) for t in self.tests)


def _nth(arg: str) -> Callable[[int], bool]:
    arg = re.sub(r"\s+", "", arg.lower())
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", arg):
        a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
        b = int(m[2] or 0)
    elif re.fullmatch(r"[+-]?\d+", arg):
        a, b = 0, int(arg)
    else:
        raise ValueError(f"bad position: {arg!r}")
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _place(of_type: bool, last: bool, fits: Callable[[int], bool]) -> Test:
    def test(page, i: int) -> bool:
        first, total = page.places(of_type)
        return fits(total[i] - first[i] + 1 if last else first[i])

    return test


_ONE = lambda k: k == 1
_PLACES = {"first-child": (False, False), "last-child": (False, True), "first-of-type": (True, False), "last-of-type": (True, True)}
_NTH = {"nth-child": (False, False), "nth-last-child": (False, True), "nth-of-type": (True, False), "nth-last-of-type": (True, True)}


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, why: str) -> ValueError:
        return ValueError(f"bad selector {self.text!r}: {why}")

    def selectors(self, inner: bool = False) -> list[list[Compound]]:
        """A comma list of chains; with ``inner`` up to a closing bracket."""
        out: list[list[Compound]] = []
        chain, now, gap, comb = [], Compound(), False, ""

        def end_compound() -> None:
            nonlocal now
            if now.empty():
                raise self.fail("an element is missing")
            chain.append(now)
            now = Compound()

        while True:
            closing = inner and self.text.startswith(")", self.at)
            if self.at >= len(self.text) or closing:
                if inner and not closing:
                    raise self.fail("a bracket is not closed")
                end_compound()
                out.append(chain)
                self.at += closing
                return out
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise self.fail(f"at {self.text[self.at:self.at + 10]!r}")
            self.at = m.end()
            if m["ws"]:
                gap = not now.empty() or bool(chain)
                continue
            if m["comma"]:
                end_compound()
                out.append(chain)
                chain, gap, comb = [], False, ""
                continue
            if m["comb"]:
                if comb:
                    raise self.fail("two combinators")
                end_compound()
                gap, comb = False, m["comb"]
                now.combinator = comb
                continue
            if gap and not now.empty():
                end_compound()
                now.combinator = " "
            gap, comb = False, ""
            self._simple(m, now)

    def _simple(self, m: re.Match, now: Compound) -> None:
        if m["star"] or m["tag"]:
            if not now.empty():
                raise self.fail("an element's name stands first")
            now.tag = "*" if m["star"] else _plain(m["tag"]).lower()
        elif m["id"]:
            now.ids.append(_plain(m["id"]))
        elif m["cls"]:
            now.classes.append(_plain(m["cls"]))
        elif m["attr"]:
            name, op = m["attr"].lower(), m["op"]
            value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
            if op is None:
                now.tests.append(lambda page, i: name in page.attrs[i])
            else:
                test = _ATTR_TESTS[op]
                now.tests.append(lambda page, i: (v := page.attrs[i].get(name)) is not None and test(v, value))
        else:
            self._pseudo(m["pseudo"].lower(), bool(m["open"]), now)

    def _pseudo(self, name: str, opened: bool, now: Compound) -> None:
        if not opened and name in _PLACES:
            now.tests.append(_place(*_PLACES[name], _ONE))
        elif not opened and name in ("only-child", "only-of-type"):
            of_type = name == "only-of-type"
            now.tests += [_place(of_type, False, _ONE), _place(of_type, True, _ONE)]
        elif not opened and name == "empty":
            now.tests.append(lambda page, i: page.end[i] == i)
        elif not opened and name == "root":
            now.tests.append(lambda page, i: page.parent[i] < 0)
        elif opened and name in ("not", "is"):
            inner = self.selectors(inner=True)
            if any(len(c) > 1 for c in inner):
                raise self.fail(f":{name}() takes elements without combinators")
            some = lambda page, i: any(c[0].matches(page, i) for c in inner)
            now.tests.append(some if name == "is" else lambda page, i: not some(page, i))
        elif opened and name in _NTH:
            close = self.text.find(")", self.at)
            if close < 0:
                raise self.fail("a bracket is not closed")
            try:
                now.tests.append(_place(*_NTH[name], _nth(self.text[self.at:close])))
            except ValueError as e:
                raise self.fail(str(e)) from None
            self.at = close + 1
        else:
            raise self.fail(f":{name} is not supported")


class Automaton:
    """Many selectors, by name; ValueError for a bad one."""

    def __init__(self, selectors: dict[str, str]) -> None:
        self.names = list(selectors)
        self.compounds: list[Compound] = []
        self.final: dict[int, list[int]] = {}          # bit → selectors that end there
        self.first = self.down = self.child = self.next = self.later = 0
        self.by_tag: dict[str, int] = {}
        self.any_tag = 0
        for k, name in enumerate(self.names):
            for chain in _Parser(selectors[name].strip()).selectors():
                for c in chain:
                    bit = 1 << len(self.compounds)
                    kind = {"": "first", " ": "down", ">": "child", "+": "next", "~": "later"}[c.combinator]
                    setattr(self, kind, getattr(self, kind) | bit)
                    if c.tag in (None, "*"):
                        self.any_tag |= bit
                    else:
                        self.by_tag[c.tag] = self.by_tag.get(c.tag, 0) | bit
                    self.compounds.append(c)
                self.final.setdefault(len(self.compounds) - 1, []).append(k)
        self.ends = sum(1 << b for b in self.final)

    def matches(self, page) -> Iterator[tuple[int, list[int]]]:
        """Nodes in document order, with the numbers of the selectors that match."""
        n = len(page.tag)
        above, matched = [0] * n, [0] * n              # matches of ancestors; of the node
        last: dict[int, int] = {}                      # by parent: matches of its last child so far
        before: dict[int, int] = {}                    # ... and of all its children so far
        for i, tag in enumerate(page.tag):
            if tag[0] == "#":
                continue
            p = page.parent[i]
            up = matched[p] if p >= 0 else 0
            down = above[p] | up if p >= 0 else 0
            above[i] = down
            left, lefts = last.get(p, 0), before.get(p, 0)
            may = (self.first | (down << 1 & self.down) | (up << 1 & self.child) | (left << 1 & self.next)
                   | (lefts << 1 & self.later)) & (self.any_tag | self.by_tag.get(tag, 0))
            m = 0
            while may:
                low = may & -may
                may ^= low
                if self.compounds[low.bit_length() - 1].matches(page, i):
                    m |= low
            matched[i] = m
            last[p] = m
            before[p] = lefts | m
            if hit := m & self.ends:
                yield i, sorted({k for b, ks in self.final.items() if hit >> b & 1 for k in ks})
