"""HTML node table (J1) and the operators on it.

A page is tokenized ONCE into rows — one per element and per text run — by a
small ``mapInArrow`` helper around the standard library's ``html.parser``
(no HTML library is installed). Node table schema::

    page_id BIGINT, node_id INT, parent_id INT, end_id INT, depth INT,
    tag STRING            -- element name, or '#text'
    ptag STRING           -- element name of the parent ('' at the top)
    attrs MAP<STRING,STRING>
    data STRING           -- the text of a '#text' node
    n_nodes INT           -- nodes of the page

Nodes are intervals: ``node_id`` is the document order, and what an element
holds are the ids in ``(node_id, end_id]``. A row carries nothing that grows with
its depth, and the parser's work is linear however many elements a page leaves
open. ``noscript`` content is raw text, as for a parser with scripting on. A page
that the tokenizer gives up on keeps the nodes found so far and gets a last node
``#error`` with the reason.

Pages are parsed where they are read, a page never spans tasks, and its rows come
in order. ``page_fold`` uses that: it hands each page's nodes to a function in
the same stage, without a shuffle. What needs a page's structure (selectors,
shell signals, main content, markdown, tables) is a fold, and gives rows or one row
per page; the rest is Spark on those.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import urls as U
from ..functions.text import go_trim
from .selectors import Automaton

# --- fixed values -------------------------------------------------------------
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
# a start tag of one of these closes an open <p>
CLOSES_P = frozenset(
    ("address article aside blockquote details div dl fieldset figcaption figure footer form "
     "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul").split())
# start tag → the open siblings it closes implicitly, up to a boundary
IMPLIED_CLOSE = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "thead": ({"tbody", "tfoot", "thead", "tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "tfoot", "thead", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "tfoot", "thead", "tr", "td", "th"}, {"table"}),
}
# -------------------------------------------------------------------------------

#: Node rows handed over at once; bounds the worker's memory.
ROWS_PER_BATCH = 20_000
#: ... and rows of folds, each as long as a page's text.
FOLDED_PER_BATCH = 1_000

#: Key in ``attrs`` of an ordered list's items: no attribute can have it.
ITEM_NUMBER = "#number"

NODE_SCHEMA = (
    "page_id BIGINT, node_id INT, parent_id INT, end_id INT, depth INT, tag STRING, ptag STRING, "
    "attrs MAP<STRING,STRING>, data STRING, n_nodes INT"
)


class _TreeBuilder(HTMLParser):
    """Stack-based tree builder with the common HTML5 implied-end rules. The
    places of open elements are kept by name, so that finding one never walks
    the stack."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: dict[int, int] = {}     # next item number of open <ol>
        self.rows: list[list] = []
        self.stack: list[int] = []          # open element row indexes
        self.open: dict[str, list[int]] = {}    # tag → its places in the stack

    # row: [node_id, parent_id, end_id, depth, tag, attrs, data]
    def _add(self, tag: str, attrs: dict, data: str | None) -> int:
        nid = len(self.rows)
        self.rows.append([nid, self.stack[-1] if self.stack else -1, nid, len(self.stack), tag, attrs, data])
        return nid

    def _close_to(self, place: int):
        rows, last = self.rows, len(self.rows) - 1
        while len(self.stack) > place:
            row = rows[self.stack.pop()]
            row[2] = last
            self.open[row[4]].pop()

    def _place(self, names: Iterable[str]) -> int:
        place, opened = -1, self.open
        for t in names:
            if (p := opened.get(t)) and p[-1] > place:
                place = p[-1]
        return place

    def _close_open(self, names: Iterable[str], boundary: Iterable[str] = ()):
        """Close the nearest open element of ``names`` that no boundary hides."""
        place = self._place(names)
        if place >= 0 and place > self._place(boundary):
            self._close_to(place)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_open(("p",), ("button", "table", "td", "th", "li"))
        if tag in IMPLIED_CLOSE:
            self._close_open(*IMPLIED_CLOSE[tag])
        a = {k: (v if v is not None else "") for k, v in reversed(attrs)} if attrs else {}
        nid = self._add(tag, a, None)
        if tag == "ol":
            start = a.get("start", "")
            self.items[nid] = int(start) if start.isdecimal() and len(start) < 10 else 1
        elif tag == "li":
            place = self._place(("ul", "ol"))
            if place >= 0 and (list_id := self.stack[place]) in self.items:
                a[ITEM_NUMBER] = str(self.items[list_id])
                self.items[list_id] += 1
        if tag not in VOID_TAGS:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(nid)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: (v if v is not None else "") for k, v in reversed(attrs)}, None)

    def handle_endtag(self, tag):
        if p := self.open.get(tag):
            self._close_to(p[-1])

    def handle_data(self, data):
        if data:
            self._add("#text", {}, data)

    def finish(self):
        self.close()
        self._close_to(0)


#: A plain token: text, a start tag with plain attributes, an end tag, a doctype or a comment.
#: On pages of these the library's tokenizer gives the same events, but takes several times as long.
_PLAIN = re.compile(
    r"""([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+(?=[ \t\n>])))?)*)[ \t\n]*>"""
    r"""|</([a-zA-Z][a-zA-Z0-9]*)[ \t\n]*>|<!(?:doctype|DOCTYPE)[^<>]*>|<!--[^<>-]*-->""")
_PLAIN_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
#: Elements whose content some version of the library's tokenizer takes as raw.
_RAW_TAGS = frozenset("script style noscript textarea title xmp iframe noembed noframes plaintext".split())


def _plain_tokens(html: str) -> list[tuple] | None:
    """(text, tag, attributes, end tag) of each token; None if some token is not
    plain. Text of raw elements stands in the third place, without a tag."""
    tokens, at, n = [], 0, len(html)
    while at < n:
        for m in _PLAIN.finditer(html, at):
            if m.start() != at:
                return None
            at = m.end()
            tokens.append(m.groups())
            tag = m[2]
            if tag is not None and (name := tag.lower()) in _RAW_TAGS:
                # raw up to its own end tag, if that is the first one, in every version
                z = html.find("</", at)
                if z < 0 or not html.startswith(f"</{name}>", z):
                    return None
                inner = html[at:z]
                if "<!--" in inner or (name not in _TreeBuilder.CDATA_CONTENT_ELEMENTS and ("<" in inner or "&" in inner or name == "plaintext")):
                    return None
                if inner:
                    tokens.append((None, None, inner, None))
                at = z
                break
        else:
            break
    return tokens if at == n else None


def _feed_plain(b: _TreeBuilder, html: str) -> bool:
    """Hands the page's tokens to ``b``; False, with nothing handed, for a page
    with others than plain ones."""
    tokens = _plain_tokens(html)
    if tokens is None:
        return False
    start, stop, data = b.handle_starttag, b.handle_endtag, b.handle_data
    for text, tag, attrs, end in tokens:
        if text is not None:
            data(unescape(text) if "&" in text else text)
        elif end is not None:
            stop(end.lower())
        elif tag is not None:
            found = []
            if attrs:
                for m in _PLAIN_ATTR.finditer(attrs):
                    k, *values = m.groups()
                    v = values[0] if values[0] is not None else values[1] if values[1] is not None else values[2]
                    found.append((k.lower(), unescape(v) if v and "&" in v else v))
            start(tag.lower(), found)
        elif attrs is not None:
            data(attrs)
    return True


def parse_html(html: str | None) -> list[list]:
    """Rows [node_id, parent_id, end_id, depth, tag, attrs, data] of a page."""
    b = _TreeBuilder()
    try:
        if not _feed_plain(b, html or ""):
            b.feed(html or "")
        b.finish()
    except Exception as e:  # a page is never lost, and never lost from sight
        b._close_to(0)
        n = len(b.rows)
        b.rows.append([n, -1, n, 0, "#error", {}, f"{type(e).__name__}: {e}"])
    return b.rows


_ARROW = pa.schema([
    ("page_id", pa.int64()), *[(c, pa.int32()) for c in ("node_id", "parent_id", "end_id", "depth")], ("tag", pa.string()), ("ptag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("data", pa.string()), ("n_nodes", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=schema.names)


def _parse_batches(keep: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for pid, html in zip(b.column("page_id").to_pylist(), b.column("html")):
                rows = parse_html(html.as_py())
                n = len(rows)
                for nid, parent, end, depth, tag, attrs, data in rows:
                    ptag = rows[parent][4] if parent >= 0 else ""
                    if keep is None or tag in keep or (tag == "#text" and ptag in keep):
                        out.append((pid, nid, parent, end, depth, tag, ptag, list(attrs.items()), data, n))
                        if len(out) >= ROWS_PER_BATCH:
                            yield _batch(out, _ARROW)
                            out = []
        if out:
            yield _batch(out, _ARROW)

    return parse


def html_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
               num_partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per element / text run of every page, parsed where the
    pages are read. ``num_partitions`` spreads a table of too few files over
    more tasks first, at the price of shuffling the HTML. With ``keep`` only
    elements of these names, and the text runs directly in them, leave the
    parser (for callers that need no more; such a table can't be folded)."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    if num_partitions:
        src = src.repartition(num_partitions)
    nodes = src.mapInArrow(_parse_batches(None if keep is None else frozenset(keep)), NODE_SCHEMA)
    if keep is None:
        nodes._parsed_from = src               # a fold of this very table need not see its rows
    return nodes


def parse_once(nodes: DataFrame) -> DataFrame:
    """Keep a node table that several operators read so that the Python parse
    runs once per page: persisted in executor memory spilling to disk; a lost
    block is recomputed from lineage. The caller releases it. For tables reused
    across jobs, write it to Parquet instead and read it ``in_page_order``."""
    from pyspark import StorageLevel
    return nodes.persist(StorageLevel.MEMORY_AND_DISK)


class Page:
    """A page's nodes as columns; a node is its index."""

    def __init__(self, page_id: int, parent: list[int], end: list[int], tag: list[str], attrs: list, data: list):
        self.page_id, self.parent, self.end, self.tag, self.data = page_id, parent, end, tag, data
        self.attrs = [dict(a) if a else {} for a in attrs]
        self._text: tuple[str, list[int]] | None = None
        self._places: dict[bool, tuple[list[int], list[int]]] = {}

    def stream(self) -> tuple[str, list[int]]:
        """All text, and where each node's begins (and at last the end)."""
        if self._text is None:
            at, starts, runs = 0, [], []
            for d in self.data:
                starts.append(at)
                if d:
                    runs.append(d)
                    at += len(d)
            starts.append(at)
            self._text = "".join(runs), starts
        return self._text

    def text(self, i: int) -> str:
        """Text of everything in node ``i``."""
        whole, starts = self.stream()
        return whole[starts[i]:starts[self.end[i] + 1]]

    def places(self, of_type: bool) -> tuple[list[int], list[int]]:
        """Place of each element among its siblings (of its name), from 1, and
        how many there are."""
        if of_type not in self._places:
            n = len(self.tag)
            seen: dict = {}
            place, key = [0] * n, [None] * n
            for i, t in enumerate(self.tag):
                if t[0] != "#":
                    key[i] = (self.parent[i], t) if of_type else self.parent[i]
                    place[i] = seen[key[i]] = seen.get(key[i], 0) + 1
            self._places[of_type] = place, [seen.get(k, 0) for k in key]
        return self._places[of_type]


def page_of(rows: list[list], page_id: int = 0) -> Page:
    """A Page of ``parse_html``'s rows."""
    _, parent, end, _, tag, attrs, data = zip(*rows) if rows else ([],) * 7
    return Page(page_id, list(parent), list(end), list(tag), list(attrs), list(data))


_FOLDED = ["page_id", "node_id", "parent_id", "end_id", "tag", "attrs", "data", "n_nodes"]


def page_fold(nodes: DataFrame, fold: Callable[[Page], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold`` on every page's nodes; its rows follow ``page_id`` in ``schema``
    (DDL, page_id first). ``nodes`` has whole pages in order, as ``html_nodes``
    gives them; other tables go through ``in_page_order`` first. A page that
    is not whole raises. Where ``nodes`` is what ``html_nodes`` gave, and not kept by
    ``parse_once``, pages are parsed and folded in one step: the same nodes, which
    never become rows."""
    out_schema = to_arrow_schema(T.StructType.fromDDL(schema))

    def parse_and_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for pid, html in zip(b.column("page_id").to_pylist(), b.column("html")):
                if rows := parse_html(html.as_py()):
                    out += [(pid, *row) for row in fold(page_of(rows, pid))]
                    if len(out) >= FOLDED_PER_BATCH:
                        yield _batch(out, out_schema)
                        out = []
        if out:
            yield _batch(out, out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in _FOLDED]
        for b in batches:
            for h, c in zip(held, _FOLDED):
                h.extend(b.column(c).to_pylist())
            at, out = 0, []
            ids, places, sizes = held[0], held[1], held[7]
            while at < len(ids) and at + sizes[at] <= len(ids):
                z = at + sizes[at]
                if places[at] != 0 or places[z - 1] != z - at - 1 or ids[at] != ids[z - 1]:
                    raise ValueError("a page's nodes are not together and in order: use in_page_order(nodes)")
                page = Page(ids[at], *(h[at:z] for h in held[2:7]))
                out += [(page.page_id, *row) for row in fold(page)]
                at = z
            if out:
                yield _batch(out, out_schema)
            held = [h[at:] for h in held]
        if held[0]:
            raise ValueError("a page's nodes are not together and in order: use in_page_order(nodes)")

    if (src := nodes.__dict__.get("_parsed_from")) is not None and not nodes.is_cached:
        return src.mapInArrow(parse_and_run, schema)
    return nodes.select(*_FOLDED).mapInArrow(run, schema)


def parse_fold(pages: DataFrame, fold: Callable[[Page], tuple], schema: str, html_col: str = "html") -> DataFrame:
    """Parse and fold in one pass: ``pages`` without its HTML, with the columns
    (``schema``, DDL) of the one row that ``fold`` gives for each page. For jobs
    that need a page's results once, and its nodes never: no node rows, no join,
    no shuffle, and a page may have any key. A null or empty page has no nodes."""
    kept = [c for c in pages.columns if c != html_col]
    added = T.StructType.fromDDL(schema)
    out_schema = T.StructType([pages.schema[c] for c in kept] + added.fields)
    types = to_arrow_schema(added).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fold(page_of(parse_html(h.as_py()))) for h in b.column(html_col)]
            new = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, names=out_schema.names)

    return pages.mapInArrow(run, out_schema)


def in_page_order(nodes: DataFrame) -> DataFrame:
    """A stored or shuffled node table with each page's rows together and in
    order again (one shuffle by page; ids of pages must be unique)."""
    return nodes.repartition("page_id").sortWithinPartitions("page_id", "node_id")


def page_title(nodes: DataFrame) -> DataFrame:
    """First ``<title>`` text, trimmed; pages without one are absent."""
    run = F.when(F.col("tag") == "#text", F.struct("node_id", "parent_id", "data"))
    titles = (nodes.filter((F.col("tag") == "title") | ((F.col("tag") == "#text") & (F.col("ptag") == "title")))
              .groupBy("page_id")
              .agg(F.min(F.when(F.col("tag") == "title", F.col("node_id"))).alias("first"), F.array_sort(F.collect_list(run)).alias("runs")))
    mine = F.transform(F.filter("runs", lambda r: r["parent_id"] == F.col("first")), lambda r: r["data"])
    return titles.select("page_id", go_trim(F.array_join(mine, "")).alias("title"))


def page_links(nodes: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Every ``a[href]`` in document order, C19-filtered and resolved
    against the page URL (C20). The page side carries only (id, url)."""
    anchors = (nodes.filter((F.col("tag") == "a") & F.col("attrs").getItem("href").isNotNull())
               .select("page_id", "node_id", F.col("attrs").getItem("href").alias("href")))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url_col).alias("base_url"),
                        U.url_parts(F.col(url_col)).alias("_rb"))       # parsed once per page
    j = anchors.filter(U.link_candidate("href")).join(base, "page_id")
    resolved = U.with_resolved(j, "base_url", "href", "link").filter(F.col("link").isNotNull() & F.col("_web"))
    w = Window.partitionBy("page_id").orderBy("node_id")
    return resolved.select("page_id", F.row_number().over(w).cast("int").alias("link_pos"),
                           "href", "link")


# --- J4: CSS selectors -----------------------------------------------------------

def select_many(nodes: DataFrame, selectors: dict[str, str], with_text: bool = True) -> DataFrame:
    """Matches of many selectors in one pass: ``page_id, selector`` (its
    name), ``node_id, end_id, tag, attrs, text`` (null without ``with_text``).
    Selectors know names, ``*``, ids, classes, attribute tests, the combinators
    ``' ' > + ~``, lists, ``:not() :is()``, ``:first-child``, ``:last-child``,
    ``:only-child``, ``:nth-child()``, ``:nth-last-child()``, the same ``-of-type``,
    ``:empty`` and ``:root``, on any element of a chain. Anything else, and bad
    selectors, raise ``ValueError`` (validation) at once."""
    automaton = Automaton(selectors)

    def fold(page: Page) -> Iterator[tuple]:
        for i, found in automaton.matches(page):
            text = page.text(i) if with_text else None
            for k in found:
                yield automaton.names[k], i, page.end[i], page.tag[i], list(page.attrs[i].items()), text

    return page_fold(nodes, fold, "page_id BIGINT, selector STRING, node_id INT, end_id INT, tag STRING, "
                                  "attrs MAP<STRING,STRING>, text STRING")


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """Matching elements in document order, one row each, with their
    subtree range and text. Nested matches are all kept (as the reference
    does)."""
    return select_many(nodes, {"": selector}).drop("selector")


def element_text(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Text of everything in chosen elements (``page_id, node_id, end_id``), by a
    merge of both by page: a page's runs are joined once, and an element's text is
    what stands between its ids. Returns ``page_id, node_id, text``."""
    runs = nodes.filter(F.col("tag") == "#text").select("page_id", "node_id", "data")
    chosen = elements.select("page_id", "node_id", "end_id").distinct()
    schema = "page_id BIGINT, node_id INT, text STRING"

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("node_id")
        ids, at = left.column("node_id").to_numpy(), [0]
        data = left.column("data").to_pylist()
        for d in data:
            at.append(at[-1] + len(d))
        whole = "".join(data)
        a, z = (ids.searchsorted(right.column(c).to_numpy(), side="right").tolist() for c in ("node_id", "end_id"))
        texts = pa.array([whole[at[x]:at[y]] for x, y in zip(a, z)], pa.string())
        return pa.table([right.column("page_id"), right.column("node_id"), texts], names=["page_id", "node_id", "text"])

    return runs.groupBy("page_id").cogroup(chosen.groupBy("page_id")).applyInArrow(merge, schema)


def absolutize_attrs(nodes: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``href`` and ``src`` resolved against the page URL. Only nodes that
    have either are joined; the rows are no longer in page order."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url_col).alias("_base"))
    has = F.coalesce(F.map_contains_key("attrs", "href") | F.map_contains_key("attrs", "src"), F.lit(False))
    j = nodes.filter(has).join(base, "page_id", "left")
    fix = F.transform_values(
        "attrs",
        lambda k, v: F.when(k.isin("href", "src") & U.link_candidate(v),
                            F.coalesce(U.resolve_url(F.col("_base"), v), v)).otherwise(v))
    return nodes.filter(~has).unionByName(j.withColumn("attrs", fix).drop("_base"))
