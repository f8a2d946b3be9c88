"""Scalar text functions (I1-I16). All are JVM-side Column expressions.

Regexes run on the JVM with ``(?d)`` (UNIX_LINES) so that ``.``, ``^`` and
``$`` only know ``\\n``, like the reference's RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Unicode white space as the reference splits words (Go unicode.IsSpace):
WS_CLASS = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
TRUNCATED_MARKER = "\n\n[truncated]"
# markdown stripping patterns, applied in this order after fences are protected
FENCE_RE = r"(?s)```.*?```"
MD_RULES = (
    (r"\*\*(.+?)\*\*", "$1"),            # bold
    (r"__(.+?)__", "$1"),                # bold, underscores
    (r"\*([^\s*\n][^*\n]*?)\*", "$1"),  # italic (not a list marker)
    (r"_([^_\n]+?)_", "$1"),            # italic, underscores
    (r"!\[[^\]]*\]\([^)]*\)", ""),      # images removed
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),   # links keep their text
    (r"(?m)^#{1,6}\s+(.+)$", "$1"),     # headings keep their text
    (r"`([^`]+)`", "$1"),               # inline code
)
SENTINEL = "\u0000FC"
# error kinds and the CLI exit codes they mirror
ERROR_KINDS = {"validation": 2, "not_found": 3, "upstream": 4, "precondition": 5, "cancelled": 6}
REASON_KIND = {
    "canceled": "cancelled", "cancelled": "cancelled", "deadline_exceeded": "cancelled", "timeout": "cancelled",
    "not_found": "not_found", "http_404": "not_found", "no_match": "not_found",
    "invalid_input": "validation", "unknown_backend": "validation", "empty_input": "validation",
    "too_large": "validation", "pdf_rejected": "validation", "bad_selector": "validation",
    "missing_api_key": "precondition", "no_browser": "precondition", "unimplemented": "precondition",
}
# ---------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def go_trim(c: Column | str) -> Column:
    """Trim Unicode white space from both ends (``strings.TrimSpace``)."""
    return F.regexp_replace(_c(c), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def strip_markdown(c: Column | str) -> Column:
    """Fenced blocks protected by indexed sentinels, inline rules applied
    in order, then fences restored."""
    s = _c(c)
    pieces = F.split(s, FENCE_RE)
    fences = F.regexp_extract_all(s, F.lit(FENCE_RE), 0)
    n = F.size(fences)
    protected = F.array_join(
        F.transform(pieces, lambda p, i: F.concat(
            p, F.when(i < n, F.concat(F.lit(SENTINEL), i.cast("string"), F.lit("\u0000"))).otherwise(F.lit("")))),
        "",
    )
    # fast path: without fences the rules run on the text itself
    out = F.when(n == 0, s).otherwise(protected)
    for pat, rep in MD_RULES:
        out = F.regexp_replace(out, "(?d)" + pat, rep)
    restored = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        out,
        lambda acc, i: F.when(i < n, F.replace(acc, F.concat(F.lit(SENTINEL), i.cast("string"), F.lit("\u0000")),
                                                F.get(fences, i))).otherwise(acc),
    )
    return F.when(s.isNull(), s).when(n == 0, out).otherwise(restored)


def truncate(c: Column | str, n: int) -> Column:
    """Cap at ``n`` code points and append the marker; ``n`` ≤ 0 is off."""
    s = _c(c)
    if n <= 0:
        return s
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(TRUNCATED_MARKER))).otherwise(s)


def post_process(c: Column | str, trim: bool = False, max_chars: int = 0) -> Column:
    """I1 (when ``trim``) then I2."""
    s = _c(c)
    if trim:
        s = strip_markdown(s)
    return truncate(s, max_chars)


def word_count(c: Column | str) -> Column:
    """I4: number of Unicode-white-space separated fields (a regex count of
    non-space runs: no array is built)."""
    return F.regexp_count(_c(c), F.lit("[^" + WS_CLASS[1:-1] + "]+")).cast("long")


def first_line(c: Column | str) -> Column:
    """First non-blank line, trimmed ('' when none): skip leading white
    space (blank lines included), take the rest of that line, trim it."""
    return F.coalesce(go_trim(F.regexp_extract(_c(c), "^" + WS_CLASS + "*([^\n]*)", 1)), F.lit(""))


def content_hash(c: Column | str) -> Column:
    """First 16 hex characters of SHA-256."""
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def cache_key(url: Column | str) -> Column:
    """Store key of an (already rewritten) URL — I6 of the URL."""
    return content_hash(url)


def normalize_ws(c: Column | str) -> Column:
    """Collapse white space runs to one space, trimmed."""
    return go_trim(F.regexp_replace(_c(c), WS_CLASS + "+", " "))


def unwrap_redirect(c: Column | str, param: str = "uddg") -> Column:
    """Decoded value of ``param`` when present and non-empty, else input."""
    from .urls import _query_pairs, url_parts

    s = _c(c)
    p = url_parts(s)
    pairs = F.filter(_query_pairs(p["query"]),
                     lambda x: x["k"].isNotNull() & x["v"].isNotNull() & ~x["semi"])
    first = F.get(F.filter(pairs, lambda x: x["k"] == param), 0)["v"]
    return F.when(p["valid"] & F.coalesce(first != "", F.lit(False)), first).otherwise(s)


def best_line(text: Column | str, start_line: Column | int, term: str | Column) -> Column:
    """Within a snippet (stopping at the next ``--- Snippet`` header),
    the first line containing ``term`` case-insensitively, else the first
    non-empty line. Returns ``STRUCT<line STRING, line_no INT>`` with the
    trimmed line and its absolute number (``start_line`` + offset)."""
    lines = F.split(_c(text), "\n")
    stop = F.array_position(F.transform(lines, lambda x: x.startswith("--- Snippet")), True)
    body = F.when(stop > 0, F.slice(lines, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(lines)
    start = F.lit(start_line) if isinstance(start_line, int) else _c(start_line)
    t = F.lower(F.lit(term) if isinstance(term, str) else term)
    numbered = F.filter(
        F.transform(body, lambda x, i: F.struct(go_trim(x).alias("line"), (start + i).cast("int").alias("line_no"))),
        lambda r: r["line"] != "",
    )
    hit = F.get(F.filter(numbered, lambda r: F.lower(r["line"]).contains(t)), 0)
    first = F.get(numbered, 0)
    empty = F.struct(F.lit("").alias("line"), F.lit(0).alias("line_no"))
    return F.coalesce(hit, first, empty)


def matched_line(fragment: Column | str, byte_offset: Column | str) -> Column:
    """The line around a byte offset; else the first non-empty line;
    else the trimmed fragment."""
    f = _c(fragment)
    off = _c(byte_offset)
    nbytes = F.octet_length(f)
    prefix = F.decode(F.substring(F.encode(f, "UTF-8"), 1, off), "UTF-8")
    cpos = F.length(prefix)  # characters before the match
    before = F.substring(f, 1, cpos)
    after = F.substring(f, cpos + 1, F.length(f))
    start_part = F.regexp_extract(before, r"(?s)([^\n]*)$", 1)
    end_part = F.regexp_extract(after, r"(?s)^([^\n]*)", 1)
    around = go_trim(F.concat(start_part, end_part))
    fallback = F.coalesce(F.get(F.filter(F.transform(F.split(f, "\n"), lambda x: go_trim(x)),
                                         lambda x: x != ""), 0), go_trim(f))
    return F.when(off.isNotNull() & (off >= 0) & (off < nbytes), around).otherwise(fallback)


def has_pipe_table(md: Column | str) -> Column:
    """Markdown holds a pipe table delimiter row."""
    s = _c(md)
    return (s.startswith("|---") | s.startswith("|:--") | s.contains("\n|---") | s.contains("\n|:--"))


def error_kind(reason: Column | str) -> Column:
    """Reason code → error kind (unknown reasons are upstream)."""
    m = F.create_map(*[x for k, v in REASON_KIND.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.lower(_c(reason))], F.lit("upstream"))


def exit_code(kind: Column | str) -> Column:
    m = F.create_map(*[x for k, v in ERROR_KINDS.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(kind)]


def is_expired(cached_at: Column | str, now: Column, ttl_seconds: int | Column) -> Column:
    """I16: strictly older than the TTL."""
    ttl = F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(_c(cached_at).cast("timestamp"))
    return age > ttl.cast("long") * F.lit(1_000_000)


def parse_ttl_seconds(ttl: str | None, default: str = "72h") -> int:
    """Go-duration TTL (``72h``, ``90m``, ``1h30m``); unparsable → 1 hour."""
    import re
    s = (ttl or default).strip()
    units = {"h": 3600, "m": 60, "s": 1, "ms": 0.001}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", s)
    if not parts or "".join(a + b for a, b in parts) != s:
        return 3600
    return int(sum(float(a) * units[b] for a, b in parts))
