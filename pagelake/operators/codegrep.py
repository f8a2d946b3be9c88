"""Code search over a files table.

The reference forwards a term to remote code-search services and shapes
their answers. Re-aimed at tables: ``files(repo, path, language, text,
archived?, fork?)`` is filtered row-wise (literal, case-insensitive, or
regex), and each matching file yields ONE row with its best line (I11),
all computed per row with array functions — no shuffle, no explode of the
whole corpus. A ``limit`` is a top-k over (repo, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_line, go_trim
from ..functions.urls import compile_pattern

# --- fixed values: language aliases (lower-case alias → canonical name) ----------
LANG_ALIASES = {
    "go": "Go", "golang": "Go", "py": "Python", "python": "Python", "js": "JavaScript",
    "javascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript", "tsx": "TSX",
    "jsx": "JSX", "rb": "Ruby", "ruby": "Ruby", "rs": "Rust", "rust": "Rust", "java": "Java",
    "kt": "Kotlin", "kotlin": "Kotlin", "c": "C", "cpp": "C++", "c++": "C++", "cs": "C#",
    "csharp": "C#", "php": "PHP", "swift": "Swift", "scala": "Scala", "sh": "Shell",
    "bash": "Shell", "shell": "Shell", "html": "HTML", "css": "CSS", "sql": "SQL",
}
RESULT_URL = "https://code.example.com/%s/blob/HEAD/%s#L%d"
# -----------------------------------------------------------------------------------


def normalize_lang(lang: str | None) -> str | None:
    """C16 (driver side, for the filter parameter)."""
    if not lang:
        return None
    return LANG_ALIASES.get(lang.lower(), lang[:1].upper() + lang[1:])


def normalize_lang_col(c: Column) -> Column:
    """C16 as a Column (for a language column): alias map, else first letter up."""
    m = F.create_map(*[x for k, v in LANG_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.lower(c)], F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30)))


def _regex_best_line(text: Column, start: int, pattern: str) -> Column:
    lines = F.split(text, "\n")
    numbered = F.filter(
        F.transform(lines, lambda x, i: F.struct(go_trim(x).alias("line"), (F.lit(start) + i).cast("int").alias("line_no"),
                                                 x.rlike(pattern).alias("m"))),
        lambda r: r["line"] != "")
    hit = F.get(F.filter(numbered, lambda r: r["m"]), 0)
    first = F.get(numbered, 0)
    return F.coalesce(hit, first)


def grep_code(files: DataFrame, term: str, lang: str | None = None, limit: int = 0,
              regexp: bool = False, include_archived: bool = False, include_forks: bool = False) -> DataFrame:
    """J14 → W4 → (limit). Output: ``repo, path, line_no, snippet, language,
    url, source``."""
    text = F.col("text")
    pattern = compile_pattern(term).java if regexp else None
    pred = text.rlike(pattern) if regexp else F.lower(text).contains(term.lower())
    df = files.filter(pred)
    want = normalize_lang(lang)
    if want is not None:
        df = df.filter(normalize_lang_col(F.col("language")) == F.lit(want))
    if not include_archived and "archived" in files.columns:        # C17
        df = df.filter(~F.coalesce(F.col("archived"), F.lit(False)))
    if not include_forks and "fork" in files.columns:
        df = df.filter(~F.coalesce(F.col("fork"), F.lit(False)))
    best = _regex_best_line(text, 1, pattern) if regexp else best_line(text, 1, term)
    out = df.select(
        "repo", "path", best["line_no"].alias("line_no"), best["line"].alias("snippet"),
        F.col("language"),
        F.format_string(RESULT_URL, F.col("repo"), F.col("path"), best["line_no"]).alias("url"),
        F.lit("files").alias("source"),
    )
    if limit > 0:
        out = out.orderBy("repo", "path").limit(limit)
    return out


def add_stars(results: DataFrame, repos: DataFrame) -> DataFrame:
    """Star counts by repository; a missing repository is not an error.
    ``repos`` (repo, stars) is one row per repository — joined by key, with
    Spark choosing broadcast only under its size threshold."""
    return results.join(repos.select("repo", "stars"), "repo", "left")


def files_from_documents(documents: DataFrame) -> DataFrame:
    """``documents`` as a files table: repo = source, path = doc id,
    language = lang."""
    return documents.select(
        F.col("source").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("lang").alias("language"), F.col("text"))
