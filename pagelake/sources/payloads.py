"""Sources: URL lists and backend payload tables (A1, A2, A4, A5, A10).

Payloads are stored rows (``query_id, backend, body``), never fetched. Each
backend's JSON shape is parsed with an explicit schema (``from_json``, no
inference) and flattened with ``posexplode`` — row-wise, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import go_trim

ITEM = "struct<title:string,url:string,description:string>"
# backend → (payload schema, path to the result array, description field)
SEARCH_SHAPES = {
    "brave": ("struct<web:struct<results:array<struct<title:string,url:string,description:string>>>>",
              "web.results", "description"),
    "searxng": ("struct<results:array<struct<title:string,url:string,content:string>>>", "results", "content"),
    "firecrawl": ("struct<success:boolean,data:struct<web:array<struct<title:string,url:string,"
                  "description:string>>>>", "data.web", "description"),
    "keenable": ("struct<results:array<struct<title:string,url:string,description:string>>>", "results",
                 "description"),
}


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """A1: one URL per line; trimmed; blank and ``#`` lines dropped; input
    order kept as ``input_pos``."""
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    t = go_trim("value")
    return (lines.select(t.alias("url"), "_id").filter((F.col("url") != "") & ~F.col("url").startswith("#"))
            .select("url", F.col("_id").alias("input_pos")))


def urls_from_json(df: DataFrame, col: str = "body") -> DataFrame:
    """A2: a JSON array of URLs → ``url, input_pos`` rows; an empty or
    unparsable array is one error row (``error_kind = 'validation'``)."""
    arr = F.from_json(F.col(col), "array<string>")
    ok = df.filter(F.size(arr) > 0).select(F.posexplode(arr).alias("input_pos", "url"))
    ok = ok.withColumn("error", F.lit(None).cast("string")).withColumn("error_kind", F.lit(None).cast("string"))
    bad = df.filter(F.coalesce(F.size(arr), F.lit(-1)) <= 0).select(
        F.lit(None).cast("int").alias("input_pos"), F.lit(None).cast("string").alias("url"),
        F.lit("URL list must be a non-empty JSON array").alias("error"), F.lit("validation").alias("error_kind"))
    return ok.unionByName(bad)


def _items(backend: Column, body: Column) -> Column:
    out = F.lit(None).cast(f"array<{ITEM}>")
    for name, (schema, path, desc) in SEARCH_SHAPES.items():
        parsed = F.from_json(body, schema)
        arr = parsed
        for part in path.split("."):
            arr = arr.getField(part)
        items = F.transform(arr, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"),
                                                    x[desc].alias("description")))
        if name == "firecrawl":   # entries without a URL are dropped
            items = F.filter(items, lambda x: F.coalesce(x["url"], F.lit("")) != "")
        out = F.when(backend == name, items).otherwise(out)
    return out


def normalize_search(raw: DataFrame, limit: int = 0) -> DataFrame:
    """A4: ``query_id, backend, backend_ord, body`` → ranked rows
    ``query_id, backend, backend_ord, rank, title, url, description,
    content`` (rank = position + 1 after per-backend filtering; cut to
    ``limit`` when > 0)."""
    items = _items(F.col("backend"), F.col("body"))
    if limit > 0:
        # Each backend's own cap on top of the requested limit
        caps = F.create_map(*[x for b in SEARCH_SHAPES for x in (F.lit(b), F.lit(backend_limit(b, limit)))])
        items = F.slice(items, 1, F.coalesce(caps[F.col("backend")], F.lit(limit)))
    ex = raw.select("query_id", "backend", "backend_ord", F.posexplode(items).alias("pos", "it"))
    return ex.select("query_id", "backend", "backend_ord", (F.col("pos") + 1).cast("int").alias("rank"),
                     F.coalesce("it.title", F.lit("")).alias("title"), F.coalesce("it.url", F.lit("")).alias("url"),
                     F.coalesce("it.description", F.lit("")).alias("description"), F.lit("").alias("content"))


def payloads_from_lists(lists: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Group ranked lists back into one JSON payload per (query, backend)
    in the shape of ``kinds[backend]``. A group holds one backend's list
    for one query (≤ the backend's fetch depth)."""
    kind = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])[F.col("backend")]
    g = lists.groupBy("query_id", "backend", "backend_ord").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "url", "description"))).alias("l"))
    g = g.withColumn("kind", kind)
    plain = F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"),
                                                x["description"].alias("description")))
    sx = F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"),
                                             x["description"].alias("content")))
    body = (F.when(F.col("kind") == "brave", F.to_json(F.struct(F.struct(plain.alias("results")).alias("web"))))
            .when(F.col("kind") == "searxng", F.to_json(F.struct(sx.alias("results"))))
            .when(F.col("kind") == "firecrawl",
                  F.to_json(F.struct(F.lit(True).alias("success"), F.struct(plain.alias("web")).alias("data"))))
            .otherwise(F.to_json(F.struct(plain.alias("results")))))
    return g.select("query_id", F.col("kind").alias("backend"), "backend_ord", body.alias("body"))


def sse_data_lines(body: Column) -> Column:
    """A5 helper: the payloads of ``data:`` lines (lines trimmed), in order,
    blanks dropped."""
    from .blocks import data_lines
    return data_lines(body)


def sse_last_data(body: Column) -> Column:
    """A5 (last-wins policy): the last non-empty ``data:`` payload."""
    from .blocks import last_data
    return last_data(body)


def sse_first_decodable(body: Column, schema: str, field: str) -> Column:
    """A5 (first-wins policy): the first ``data:`` payload that decodes and
    carries ``field`` (a result or an error)."""
    return F.get(F.filter(sse_data_lines(body),
                          lambda d: F.from_json(d, schema).getField(field).isNotNull()), 0)


# --- G4: per-backend result limits (fixed values of the backends' APIs) ---------
BRAVE_MAX = 20
GITHUB_DEFAULT, GITHUB_MAX = 30, 100


def backend_limit(backend: str, limit: int) -> int:
    """Brave caps at 20 and asks for nothing when limit ≤ 0; Firecrawl
    and Keenable return nothing for limit ≤ 0; a GitHub page size outside
    1-100 becomes 30; others pass the limit through."""
    if backend == "brave":
        return 0 if limit <= 0 else min(limit, BRAVE_MAX)
    if backend in ("firecrawl", "keenable"):
        return max(limit, 0)
    if backend == "github":
        return limit if 1 <= limit <= GITHUB_MAX else GITHUB_DEFAULT
    return limit


# --- L1: pluggable result sources ------------------------------------------------
def register_search_shape(name: str, schema: str, path: str, description_field: str = "description") -> None:
    """L1: add a backend's JSON shape (explicit schema, dotted path to the
    result array, the field that becomes the description) to the registry
    ``normalize_search`` dispatches on."""
    SEARCH_SHAPES[name] = (schema, path, description_field)


def library_matches(raw: DataFrame, n: int) -> DataFrame:
    """A10: library matches in upstream order, first ``n`` (``n`` ≤ 0 keeps
    all). ``raw.body`` = ``{"results": [...]}``."""
    schema = ("struct<results:array<struct<id:string,title:string,description:string,totalSnippets:int,"
              "trustScore:double,versions:array<string>>>>")
    ex = raw.select(F.posexplode(F.from_json("body", schema)["results"]).alias("pos", "m"))
    if n > 0:
        ex = ex.filter(F.col("pos") < n)
    return ex.select("pos", F.col("m.id").alias("id"), F.col("m.title").alias("title"),
                     F.col("m.description").alias("description"), F.col("m.totalSnippets").alias("total_snippets"),
                     F.col("m.trustScore").alias("trust_score"), F.col("m.versions").alias("versions"))
