"""Text-block and event-stream payload readers.

Every reader works row-wise on a stored payload (``query_id, body``) with
array functions — split, filter, transform, aggregate — and explodes only
the final, already limited, result array. No shuffle; a payload never
leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_line, go_trim, matched_line

# --- fixed values -----------------------------------------------------------------
# metadata labels of search text blocks that are not content
BLOCK_LABELS = ("Title:", "URL:", "Highlights:", "Published date:", "Author:", "Score:")
BLOCK_SEPARATOR = "\n---\n"
SNIPPET_HEADER = "--- Snippet"
SOURCEGRAPH_URL = "https://sourcegraph.com"
# ------------------------------------------------------------------------------------

TEXT_CONTENT = "struct<result:struct<content:array<struct<type:string,text:string>>>>"
RPC_MESSAGE = ("struct<result:struct<content:array<struct<type:string,text:string>>,isError:boolean>,"
               "error:struct<code:int,message:string>>")
SG_MATCHES = ("array<struct<type:string,repository:string,path:string,language:string,repoStars:int,"
              "lineMatches:array<struct<line:string,lineNumber:int>>>>")
GH_SEARCH = ("struct<total_count:int,items:array<struct<path:string,html_url:string,"
             "repository:struct<full_name:string,html_url:string,node_id:string>,"
             "text_matches:array<struct<fragment:string,matches:array<struct<indices:array<int>,text:string>>>>>>>")
CODE_SNIPPETS = ("array<struct<codeTitle:string,codeDescription:string,codeLanguage:string,"
                 "codeId:string,codeList:array<struct<language:string,code:string>>>>")
INFO_SNIPPETS = "array<struct<pageId:string,breadcrumb:string,content:string>>"
DOCS = f"struct<codeSnippets:{CODE_SNIPPETS},infoSnippets:{INFO_SNIPPETS}>"


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def data_lines(body: Column) -> Column:
    """``data:`` payloads of an event stream, lines trimmed, blanks dropped."""
    lines = F.transform(_lines(body), lambda l: go_trim(l))
    data = F.transform(F.filter(lines, lambda l: l.startswith("data:")), lambda l: go_trim(F.substring(l, 6, 1 << 30)))
    return F.filter(data, lambda d: d != "")


def last_data(body: Column) -> Column:
    """A5 last-wins: the last non-empty ``data:`` payload."""
    return F.try_element_at(data_lines(body), F.lit(-1))


def _label(lines: Column, label: str) -> Column:
    vals = F.transform(F.filter(lines, lambda l: l.startswith(label)),
                       lambda l: go_trim(F.substring(l, len(label) + 1, 1 << 30)))
    return F.coalesce(F.try_element_at(vals, F.lit(-1)), F.lit(""))   # the last label wins


def text_block_results(texts: Column) -> Column:
    """A6 on an array of text contents: blocks split on a ``---`` line;
    ``Title:``/``URL:`` labels; other labels dropped; the remaining lines
    are the content and the first is the description. Blocks without a
    title or URL are dropped. ``ARRAY<STRUCT<title,url,description,content>>``
    in payload order."""
    blocks = F.flatten(F.transform(texts, lambda t: F.split(t, BLOCK_SEPARATOR)))

    def one(b):
        lines = F.transform(_lines(b), lambda l: go_trim(l))
        content = F.filter(lines, lambda l: (l != "") & ~F.exists(F.array(*[F.lit(p) for p in BLOCK_LABELS]),
                                                                    lambda p: l.startswith(p)))
        return F.struct(_label(lines, "Title:").alias("title"), _label(lines, "URL:").alias("url"),
                        F.coalesce(F.get(content, 0), F.lit("")).alias("description"),
                        F.array_join(content, "\n").alias("content"))
    parsed = F.transform(blocks, one)
    return F.filter(parsed, lambda r: (r["title"] != "") & (r["url"] != ""))


def text_blocks_payload(lists: DataFrame) -> DataFrame:
    """Inverse of ``exa_results`` (fixture builder): one event-stream payload
    per query from its ranked rows (``Title:``/``URL:`` + description)."""
    g = lists.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "url", "description"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(
        F.lit("Title: "), x["title"], F.lit("\nURL: "), x["url"], F.lit("\n"), x["description"])), BLOCK_SEPARATOR)
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
                                          .alias("content")).alias("result")))
    return g.select("query_id", F.concat(F.lit("event: message\ndata: "), payload, F.lit("\n")).alias("body"))


def exa_results(raw: DataFrame, limit: int) -> DataFrame:
    """A5 + A6: ``query_id, body`` (event stream) → ranked rows. The payload
    is the last data line; only ``text`` contents are read; cut to limit."""
    payload = F.from_json(last_data(F.col("body")), TEXT_CONTENT)
    texts = F.transform(F.filter(payload["result"]["content"], lambda c: c["type"] == "text"), lambda c: c["text"])
    res = text_block_results(texts)
    if limit > 0:
        res = F.slice(res, 1, limit)
    ex = raw.select("query_id", F.posexplode(res).alias("pos", "r"))
    return ex.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "r.title", "r.url",
                     "r.description", "r.content")


def first_rpc_payload(body: Column) -> Column:
    """A5 first-wins: the first data line that decodes and carries a result
    or an error."""
    msgs = F.transform(data_lines(body), lambda d: F.from_json(d, RPC_MESSAGE))
    return F.get(F.filter(msgs, lambda m: m["result"].isNotNull() | m["error"].isNotNull()), 0)


def grep_block_results(raw: DataFrame, term: str, limit: int, lang: str | None = None) -> DataFrame:
    """A8 (text blocks): per repository block the ``Repository:``, ``Path:``
    and ``URL:`` headers (last occurrence wins), the first snippet's start
    line from ``--- Snippet N (Line L) ---`` and its best line (I11).
    Blocks without repository or URL are dropped. An error payload yields
    one row with ``error`` set."""
    msg = first_rpc_payload(F.col("body"))
    texts = F.filter(F.transform(F.filter(msg["result"]["content"], lambda c: c["type"] == "text"),
                                 lambda c: c["text"]), lambda t: F.coalesce(t, F.lit("")) != "")

    def one(t):
        lines = _lines(t)
        stop = F.array_position(F.transform(lines, lambda l: l.startswith(SNIPPET_HEADER)), True)
        header = F.when(stop > 0, F.get(lines, (stop - 1).cast("int")))
        start = F.coalesce(F.try_to_number(F.regexp_extract(header, r"\(Line\s*([0-9]+)\s*\)", 1), F.lit("9999999999"))
                           .cast("int"), F.lit(0))
        code = F.when(stop > 0, F.array_join(F.slice(lines, (stop + 1).cast("int"),
                                                     F.greatest(F.size(lines) - stop, F.lit(0))), "\n"))
        bl = best_line(code, start, term)

        def hdr(label):
            vals = F.transform(F.filter(lines, lambda l: l.startswith(label)),
                               lambda l: go_trim(F.substring(l, len(label) + 1, 1 << 30)))
            return F.coalesce(F.try_element_at(vals, F.lit(-1)), F.lit(""))
        return F.struct(hdr("Repository:").alias("repo"), hdr("Path:").alias("path"), hdr("URL:").alias("url"),
                        F.when(stop > 0, bl["line_no"]).otherwise(F.lit(0)).alias("line_no"),
                        F.when(stop > 0, bl["line"]).otherwise(F.lit("")).alias("snippet"))
    res = F.filter(F.transform(texts, one), lambda r: (r["repo"] != "") & (r["url"] != ""))
    if limit > 0:
        res = F.slice(res, 1, limit)
    err = F.when(msg["error"].isNotNull(), F.concat(F.lit("grep error: "), msg["error"]["message"])) \
        .when(F.coalesce(msg["result"]["isError"], F.lit(False)), F.lit("grep search failed"))
    ok = raw.select("query_id", err.alias("error"), res.alias("res"))
    rows = ok.filter(F.col("error").isNull()).select("query_id", F.posexplode("res").alias("pos", "r")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "r.repo", "r.path", "r.line_no", "r.snippet",
        "r.url", F.lit(lang).cast("string").alias("language"), F.lit(None).cast("string").alias("error"))
    errs = ok.filter(F.col("error").isNotNull()).select(
        "query_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("repo"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line_no"),
        F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("url"),
        F.lit(lang).cast("string").alias("language"), "error")
    return rows.unionByName(errs)


def event_data(body: Column) -> Column:
    """W7 row-wise: ``ARRAY<STRUCT<event, data>>`` — each ``data:`` line
    with the event type carried forward from the last ``event:`` line."""
    init = F.struct(F.lit(None).cast("string").alias("ev"),
                    F.array().cast("array<struct<event:string,data:string>>").alias("out"))

    def step(acc, l):
        return (F.when(l.startswith("event:"),
                       F.struct(go_trim(F.substring(l, 7, 1 << 30)).alias("ev"), acc["out"].alias("out")))
                .when(l.startswith("data:"),
                      F.struct(acc["ev"].alias("ev"),
                               F.concat(acc["out"], F.array(F.struct(acc["ev"].alias("event"),
                                                                     go_trim(F.substring(l, 6, 1 << 30)).alias("data"))))
                               .alias("out")))
                .otherwise(acc))
    return F.aggregate(_lines(body), init, step)["out"]


def sourcegraph_results(raw: DataFrame, limit: int, base_url: str = SOURCEGRAPH_URL) -> DataFrame:
    """A8 (event stream): ``data:`` lines under ``event: matches`` hold
    match arrays; content matches with a line match become rows (first line
    match), URL built from repository, path and line."""
    frames = F.filter(event_data(F.col("body")), lambda e: e["event"] == "matches")
    matches = F.flatten(F.transform(frames, lambda e: F.coalesce(F.from_json(e["data"], SG_MATCHES),
                                                                  F.array().cast(SG_MATCHES))))
    content = F.filter(matches, lambda m: (m["type"] == "content") & (F.size(m["lineMatches"]) > 0))
    if limit > 0:
        content = F.slice(content, 1, limit)
    ex = raw.select("query_id", F.posexplode(content).alias("pos", "m"))
    lm = F.get(F.col("m.lineMatches"), 0)
    return ex.select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("m.repository").alias("repo"),
        F.col("m.path").alias("path"), lm["lineNumber"].alias("line_no"), lm["line"].alias("snippet"),
        F.col("m.language").alias("language"), F.col("m.repoStars").alias("stars"),
        F.format_string("%s/%s/-/blob/%s#L%d", F.lit(base_url), F.col("m.repository"), F.col("m.path"),
                        lm["lineNumber"]).alias("url"), F.lit("sourcegraph").alias("source"))


def github_results(raw: DataFrame, limit: int) -> DataFrame:
    """A8 (code-search JSON): first text match → matched line."""
    items = F.from_json(F.col("body"), GH_SEARCH)["items"]
    if limit > 0:
        items = F.slice(items, 1, limit)
    ex = raw.select("query_id", F.posexplode(items).alias("pos", "it"))
    tm = F.get(F.col("it.text_matches"), 0)
    off = F.get(F.get(tm["matches"], 0)["indices"], 0)
    snippet = F.when(tm.isNotNull(), matched_line(tm["fragment"], off)).otherwise(F.lit(""))
    return ex.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"),
                     F.col("it.repository.full_name").alias("repo"), F.col("it.path").alias("path"),
                     snippet.alias("snippet"), F.col("it.html_url").alias("url"),
                     F.col("it.repository.node_id").alias("node_id"), F.lit("github").alias("source"))


def docs_results(raw: DataFrame, library_col: str = "library") -> DataFrame:
    """A9 + H3: code snippets first (snippet = first code entry), then info
    snippets (breadcrumb is also the title); order kept."""
    d = F.from_json(F.col("body"), DOCS)
    code = F.transform(F.coalesce(d["codeSnippets"], F.array().cast(CODE_SNIPPETS)),
                       lambda c: F.struct(c["codeTitle"].alias("title"), F.lit(None).cast("string").alias("breadcrumb"),
                                          F.coalesce(F.get(c["codeList"], 0)["code"], F.lit("")).alias("snippet"),
                                          c["codeId"].alias("url")))
    info = F.transform(F.coalesce(d["infoSnippets"], F.array().cast(INFO_SNIPPETS)),
                       lambda i: F.struct(i["breadcrumb"].alias("title"), i["breadcrumb"].alias("breadcrumb"),
                                          i["content"].alias("snippet"), i["pageId"].alias("url")))
    ex = raw.select(F.col(library_col).alias("library"), F.posexplode(F.concat(code, info)).alias("pos", "r"))
    return ex.select("library", F.col("pos").cast("int").alias("pos"), "r.title", "r.breadcrumb", "r.snippet", "r.url",
                     F.lit("context7").alias("source"))
