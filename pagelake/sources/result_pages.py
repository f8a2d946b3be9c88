"""HTML search-result pages → ranked rows (A7), on the node table.

Each ``.result`` block takes the text of its ``.result__title .result__a``
anchors (the first anchor's ``href``, redirect-unwrapped with I10) and of
its ``.result__snippet`` elements; blocks without title or link are
skipped, then the page is cut to ``limit``. The three selectors are matched in one
pass; anchors and snippets meet the blocks of their page by id ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import go_trim, unwrap_redirect
from ..operators.nodes import select_many

BLOCK_SELECTOR = ".result"
TITLE_SELECTOR = ".result__title .result__a"
SNIPPET_SELECTOR = ".result__snippet"
REDIRECT_PARAM = "uddg"


def result_page_rows(nodes: DataFrame, limit: int = 0) -> DataFrame:
    """``page_id, rank, title, url, description``."""
    hits = select_many(nodes, {"block": BLOCK_SELECTOR, "title": TITLE_SELECTOR, "snippet": SNIPPET_SELECTOR})
    blocks = hits.where("selector = 'block'").select("page_id", F.col("node_id").alias("block_id"), F.col("end_id").alias("_end"))
    inside = hits.where("selector <> 'block'").select("page_id", "selector", "node_id", "text", F.col("attrs").getItem("href").alias("href"))
    inside = inside.join(blocks, "page_id").where((F.col("node_id") > F.col("block_id")) & (F.col("node_id") <= F.col("_end")))

    def texts(selector: str):
        run = F.when(F.col("selector") == selector, F.struct("node_id", "text"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(run)), lambda x: x["text"]), "")

    found = inside.groupBy("page_id", "block_id").agg(
        texts("title").alias("title"), texts("snippet").alias("snippet"),
        F.min_by("href", F.when(F.col("selector") == "title", F.col("node_id"))).alias("href"))
    b = (blocks.join(found, ["page_id", "block_id"], "left")
         .select("page_id", "block_id", go_trim(F.coalesce("title", F.lit(""))).alias("title"),
                 F.coalesce("href", F.lit("")).alias("href"),
                 go_trim(F.coalesce("snippet", F.lit(""))).alias("description"))
         .filter((F.col("title") != "") & (F.col("href") != "")))
    w = Window.partitionBy("page_id").orderBy("block_id")
    ranked = b.withColumn("rank", F.row_number().over(w).cast("int"))
    if limit > 0:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.select("page_id", "rank", "title", unwrap_redirect(F.col("href"), REDIRECT_PARAM).alias("url"),
                         "description")
