"""Node records with sources and relations, focused context, budgeted exploration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import numbered, valid_utf8
from ..schema import CALL_KINDS
from . import search


def snippet(content: Column, start: Column, end: Column, cap: Column) -> tuple[Column, Column]:
    """(text, truncated) of a byte range, of cap bytes at most; null if the range is empty,
    unknown or starts after the end."""
    ok = start.isNotNull() & (end > start) & (cap > 0) & (start < F.octet_length(content))
    size = F.least(end, F.octet_length(content)) - start
    cut = valid_utf8(F.substring(content, start + 1, F.least(size, cap).cast("int")))
    return F.when(ok, cut), F.coalesce(ok & (end - start > cap), F.lit(False))


def related(edges: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """ids with `callers` and `callees`: the first `limit` neighbours in order."""
    calls = edges.filter(F.col("kind").isin(*CALL_KINDS))
    wanted = ids.select("node_id").distinct()
    for name, here, there in (("callers", "target_node_id", "source_node_id"), ("callees", "source_node_id", "target_node_id")):
        near = calls.join(wanted, F.col(here) == F.col("node_id"), "left_semi").select(F.col(here).alias("node_id"), F.col(there).alias("x")).distinct()
        # Only the first `limit` of a node with many neighbours are ever gathered.
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("x"))).filter(F.col("r") <= limit)
        near = near.groupBy("node_id").agg(F.array_sort(F.collect_list("x")).alias(name))
        ids = ids.join(near, "node_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return ids


def node(nodes: DataFrame, edges: DataFrame, contents: DataFrame, ids: DataFrame, related_limit: int = 20, snippet_bytes: int = 4096) -> DataFrame:
    """ids (node_id) with the node's columns, source, numbered lines and relations; nulls
    for unknown ids.  contents: (path, content)."""
    related_limit, snippet_bytes = min(related_limit, 200), min(snippet_bytes, 16_384)
    out = ids.select("node_id").join(nodes, "node_id", "left").join(contents.select("path", "content"), "path", "left")
    text, cut = snippet(F.col("content"), F.col("span.start_byte"), F.col("span.end_byte"), F.lit(snippet_bytes))
    out = out.withColumn("source", text).withColumn("source_truncated", cut).withColumn("start_line", F.col("span.start_row") + 1)
    out = out.withColumn("source_lines", numbered(F.col("source"), F.col("start_line"))).drop("content")
    return related(edges, out, related_limit)


def context(nodes: DataFrame, edges: DataFrame, contents: DataFrame, text: str, mode: str = "contains", kind: str | None = None, path_prefix: str | None = None, limit: int = 20, related_limit: int = 20, snippet_bytes: int = 2048) -> DataFrame:
    """node() of the first `limit` matches of a search, with total_matches (200 at most)."""
    hits = search.search(nodes, text, mode, kind, path_prefix, 200)
    total = hits.count()
    first = hits.orderBy("name", "kind", "node_id").limit(min(limit, 200)).select("node_id")
    return node(nodes, edges, contents, first, related_limit, min(snippet_bytes, 8192)).withColumn("total_matches", F.lit(total).cast("long"))


def budget(rows: DataFrame, total: int, each: int, order: str = "pos", size: str = "size") -> DataFrame:
    """rows with `used`: the bytes each gets of a shared budget, in order.  A row gets
    `each` bytes at most; rows after the budget is spent are dropped, but rows of unknown
    size (null) never spend, and are kept until a known row has spent it.

    The rows are those of one request, so one ordered window is enough.
    """
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wants = F.least(F.coalesce(size, F.lit(0)), F.lit(each))
    rows = rows.withColumn("_prior", F.coalesce(F.sum(wants).over(before), F.lit(0))).withColumn("_known", F.coalesce(F.count(size).over(before), F.lit(0)))
    rows = rows.filter((F.col("_prior") < total) | (F.col("_known") == 0))
    return rows.withColumn("used", F.least(wants, F.greatest(F.lit(0), F.lit(total) - F.col("_prior")))).drop("_prior", "_known")


def explore(nodes: DataFrame, edges: DataFrame, contents: DataFrame, node_ids: Sequence[str], byte_budget: int = 32 * 1024, per_snippet: int = 4096, related_limit: int = 0) -> DataFrame:
    """The nodes in the order given, with sources that share byte_budget."""
    if len(node_ids) > 256:
        raise ValueError("at most 256 node ids")
    byte_budget, per_snippet = min(byte_budget, 128 * 1024), min(per_snippet, 16 * 1024)
    ids = edges.sparkSession.createDataFrame(list(enumerate(node_ids)), "pos int, node_id string")
    rows = ids.join(nodes, "node_id", "left").join(contents.select("path", "content"), "path", "left")
    end = F.least(F.col("span.end_byte"), F.octet_length("content"))
    rows = rows.withColumn("size", F.when(F.col("name").isNotNull(), F.greatest(F.lit(0), F.coalesce(end - F.col("span.start_byte"), F.lit(0)))))
    rows = budget(rows, byte_budget, per_snippet)
    text, cut = snippet(F.col("content"), F.col("span.start_byte"), F.col("span.end_byte"), F.col("used"))
    rows = rows.withColumn("source", text).withColumn("source_truncated", cut).withColumn("known", F.col("name").isNotNull()).drop("content")
    rows = rows.withColumn("bytes_used", F.sum("used").over(Window.partitionBy())).withColumn("bytes_budget", F.lit(byte_budget))
    return related(edges, rows, min(related_limit, 50)).orderBy("pos")
