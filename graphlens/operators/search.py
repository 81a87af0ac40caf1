"""Symbol search, file listings, members and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import CALL_KINDS

SEARCH_LIMIT, SEARCH_MAX = 64, 1024
MODES = ("exact", "prefix", "contains")
#: Kinds that have members, and what separates a member's name.
OWNER_KINDS = ("class", "interface", "trait", "enum", "component")
MEMBER_SEPARATOR = "::"


def symbol_keys(nodes: DataFrame) -> DataFrame:
    """(key, node columns): a node is found under its name and under its qualified name."""
    keys = F.array_distinct(F.array("name", "qname"))
    return nodes.withColumn("key", F.explode(F.filter(keys, lambda k: k.isNotNull())))


def find_symbol(nodes: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Nodes whose name or qualified name is `name`."""
    hit = (F.col("name") == name) | (F.col("qname") == name)
    out = nodes.filter(hit if kind is None else hit & (F.col("kind") == kind))
    return out.select("node_id", "name", "kind", "qname", "path").dropDuplicates(["node_id"])


def search(nodes: DataFrame, text: str, mode: str = "contains", kind: str | None = None, path_prefix: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Nodes whose name or qualified name matches; case counts and no sign is special.
    The first `limit` in the order of name, kind and node_id."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "exact":
        match = lambda c: F.col(c) == text
    elif mode == "prefix":
        match = lambda c: F.startswith(F.col(c), F.lit(text))
    else:
        match = lambda c: F.contains(F.col(c), F.lit(text))
    out = nodes.filter(match("name") | match("qname"))
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if path_prefix:
        out = out.filter(F.startswith("path", F.lit(path_prefix)))
    out = out.select("node_id", "name", "kind", "qname", "path").dropDuplicates(["node_id"])
    return out.orderBy("name", "kind", "node_id").limit(max(0, min(limit, SEARCH_MAX)))


def trigrams(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, trigram): the distinct windows of three signs of each name, lower-cased."""
    name = F.lower(F.col(column))
    windows = F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substring(name, i, F.lit(3)))
    grams = F.when(F.length(name) >= 3, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))
    return names.select(F.col(column).alias("name")).distinct().select("name", F.explode(grams).alias("trigram"))


def candidates(index: DataFrame, needle: str) -> DataFrame:
    """(name): names that have all trigrams of the needle, verified to contain it."""
    low = needle.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return index.select("name").distinct().filter(F.contains("name", F.lit(needle)))
    hits = index.filter(F.col("trigram").isin(grams)).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return hits.filter(F.contains("name", F.lit(needle))).select("name")


def files(nodes: DataFrame, prefix: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    """(path, total): paths that have nodes, sorted; at most 10 000 of them."""
    paths = nodes.select("path").distinct()
    if prefix:
        paths = paths.filter(F.startswith("path", F.lit(prefix)))
    total = paths.count()
    return paths.orderBy("path").offset(min(max(offset, 0), total)).limit(min(10_000, total if limit is None else limit)).withColumn("total", F.lit(total).cast("long"))


def nodes_in_file(nodes: DataFrame, path: str) -> DataFrame:
    order = "local_node_id" if "local_node_id" in nodes.columns else "node_id"
    return nodes.filter(F.col("path") == path).orderBy(order).select("node_id", "kind", "name", "qname")


def kind_counts(nodes: DataFrame, path: str | None = None) -> DataFrame:
    return (nodes if path is None else nodes.filter(F.col("path") == path)).groupBy("path", "kind").agg(F.count("*").alias("n"))


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(files, nodes, symbols, call_edges): a file has a node; a symbol is a distinct name
    or qualified name with its kind; call edges are distinct pairs."""
    calls = edges.filter(F.col("kind").isin(*CALL_KINDS)).select("source_node_id", "target_node_id").distinct()
    counts = [("files", nodes.select("path").distinct()), ("nodes", nodes.select("node_id").distinct()), ("symbols", symbol_keys(nodes).select("key", "kind").distinct()), ("call_edges", calls)]
    names = [name for name, _ in counts]
    rows = [df.agg(F.count("*").alias("n")).select(*(F.col("n").alias(x) if x == name else F.lit(None).cast("long").alias(x) for x in names)) for name, df in counts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.agg(*(F.max(x).alias(x) for x in names))


def members(nodes: DataFrame) -> DataFrame:
    """(owner_id, member_id): nodes of the same file whose qualified name goes on from the
    owner's.  The owner part of a member's name is cut off, so this is an equi-join."""
    owner = nodes.filter(F.col("kind").isin(*OWNER_KINDS)).select(F.col("node_id").alias("owner_id"), F.col("path").alias("op"), F.col("qname").alias("oq"))
    parts = F.split(F.col("qname"), MEMBER_SEPARATOR)
    # Every prefix that ends before a separator may be an owner's name.
    heads = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), MEMBER_SEPARATOR)))
    member = nodes.select(F.col("node_id").alias("member_id"), F.col("path").alias("mp"), F.explode(heads).alias("head"))
    return owner.join(member, (F.col("op") == F.col("mp")) & (F.col("oq") == F.col("head"))).filter("owner_id != member_id").select("owner_id", "member_id").distinct()


def member_calls(nodes: DataFrame, edges: DataFrame, node_id: str, backward: bool) -> DataFrame:
    """(node_id): callers (backward) or callees of a node's members, without the members."""
    own = members(nodes).filter(F.col("owner_id") == node_id).select("member_id")
    here, there = ("target_node_id", "source_node_id") if backward else ("source_node_id", "target_node_id")
    calls = edges.filter(F.col("kind").isin(*CALL_KINDS))
    out = calls.join(own, F.col(here) == F.col("member_id"), "left_semi").select(F.col(there).alias("node_id")).distinct()
    return out.join(own, F.col("node_id") == F.col("member_id"), "left_anti")
