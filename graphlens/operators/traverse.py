"""Recursive operators: closures, shortest paths, cycles.

Each is a frontier loop: one round is one join of the frontier with the edges, its
result is written to the shared folder, and the rounds end when nothing new is found.
The edges are filtered by kind before the loop.  A frontier is broadcast only while it
is small: it is read from the files of the last round, whose size is known.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import runtime
from ..schema import CALL_KINDS, CONE_KINDS, IMPACT_KINDS

#: After so many rounds the rows found so far are written as one table.
COMPACT = 8


def _steps(edges: DataFrame, kinds: Sequence[str] | None, backward: bool) -> DataFrame:
    """(here, there) for each step along the edges."""
    here, there = ("target_node_id", "source_node_id") if backward else ("source_node_id", "target_node_id")
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(*kinds))
    return edges.select(F.col(here).alias("here"), F.col(there).alias("there")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, kinds: Sequence[str] | None = None, backward: bool = False, max_depth: int | None = None) -> DataFrame:
    """(node_id, depth): nodes reached from the seeds (node_id) in one step or more, with
    the least number of steps.  A seed is among them only if it lies on a cycle."""
    steps = runtime.written(_steps(edges, kinds, backward), "steps")
    frontier = seeds.select("node_id").distinct()
    found: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        # The frontier was written, so its size is known and a small one is broadcast.
        new = steps.join(frontier, F.col("here") == F.col("node_id")).select(F.col("there").alias("node_id")).distinct()
        if found:
            new = new.join(reduce(DataFrame.unionByName, found).select("node_id"), "node_id", "left_anti")
        new = runtime.written(new.withColumn("depth", F.lit(depth)), f"round{depth}")
        if new.isEmpty():
            break
        found.append(new)
        if len(found) > COMPACT:
            found = [runtime.written(reduce(DataFrame.unionByName, found), "found")]
        frontier = new.select("node_id")
    if not found:
        return seeds.select("node_id", F.lit(0).alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, found)


def seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def impact(edges: DataFrame, node_id: str, max_depth: int = 0) -> DataFrame:
    """What a change of node_id may affect: the backward closure over IMPACT_KINDS; depth 0
    is without bound."""
    return reach(edges, seed(edges.sparkSession, node_id), IMPACT_KINDS, backward=True, max_depth=max_depth or None)


def forward_impact(edges: DataFrame, node_id: str, max_depth: int | None = None) -> DataFrame:
    """What node_id reaches over edges of any kind; depth 0 is nothing."""
    return reach(edges, seed(edges.sparkSession, node_id), None, max_depth=max_depth)


def dependency_cone(edges: DataFrame, node_id: str) -> DataFrame:
    """What depends on node_id by calls, rendering or type relations."""
    return reach(edges, seed(edges.sparkSession, node_id), CONE_KINDS, backward=True)


def changes_if(edges: DataFrame, node_id: str) -> DataFrame:
    return reach(edges, seed(edges.sparkSession, node_id), IMPACT_KINDS, backward=True)


def shortest_path(edges: DataFrame, start: str, end: str, kinds: Sequence[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(path, length): the shortest path, of several the one that is first in the order of
    its node ids; no row if there is none within max_depth."""
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([([start], 0)], "path array<string>, length int")
    steps = runtime.written(_steps(edges, kinds, False), "steps")
    frontier = spark.createDataFrame([(start, [start])], "node_id string, path array<string>")
    found = [frontier.select("node_id")]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = steps.join(frontier, F.col("here") == F.col("node_id")).groupBy("there").agg(F.min("path").alias("path"))
        new = new.select(F.col("there").alias("node_id"), F.concat("path", F.array("there")).alias("path"))
        new = runtime.written(new.join(reduce(DataFrame.unionByName, found), "node_id", "left_anti"), f"path{depth}")
        hit = new.filter(F.col("node_id") == end)
        if not hit.isEmpty():
            return hit.select("path", F.lit(depth).alias("length"))
        if new.isEmpty():
            break
        found.append(new.select("node_id"))
        if len(found) > COMPACT:
            found = [runtime.written(reduce(DataFrame.unionByName, found), "found")]
        frontier = new
    return spark.createDataFrame([], "path array<string>, length int")


def trace(edges: DataFrame, start: str, end: str, max_depth: int = 12) -> DataFrame:
    """The shortest chain of calls and renderings, of at most max_depth (64 at most) steps."""
    return shortest_path(edges, start, end, CALL_KINDS, min(max_depth, 64))


def neighbours(edges: DataFrame, node_id: str, backward: bool) -> DataFrame:
    """(node_id): callers (backward) or callees, distinct."""
    here, there = ("target_node_id", "source_node_id") if backward else ("source_node_id", "target_node_id")
    return edges.filter(F.col("kind").isin(*CALL_KINDS) & (F.col(here) == node_id)).select(F.col(there).alias("node_id")).distinct()


def cycles(edges: DataFrame, kinds: Sequence[str] = ("calls",)) -> DataFrame:
    """(component, node_id): strongly connected components with more than one node, and
    nodes that call themselves; a component is named by its smallest node.

    Nodes that cannot lie on a cycle are trimmed; then each round colours every node with
    the smallest node that reaches it, and the nodes of a colour that reach the colour's
    node back are a component, which is emitted and removed.
    """
    edges = edges.filter(F.col("kind").isin(*kinds)).select(F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t")).distinct()
    loops = edges.filter("s = t").select(F.col("s").alias("component"), F.col("s").alias("node_id"))
    edges = runtime.written(edges.filter("s != t"), "arcs")
    done: list[DataFrame] = []
    n = edges.count()
    while n:
        # Trim: an edge stays while its source is called and its target calls.
        while True:
            kept = edges.join(edges.select(F.col("t").alias("x")).distinct(), F.col("s") == F.col("x"), "left_semi")
            kept = runtime.written(kept.join(edges.select(F.col("s").alias("x")).distinct(), F.col("t") == F.col("x"), "left_semi"), "trimmed")
            m = kept.count()
            edges = kept
            if m == n:
                break
            n = m
        if not n:
            break
        colour = runtime.written(edges.select(F.col("s").alias("x")).union(edges.select("t")).distinct().withColumn("c", F.col("x")), "colour")
        while True:
            low = edges.join(colour, F.col("s") == F.col("x")).groupBy("t").agg(F.min("c").alias("low"))
            new = colour.join(low, F.col("x") == F.col("t"), "left").select("x", F.least("c", F.coalesce("low", "c")).alias("c"), (F.col("low") < F.col("c")).alias("moved"))
            new = runtime.written(new, "colour")
            colour = new.select("x", "c")
            if new.filter("moved").isEmpty():
                break
        inner = edges.join(colour.select(F.col("x").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("x").alias("t"), F.col("c").alias("ct")), "t").filter("cs = ct")
        inner = runtime.written(inner.select("s", "t", F.col("cs").alias("c")), "inner")
        part = runtime.written(colour.filter("x = c"), "roots")
        frontier = part
        while True:
            back = inner.join(frontier.select(F.col("x").alias("t"), F.col("c").alias("k")), "t").filter("c = k").select(F.col("s").alias("x"), "c").distinct()
            back = runtime.written(back.join(part, ["x", "c"], "left_anti"), "back")
            if back.isEmpty():
                break
            part = runtime.written(part.unionByName(back), "part")
            frontier = back
        done.append(part.select(F.col("c").alias("component"), F.col("x").alias("node_id")))
        gone = part.select(F.col("x").alias("g"))
        edges = edges.join(gone, F.col("s") == F.col("g"), "left_anti").join(gone, F.col("t") == F.col("g"), "left_anti")
        edges = runtime.written(edges, "rest")
        n = edges.count()
    several = reduce(DataFrame.unionByName, done) if done else loops.limit(0)
    several = several.withColumn("n", F.count("*").over(Window.partitionBy("component"))).filter("n > 1").drop("n")
    return several.unionByName(loops.join(several, "node_id", "left_anti").select("component", "node_id"))


def module_boundary(edges: DataFrame, nodes: DataFrame, source: str = "", target: str = "") -> DataFrame:
    """Edges between nodes of different files whose paths contain the given texts."""
    a = nodes.select(F.col("node_id").alias("source_node_id"), F.col("path").alias("source_path"))
    b = nodes.select(F.col("node_id").alias("target_node_id"), F.col("path").alias("target_path"))
    a = a.filter(F.contains("source_path", F.lit(source))) if source else a
    b = b.filter(F.contains("target_path", F.lit(target))) if target else b
    out = edges.join(a, "source_node_id").join(b, "target_node_id").filter("source_path != target_path")
    return out.select("source_path", "target_path", "kind", "source_node_id", "target_node_id")


def with_summary(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids with name, kind, qname and path; nulls for ids without a node."""
    return ids.join(nodes.select("node_id", "name", "kind", "qname", "path"), "node_id", "left")


def page(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """rows of one page in order, with total and truncated."""
    total = rows.count()
    offset = min(max(offset, 0), total)
    out = rows.orderBy(*order).offset(offset).limit(max(limit, 0))
    return out.withColumn("total", F.lit(total).cast("long")).withColumn("truncated", F.lit(offset + limit < total))
