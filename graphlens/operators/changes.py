"""Batches of changes: latest versions, debounced sessions, manifests, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: str, version: Column | str, arrival: Column | str | None = None) -> DataFrame:
    """One row a key: that of the highest version, of several the first to arrive."""
    version = F.col(version) if isinstance(version, str) else version
    order = [version.desc()] + ([] if arrival is None else [F.col(arrival).asc() if isinstance(arrival, str) else arrival.asc()])
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def manifest_diff(scanned: DataFrame, active: DataFrame) -> DataFrame:
    """(path, state) of paths that are dirty (hash or size differ, or an old generation),
    missing from active, or deleted; a changed mtime alone is no change."""
    newest = active.agg(F.max("generation")).first()[0]
    a = active.select(F.col("path").alias("ap"), F.col("content_hash").alias("ah"), F.col("size").alias("asize"), "generation")
    rows = scanned.select("path", "content_hash", "size").join(a, F.col("path") == F.col("ap"), "full_outer")
    dirty = ~F.col("content_hash").eqNullSafe(F.col("ah")) | ~F.col("size").eqNullSafe(F.col("asize")) | (F.col("generation") < F.lit(newest))
    state = F.when(F.col("ap").isNull(), "missing").when(F.col("path").isNull(), "deleted").when(dirty, "dirty")
    return rows.select(F.coalesce("path", "ap").alias("path"), state.alias("state")).filter("state is not null")


def replaced(table: DataFrame, paths: DataFrame, new: DataFrame, column: str = "path") -> DataFrame:
    """table without the rows of the paths, and with the new rows."""
    gone = paths.select(F.col(column).alias("_p")).distinct()
    return table.join(gone, F.col(column) == F.col("_p"), "left_anti").unionByName(new)


def unchanged_skipped(scanned: DataFrame, active: DataFrame) -> DataFrame:
    """scanned rows whose path is not active with the same hash."""
    known = active.select(F.col("path").alias("_p"), F.col("content_hash").alias("_h"))
    return scanned.join(known, (F.col("path") == F.col("_p")) & (F.col("content_hash") == F.col("_h")), "left_anti")


def sessions(events: DataFrame, gap: str, key: str = "path") -> DataFrame:
    """(start, end, key, kind): events in sessions that end `gap` after the last event of
    any key; the last event of each key in a session counts."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), F.lit(0).alias("all")).agg(F.collect_list(F.struct(key, "kind", "ts", "seq")).alias("rows"))
    rows = grouped.select("w", F.explode("rows").alias("r")).select("w", "r.*")
    last = rows.groupBy("w", key).agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"))
    return last.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "kind")


def debounced(events: DataFrame, gap_seconds: float, key: str = "path") -> DataFrame:
    """As sessions(), for a stored table: the gaps are found over equal time ranges, so
    that no task sorts all events.

    Sessions are global, so an event starts one if the latest event before it, of any key,
    is more than a gap away.  Events are dealt to ranges of time; the last event of each
    earlier range comes from a table with one row per range.
    """
    span = F.lit(max(gap_seconds * 64, 3600.0))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    rows = events.withColumn("_at", at).withColumn("_range", F.floor(F.col("_at") / span).cast("long"))
    ranges = rows.groupBy("_range").agg(F.max("_at").alias("_last"))
    ranges = ranges.select("_range", F.max("_last").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = rows.join(ranges, "_range")
    inside = Window.partitionBy("_range").orderBy("_at", "seq")
    before = F.coalesce(F.lag("_at").over(inside), F.col("_before"))
    rows = rows.withColumn("_new", (before.isNull() | (F.col("_at") - before > gap_seconds)).cast("int"))
    starts = rows.groupBy("_range").agg(F.sum("_new").alias("_n"))
    starts = starts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_k", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(starts, F.col("_range") == F.col("_r"))
    rows = rows.withColumn("session", F.col("_base") + F.col("_k"))
    return rows.groupBy("session", key).agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"), F.count("*").alias("events"))


def batches(last: DataFrame, by: list[str]) -> DataFrame:
    """Sorted lists of created, modified and deleted paths of each batch, and whether a
    file with ignore rules is among them."""
    pick = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("path")))).alias(k)
    rules = F.bool_or(F.col("path").rlike(r"(^|/)\.(gitignore|graphlensignore)$|(^|/)info/exclude$")).alias("ignore_file_changed")
    return last.groupBy(*by).agg(pick("created"), pick("modified"), pick("deleted"), rules)


def enclosing(points: DataFrame, containers: DataFrame, by: str = "path") -> DataFrame:
    """(by, point_id, container_id): the smallest container that strictly holds each point's
    range, of equal ones the first; null without one.

    Both sides are dealt to blocks of places: a container stands in each block it touches
    only if it is short, and in one block of a coarser level otherwise, so a long container
    is not copied along the file.
    """
    # A range of length n lies within two neighbouring blocks of the level 2**k >= n.
    size = F.greatest(F.col("c_end") - F.col("c_start"), F.lit(1))
    level = F.ceil(F.log2(size.cast("double"))).cast("int")
    block = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("long")
    c = containers.select(F.col(by).alias("c_by"), "container_id", "c_start", "c_end", "c_order", level.alias("level"))
    c = c.withColumn("block", F.explode(F.sequence(block(F.col("c_start"), F.col("level")), block(F.col("c_end"), F.col("level")))))
    levels = sorted(r.level for r in c.select("level").distinct().collect() if r.level is not None)  # at most 63
    p = points.select(by, "point_id", "p_start", "p_end", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    p = p.withColumn("block", block(F.col("p_start"), F.col("level")))
    hit = p.alias("p").join(c.alias("c"), (F.col(f"p.{by}") == F.col("c.c_by")) & (F.col("p.level") == F.col("c.level")) & (F.col("p.block") == F.col("c.block")))
    inside = (F.col("c_start") <= F.col("p_start")) & (F.col("c_end") >= F.col("p_end")) & ((F.col("c_start") < F.col("p_start")) | (F.col("c_end") > F.col("p_end")))
    best = hit.filter(inside).groupBy(f"p.{by}", "point_id").agg(F.min_by("container_id", F.struct(F.col("c_end") - F.col("c_start"), F.col("c_order"))).alias("container_id"))
    return points.select(by, "point_id").join(best, [by, "point_id"], "left")


def scopes(declarations: DataFrame, by: str = "path", start: str = "start") -> DataFrame:
    """declarations with `scope_end`: each reaches to the next one's start in its file."""
    return declarations.withColumn("scope_end", F.lead(start).over(Window.partitionBy(by).orderBy(start)))
