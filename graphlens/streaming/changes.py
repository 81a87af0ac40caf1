"""Change events as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes as ops

change_schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType())])


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind) of what differs between two listings (path, size, mtime): file streams
    of Spark never tell of deletions, so these come from comparing listings."""
    a = before.select(F.col("path").alias("a_path"), F.col("size").alias("a_size"), F.col("mtime").alias("a_mtime"))
    rows = after.select("path", "size", "mtime").join(a, F.col("path") == F.col("a_path"), "full_outer")
    same = F.col("size").eqNullSafe(F.col("a_size")) & F.col("mtime").eqNullSafe(F.col("a_mtime"))
    kind = F.when(F.col("a_path").isNull(), "created").when(F.col("path").isNull(), "deleted").when(~same, "modified")
    return rows.select(F.coalesce("path", "a_path").alias("path"), kind.alias("kind")).filter("kind is not null")


def debounced_stream(events: DataFrame, gap: str = "100 milliseconds", delay: str = "1 second") -> DataFrame:
    """Batches (start, end, created, modified, deleted, ignore_file_changed) of a stream of
    change events: all paths share one session, which ends `gap` after its last event; the
    last event of a path counts.  Events later than `delay` are dropped, an extension over
    arrival order that makes replays give the same batches."""
    # Streams have no global sessions: the second key is the same for all events.
    events = events.filter("path is not null").withColumn("none", F.col("path") == "")
    sessions = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "none").agg(F.collect_list(F.struct("ts", "seq", "path", "kind")).alias("events"))
    ordered = F.array_sort("events")
    # Later events overwrite earlier ones of their path.
    last = F.map_from_entries(F.transform(F.filter(F.transform(ordered, lambda e, i: F.struct(e["path"].alias("path"), e["kind"].alias("kind"), i.alias("i"))), lambda e: ~F.exists(F.slice(ordered, e["i"] + 2, F.size(ordered)), lambda l: l["path"] == e["path"])), lambda e: F.struct(e["path"], e["kind"])))
    rows = sessions.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), last.alias("last"))
    of = lambda kind: F.array_sort(F.map_keys(F.map_filter("last", lambda k, v: v == kind)))
    rules = F.exists(F.map_keys("last"), lambda p: p.rlike(r"(^|/)\.(gitignore|graphlensignore)$|(^|/)info/exclude$"))
    return rows.select("start", "end", of("created").alias("created"), of("modified").alias("modified"), of("deleted").alias("deleted"), rules.alias("ignore_file_changed"))


def apply_stream(events: DataFrame, apply: Callable[[list[str]], object], checkpoint: str, max_paths: int = 64) -> StreamingQuery:
    """Applies a stream of change events in micro-batches: the paths of each batch, the last
    event of each, go to `apply` in groups of max_paths (null: all, after a change of an
    ignore file).  A batch that was applied before a failure is applied again, which is
    harmless, as updates are by content."""

    def one(batch: DataFrame, batch_id: int) -> None:
        last = ops.latest(batch, "path", F.struct("ts", "seq"))
        # A micro-batch is bounded by the source's rate limit.
        paths = sorted(r.path for r in last.select("path").collect())
        if any(p.rsplit("/", 1)[-1] in (".gitignore", ".graphlensignore") or p.endswith("info/exclude") for p in paths):
            apply(None)
            return
        for i in range(0, len(paths), max_paths):
            apply(paths[i : i + max_paths])

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Resident bytes of the driver's Python above which freshness() warns.
MEMORY_WARNING = 1 << 30


def freshness(query: StreamingQuery | None) -> dict:
    """How far a change stream is behind: catching_up, pending_paths (rows of the last
    batch while it runs), rss_bytes and warnings."""
    import resource

    rss = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
    status = query.status if query is not None and query.isActive else None
    running = bool(status and (status["isTriggerActive"] or status["isDataAvailable"]))
    progress = query.lastProgress if query is not None else None
    pending = int(progress["numInputRows"]) if running and progress else 0
    warnings = [f"resident memory is {rss / 2**20:.0f} MiB"] if rss > MEMORY_WARNING else []
    if query is not None and query.exception() is not None:
        warnings.append(str(query.exception())[:500])
    return {"catching_up": running, "pending_paths": pending, "rss_bytes": rss, "warnings": warnings}
