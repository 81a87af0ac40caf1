"""Building and updating the graph of a source tree.

References are stored as extracted, so that every update resolves all of them again
over the stored facts: an incremental update gives what a rebuild would give, and only
changed files are parsed.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import extract, runtime, schema
from .operators import changes, framework, resolve
from .sources import scan as scanning
from .store import Store


def graph(facts: DataFrame, project: resolve.Project) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted facts: definitions; resolved references and framework
    edges without repeats."""
    nodes, refs = extract.nodes(facts), extract.refs(facts)
    symbols = resolve.symbol_table(nodes)
    resolved = resolve.edges(resolve.rewritten(refs, project), symbols)
    php = extract.calls(facts.filter("language = 'php'"))
    edges = resolve.merged(resolved, framework.laravel(php), framework.blade(refs), framework.react(nodes, refs))
    return nodes, edges


def _update(spark: SparkSession, root: str, store: Store, fresh: bool, only: list[str] | None = None) -> dict:
    """One update: parse what changed, resolve everything, publish a snapshot."""
    took: dict[str, int] = {}
    clock = time.perf_counter()

    def lap(name: str) -> None:
        nonlocal clock
        now = time.perf_counter()
        took[name], clock = int((now - clock) * 1e6), now

    listed = runtime.written(scanning.listing(spark, root), "listed")
    scanned = runtime.written(scanning.scan(spark, root, listed=listed), "scanned")
    n_scanned = scanned.count()
    lap("scan_us")
    active = spark.createDataFrame([], schema.ACTIVE_FILE) if fresh else store.read("active_file")
    old = spark.createDataFrame([], schema.EXTRACTED) if fresh else store.read("facts")
    newest = active.agg(F.max("generation")).first()[0]
    generation = 1 if newest is None else newest + 1
    known = active.filter("not deleted")
    changed = changes.unchanged_skipped(scanned, known)
    if only is not None:
        changed = changed.filter(F.col("path").isin(only))
    parsed = runtime.written(extract.extracted(changed), "parsed")
    n_parsed = parsed.count()
    lap("parse_us")
    here = scanned.select("path")
    gone = known.join(here, "path", "left_anti").select("path")
    touched = parsed.select("path").union(gone)
    facts = runtime.written(changes.replaced(old, touched, parsed), "facts")
    nodes, edges = graph(facts, scanning.project(spark, root, listed))
    nodes, edges = runtime.written(nodes, "nodes"), runtime.written(edges, "edges")
    lap("resolve_us")
    now = changed.select("path", "content_hash", "mtime", "size", F.lit(generation).cast("long").alias("generation"), F.lit(False).alias("deleted"))
    dead = active.join(gone, "path", "left_semi").withColumn("generation", F.lit(generation).cast("long")).withColumn("deleted", F.lit(True)).select(*now.columns)
    files = changes.replaced(active.select(*now.columns), touched, now.unionByName(dead))
    store.write(facts=facts, active_file=files, active_node=nodes, edge=edges)
    lap("store_us")
    return {"files_scanned": n_scanned, "files_indexed": n_parsed, "nodes_created": parsed.select(F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()[0], "edges_created": edges.count(), **took}


def sync(spark: SparkSession, root: str, store: Store) -> dict:
    """Brings the store up to the tree: new and changed files are parsed, gone ones dropped."""
    return _update(spark, root, store, fresh=False)


def reindex(spark: SparkSession, root: str, store: Store) -> dict:
    """Builds the store anew; readers keep the old snapshot until the new one is whole."""
    return _update(spark, root, store, fresh=True)


def apply_changes(spark: SparkSession, root: str, store: Store, paths: list[str]) -> dict:
    """Takes the changes of these paths only; paths that are gone are dropped."""
    return _update(spark, root, store, fresh=False, only=paths)
