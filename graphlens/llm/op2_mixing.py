"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a seeded digest) and repeated MAX_REPEAT times
as a queue; a document's virtual finish time is its source's cumulative words divided by
the source's target.  All queues' documents are range-sorted by finish time and served
until the running total of words reaches the budget, the words of all documents; the
document being served then is cut there.  Nothing else ends a queue: a source comes to
its target, but for the document that it would serve next, because all finish times pass
1 together.

Defined results: null text has size 0; null source is a source of its own, ordered
last; null doc_id and repeated rows are rows like others; a source of size 0 has target
0; documents of size 0 are not served; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import common as C

SEED = "mix-1:"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SIZE_RE = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, source, size, digest), written once; rid is unique."""
    size = F.coalesce(F.regexp_count("text", F.lit(SIZE_RE)).cast("long"), F.lit(0).cast("long"))
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", size.alias("size"), digest.alias("digest"), F.monotonically_increasing_id().alias("rid"))
    return C.materialize(rows, "sized")


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target): the total shared by weight, each source's share
    stopped at MAX_REPEAT times its size and the excess shared again.  One row a source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    ratio = MAX_REPEAT * F.col("source_size") / F.col("w")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sources = sources.withColumn("ratio", ratio)
    capped = F.coalesce(F.sum(MAX_REPEAT * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.sum("source_size").over(everything) - capped) / weight)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    sources = sources.withColumn("line", level)
    return sources.select("source", "source_size", F.when(F.col("ratio") <= F.col("line"), (MAX_REPEAT * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.col("line")).alias("target"))


def mix(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """The operator: (rid, copy, finish, offset, words) of every document of every queue,
    in the order of `offset`, the words served before it.  rows as of sized(), goals of
    targets().  Both orders are range sorts in which rid splits equal digests, so that no
    source and no repeated row makes a large task."""
    rows = rows.filter("size > 0")
    queued = C.ranked(rows, [F.col("source").asc_nulls_last(), "digest", "size", "rid"], "queues", size="size")
    # One row a source: where its queue starts among all.
    earlier = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.filter("source_size > 0").select(F.col("source").alias("_g"), "source_size", "target", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)).alias("base"))
    queued = queued.join(C.small(goals), F.col("source").eqNullSafe(F.col("_g")))
    queued = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEAT - 1))))
    tokens = F.col("copy") * F.col("source_size") + F.col("start") - F.col("base") + F.col("size")
    queued = queued.select("rid", "copy", "digest", (tokens / F.col("target")).alias("finish"), F.col("size").alias("words"))
    served = C.ranked(queued, ["finish", "digest", "words", "copy", "rid"], "served", size="words")
    return served.select("rid", "copy", "finish", F.col("start").alias("offset"), "words")


def mixed(docs: DataFrame) -> DataFrame:
    """Per document: (doc_id, size, source_size, target, taken, first_finish)."""
    rows = sized(docs)
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first().words
    goals = C.materialize(targets(rows), "targets")
    kept = F.least(F.col("words"), F.lit(budget) - F.col("offset"))
    taken = mix(rows, goals).withColumn("kept", kept).filter("kept > 0").groupBy("rid").agg(F.sum("kept").alias("taken"), F.min("finish").alias("first_finish"))
    goals = goals.withColumnRenamed("source", "_g")
    out = rows.join(C.small(goals), F.col("source").eqNullSafe(F.col("_g"))).join(taken, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "first_finish")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(C.read(spark, sf_dir, "documents")).drop("first_finish")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), l AS (SELECT arg_min(level, ratio) AS line FROM r WHERE ratio >= level),
g AS (SELECT source, source_size, CASE WHEN ratio <= line THEN CAST(3 * source_size AS DOUBLE) ELSE w * line END AS target FROM r, l),
q AS (
  SELECT rid, d.size, digest, copy, (copy * source_size + sum(d.size) OVER (PARTITION BY d.source, copy ORDER BY digest, d.size, rid ROWS UNBOUNDED PRECEDING)) / target AS finish
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, (SELECT unnest([0, 1, 2]) AS copy) WHERE d.size > 0
), o AS (
  SELECT rid, size, coalesce(sum(size) OVER (ORDER BY finish, digest, size, copy, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q
), k AS (SELECT rid, sum(least(size, (SELECT sum(size) FROM d) - before)) AS taken FROM o WHERE before < (SELECT sum(size) FROM d) GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k USING (rid)
"""
