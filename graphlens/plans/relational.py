"""Batches of changes, ranges and text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as ch, context
from ..sources.tables import changes, read


def _latest(spark, sf):
    return ch.latest(changes(spark, sf), "path", "generation", "seq").select("path", "generation", "kind")


def _writer_dedupe(spark, sf):
    rows = changes(spark, sf).withColumn("generation", F.pmod("seq", F.lit(10)))
    return ch.latest(rows, "path", "generation", "seq").select("path", "generation", F.col("seq").alias("first_seq"))


def _sessions(spark, sf):
    return ch.debounced(changes(spark, sf), 300.0).groupBy("session").agg(F.count("*").alias("paths"), F.sum("events").alias("events"))


def _session_last(spark, sf):
    return ch.debounced(changes(spark, sf), 300.0).select("session", "path", "kind", "events")


def _manifest(spark, sf):
    o = read(spark, sf, "orders")
    path = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    digest = lambda s: F.sha2(s, 256)
    urgent, high, low = (F.col("o_orderpriority") == x for x in ("1-URGENT", "2-HIGH", "5-LOW"))
    scanned = o.filter("o_orderstatus != 'P'").select(path.alias("path"), digest(F.when(urgent, F.lit("changed")).otherwise(F.col("o_orderstatus"))).alias("content_hash"), F.col("o_custkey").alias("size"))
    active = o.filter(~low).select(path.alias("path"), digest(F.col("o_orderstatus")).alias("content_hash"), F.col("o_custkey").alias("size"), F.when(high, 1).otherwise(2).alias("generation"))
    return ch.manifest_diff(scanned, active)


def _replace(spark, sf):
    rows = read(spark, sf, "customer").select(F.concat(F.lit("n/"), F.col("c_nationkey").cast("string")).alias("path"), "c_custkey")
    paths = read(spark, sf, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("path"))
    new = paths.withColumn("c_custkey", F.lit(-1).cast("long"))
    return ch.replaced(rows, paths, new)


def _skip(spark, sf):
    d = read(spark, sf, "documents")
    scanned = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("content_hash"))
    active = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.when(F.expr("lang != 'en'"), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return ch.unchanged_skipped(scanned, active)


def _enclosing(spark, sf):
    e = read(spark, sf, "events")
    by = F.col("user_id").cast("string")
    containers = e.select(by.alias("path"), F.col("event_id").alias("container_id"), F.col("event_id").alias("c_start"), F.expr("event_id + 1 + event_id % 97").alias("c_end"), F.col("event_id").alias("c_order"))
    points = e.select(by.alias("path"), F.col("event_id").alias("point_id"), F.col("event_id").alias("p_start"), F.expr("event_id + 1").alias("p_end"))
    return ch.enclosing(points, containers).withColumn("container_id", F.coalesce("container_id", F.lit(-1).cast("long")))


def _scopes(spark, sf):
    e = read(spark, sf, "events")
    return ch.scopes(e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("start"))).withColumn("scope_end", F.coalesce("scope_end", F.lit(-1).cast("long")))


def _budget(spark, sf):
    # A request names 256 nodes at most: here the first documents, unknown if not English.
    d = read(spark, sf, "documents").orderBy("doc_id").limit(256)
    rows = d.select(F.col("doc_id").alias("pos"), F.when(F.col("lang") == "en", F.octet_length("text")).alias("size"))
    return context.budget(rows, 100_000, 4096).select("pos", F.coalesce("size", F.lit(-1)).alias("size"), "used")


def _snippets(spark, sf):
    d = read(spark, sf, "documents")
    text, cut = context.snippet(F.col("text").cast("binary"), F.lit(0), F.octet_length("text"), F.lit(4096))
    return d.select("doc_id", F.when(~cut, text).alias("source"), cut.alias("truncated"))


def _hash_dupes(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.lower(F.hex(T.content_hash(F.col("text").cast("binary")))).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


def _diagnostics(spark, sf):
    e = read(spark, sf, "events")
    value = F.from_json("props", "k long").getField("k")
    packed = F.to_json(F.struct(F.col("event_type").alias("severity"), value.alias("line")))
    return e.select("event_id", value.alias("k"), F.get_json_object(packed, "$.severity").alias("severity"), F.get_json_object(packed, "$.line").cast("long").alias("line"))


QUERIES = {
    "latest_per_path": (_latest, "SELECT 'user/' || user_id AS path, max(event_id) AS generation, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id"),
    "writer_dedupe": (_writer_dedupe, "SELECT 'user/' || user_id AS path, event_id % 10 AS generation, event_id AS first_seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 DESC, event_id) AS r FROM events) WHERE r = 1"),
    "debounce_sessions": (
        _sessions,
        "WITH a AS (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) > 300000000 THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT *, CAST(sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a) SELECT session, count(DISTINCT user_id) AS paths, count(*) AS events FROM b GROUP BY session",
    ),
    "debounce_last_event": (
        _session_last,
        "WITH a AS (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) > 300000000 THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT *, CAST(sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a) SELECT session, 'user/' || user_id AS path, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS kind, count(*) AS events FROM b GROUP BY session, user_id",
    ),
    "manifest_diff": (
        _manifest,
        """WITH s AS (SELECT 'order/' || o_orderkey AS path, sha256(CASE WHEN o_orderpriority = '1-URGENT' THEN 'changed' ELSE o_orderstatus END) AS h, o_custkey AS size FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT 'order/' || o_orderkey AS path, sha256(o_orderstatus) AS h, o_custkey AS size, CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END AS generation FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT * FROM (SELECT coalesce(s.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN s.path IS NULL THEN 'deleted' WHEN s.h <> a.h OR s.size <> a.size OR generation < (SELECT max(generation) FROM a) THEN 'dirty' END AS state FROM s FULL JOIN a ON s.path = a.path) WHERE state IS NOT NULL""",
    ),
    "replace_paths": (_replace, "SELECT 'n/' || c_nationkey AS path, c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'n/' || n_nationkey, -1 FROM nation WHERE n_regionkey = 1"),
    "hash_skip": (_skip, "SELECT 'd/' || doc_id AS path, sha256(text) AS content_hash FROM documents WHERE lang <> 'en'"),
    "enclosing_def": (
        _enclosing,
        "SELECT CAST(p.user_id AS VARCHAR) AS path, p.event_id AS point_id, coalesce(arg_min(c.event_id, struct_pack(n := 1 + c.event_id % 97, o := c.event_id)), -1) AS container_id FROM events AS p LEFT JOIN events AS c ON p.user_id = c.user_id AND c.event_id <= p.event_id AND c.event_id + 1 + c.event_id % 97 >= p.event_id + 1 AND (c.event_id < p.event_id OR c.event_id + 1 + c.event_id % 97 > p.event_id + 1) GROUP BY p.user_id, p.event_id",
    ),
    "namespace_scopes": (_scopes, "SELECT CAST(user_id AS VARCHAR) AS path, event_id AS start, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS scope_end FROM events"),
    "explore_budget": (
        _budget,
        """WITH d AS (SELECT doc_id AS pos, CASE WHEN lang = 'en' THEN CAST(strlen(text) AS INTEGER) END AS size FROM documents ORDER BY doc_id LIMIT 256),
p AS (SELECT *, coalesce(sum(least(coalesce(size, 0), 4096)) OVER w, 0) AS prior, count(size) OVER w AS known FROM d WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pos, coalesce(size, -1) AS size, CAST(least(least(coalesce(size, 0), 4096), greatest(0, 100000 - prior)) AS BIGINT) AS used FROM p WHERE prior < 100000 OR known = 0""",
    ),
    "source_snippets": (_snippets, "SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN text END AS source, strlen(text) > 4096 AS truncated FROM documents"),
    "content_hash_dupes": (_hash_dupes, "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "diagnostics_json": (_diagnostics, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS severity, CAST(json_extract(props, '$.k') AS BIGINT) AS line FROM events"),
}
