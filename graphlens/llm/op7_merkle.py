"""WARC Merkle fixity audit.

Each replica gets a tree of its own, made from that replica alone.  Records in archive
order (by key, records of one key by their hash) are hashed; the records of one range of
keys are a leaf range, whose node hashes the ordered record hashes together with the
bytes they cover.  The ranges are fixed by a layout (the first key and the width of a
range), so a lost record moves no other one into another range.  FANOUT nodes side by
side have a parent, which hashes them in order, up to the root.  Records of one key are
numbered; from the FANOUTth on they fill ranges of their own, which come together below
the key's range, so that no key makes a large group.

The audit compares the two roots, then reads of the next level only the children of
nodes that differ: every level, and the records, lie in folders of parents (`part`), of
which only those are read that hold a child in question.  Records are compared only in
leaf ranges that differ; those of all others are intact by their hash.

Defined results: null html and url count as empty; null page_id is a key like others and
comes first; repeated keys are told apart by their order of hash; a replica without a
record has state `missing` there; one with a record too many `extra`, with null offset
and 0 bytes, as the master has no place for it; empty archives give no row; other columns
are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

FANOUT = 64
#: Folders a level is cut into, at most; more only make the descent read less.
PARTS = 256


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's WARC record, as text."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


class Layout(NamedTuple):
    """Which range a key is in, alike for both replicas."""

    low: int
    width: int
    last: int  # the last range; the first, 0, has the null keys
    height: int  # levels above the leaf ranges
    copies: int  # the lowest levels, which bring the ranges of one key together
    folders: list[int]  # of each level, ranges to a folder


class Replica(NamedTuple):
    records: DataFrame  # (page_id, copy, range, sub, start, n_bytes, sha256, part)
    levels: list[DataFrame]  # leaf ranges first: (range, sub, n_bytes, hash, part)


def records(pages: DataFrame) -> DataFrame:
    """(page_id, copy, start, n_bytes, sha256) of an archive's records, in archive order; no
    text goes on.  Ranks come from a range sort, so no key makes a large task."""
    text = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    rows = C.materialize(text.select("page_id", F.octet_length("r").cast("long").alias("n_bytes"), F.sha2("r", 256).alias("sha256")), "digests")
    rows = C.ranked(rows, ["page_id", "sha256"], "records", size="n_bytes")
    several = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min("rank").alias("first")).filter("n > 1").select(F.col("page_id").alias("_k"), "first")
    rows = rows.join(C.small(several), F.col("page_id").eqNullSafe(F.col("_k")), "left")
    rows = rows.select("page_id", F.coalesce(F.col("rank") - F.col("first"), F.lit(0)).alias("copy"), "start", "n_bytes", "sha256")
    return C.materialize(rows, "numbered")


def layout(*replicas: DataFrame, fanout: int = FANOUT) -> Layout:
    """Ranges of about `fanout` records for keys that lie evenly, over all replicas' keys."""
    spread = [r.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.count("page_id").alias("n"), F.max("copy").alias("most")).first() for r in replicas]
    low = min((x.low for x in spread if x.low is not None), default=0)
    high = max((x.high for x in spread if x.high is not None), default=0)
    width = max(1, (high - low + 1) * fanout // max(1, *(x.n for x in spread)))
    last = (high - low) // width + 1
    levels = lambda n: 0 if n == 0 else 1 + levels(n // fanout)
    copies, height = levels(max(x.most or 0 for x in spread) // fanout), levels(last)
    parts = [last // fanout ** max(0, k - copies) // PARTS + 1 for k in range(copies + height + 1)]
    return Layout(low, width, last, copies + height, copies, parts)


def _written(rows: DataFrame, span: int, name: str) -> DataFrame:
    rows = rows.withColumn("part", F.floor(F.col("range") / F.lit(span)).cast("int"))
    rows = rows.repartition("part", F.floor(F.col("sub") / F.lit(1024))).sortWithinPartitions("part", "range", "sub")
    return C.materialize(rows, name, by="part")


def tree(rows: DataFrame, plan: Layout, name: str, fanout: int = FANOUT) -> Replica:
    """One replica's records and tree, from records(), written level by level."""

    def node(order: str):
        return F.sha2(F.concat_ws(":", F.col("n_bytes").cast("string"), F.array_join(F.transform(F.array_sort("kids"), lambda k: k[order]), ",")), 256).alias("hash")

    key = F.coalesce(F.floor((F.col("page_id") - F.lit(plan.low)) / F.lit(plan.width)) + 1, F.lit(0)).cast("long")
    rows = rows.withColumn("range", key).withColumn("sub", F.floor(F.col("copy") / fanout).cast("long"))
    rows = _written(rows, plan.folders[0], f"{name}-records")
    level = rows.groupBy("range", "sub").agg(F.sum("n_bytes").alias("n_bytes"), F.collect_list(F.struct("page_id", "copy", "sha256")).alias("kids"))
    levels = [_written(level.select("range", "sub", "n_bytes", node("sha256")), plan.folders[0], f"{name}-0")]
    for k in range(plan.height):
        own, other = ("sub", "range") if k < plan.copies else ("range", "sub")
        up = levels[-1].groupBy(other, F.floor(F.col(own) / fanout).cast("long").alias("_up"))
        level = up.agg(F.sum("n_bytes").alias("n_bytes"), F.collect_list(F.struct(own, "hash")).alias("kids"))  # fanout at most
        level = level.withColumnRenamed("_up", own).select("range", "sub", "n_bytes", node("hash"))
        levels.append(_written(level, plan.folders[k + 1], f"{name}-{k + 1}"))
    return Replica(rows, levels)


def _below(rows: DataFrame, up: DataFrame, own: str, fanout: int, span: int) -> DataFrame:
    """The rows, nodes or records, below the nodes (range, sub) of `up`, read only from the
    folders that can hold them."""
    range_ = F.col("range") * (fanout if own == "range" else 1)
    to = range_ + (fanout - 1 if own == "range" else 0)
    folders = up.select(F.explode(F.sequence(F.floor(range_ / span).cast("int"), F.floor(to / span).cast("int"))).alias("part")).distinct()
    folders = [r.part for r in folders.collect()]  # PARTS + 1 at most, and the last one's rest
    up = up.select(F.col("range").alias("_r"), F.col("sub").alias("_s"))
    at = {c: F.floor(F.col(c) / (fanout if c == own else 1)).cast("long") for c in ("range", "sub")}
    return rows.filter(F.col("part").isin(folders)).join(C.small(up), (at["range"] == F.col("_r")) & (at["sub"] == F.col("_s")), "left_semi")


def descend(a: Replica, b: Replica, plan: Layout, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """(range, sub) of the leaf ranges that differ, reached from the root through nodes that
    differ, and the nodes compared at each level on the way."""
    differ, compared = None, []
    for k in range(plan.height, -1, -1):
        x, y = a.levels[k], b.levels[k]
        if differ is not None:
            if not differ.limit(1).count():
                return differ, compared
            own = "sub" if k < plan.copies else "range"
            x, y = (_below(t, differ, own, fanout, plan.folders[k]) for t in (x, y))
        y = y.select(F.col("range").alias("_r"), F.col("sub").alias("_s"), F.col("hash").alias("other"))
        both = x.join(y, (F.col("range") == F.col("_r")) & (F.col("sub") == F.col("_s")), "full_outer")
        both = both.select(F.coalesce("range", "_r").alias("range"), F.coalesce("sub", "_s").alias("sub"), "hash", "other")
        compared.append(C.materialize(both, f"compared{k}"))
        differ = compared[-1].filter(~F.col("hash").eqNullSafe(F.col("other"))).select("range", "sub")
    return differ, compared


def audit(master: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The operator: per record (page_id, offset, n_bytes, sha256, replica_sha256, state)."""
    mine, theirs = records(master), records(replica)
    plan = layout(mine, theirs, fanout=fanout)
    a, b = tree(mine, plan, "master", fanout), tree(theirs, plan, "replica", fanout)
    differ, _ = descend(a, b, plan, fanout)
    x, y = (_below(t.records, differ, "", fanout, plan.folders[0]) for t in (a, b))
    y = y.select(F.col("page_id").alias("_id"), F.col("copy").alias("_copy"), F.col("sha256").alias("_sha"))
    both = x.join(y, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "full_outer")
    state = F.when(F.col("_copy").isNull(), "missing").when(F.col("copy").isNull(), "extra").when(F.col("sha256") != F.col("_sha"), "corrupt").otherwise("intact")
    found = both.select(F.coalesce("page_id", "_id").alias("page_id"), F.col("start").alias("offset"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("_sha", F.lit("")).alias("replica_sha256"), state.alias("state"))
    up = differ.select(F.col("range").alias("_r"), F.col("sub").alias("_s"))
    whole = a.records.join(C.small(up), (F.col("range") == F.col("_r")) & (F.col("sub") == F.col("_s")), "left_anti")
    whole = whole.select("page_id", F.col("start").alias("offset"), "n_bytes", "sha256", F.col("sha256").alias("replica_sha256"), F.lit("intact").alias("state"))
    return whole.unionByName(found)


def decayed(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for the query: by the digest of page_id one record in
    256 has its first character overwritten and one in 256 is lost."""
    mark = F.substring(F.md5(F.concat(F.lit("decay:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), 1, 2)
    html = F.coalesce(F.col("html"), F.lit(""))
    hurt = F.when(mark == "0a", F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    return pages.filter(mark != "1b").select("page_id", "url", html.alias("html")).withColumn("html", hurt)


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, decayed(pages))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5('decay:' || coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS mark FROM pages
), h AS (
  SELECT page_id, mark, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap, CASE WHEN mark = '0a' THEN '~' || substr(html, 2) ELSE html END AS hurt FROM p
), r AS (
  SELECT page_id, mark, head || CAST(strlen(html) AS VARCHAR) || gap || html || gap AS a, head || CAST(strlen(hurt) AS VARCHAR) || gap || hurt || gap AS b FROM h
)
SELECT page_id, CAST(coalesce(sum(strlen(a)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(strlen(a) AS BIGINT) AS n_bytes, sha256(a) AS sha256,
  CASE WHEN mark = '1b' THEN '' ELSE sha256(b) END AS replica_sha256, CASE WHEN mark = '1b' THEN 'missing' WHEN a <> b THEN 'corrupt' ELSE 'intact' END AS state
FROM r
"""
