"""Benchmark decontamination by prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of WINDOW words (a shorter item is one window).  Window
words are ordered by rarity, counted over the whole corpus.  A window occurs in a
document only if all its words do, so one prefix token, its rarest word, is necessary:
every word of every document is joined to the prefix tokens; the token's place in the
window and the window's length must fit the document, and the words around it are then
compared with the window, exactly.

Words are first taken apart and then folded, for lower-casing depends on what stands
around a letter.  Tokens are looked up by lower(word), which words that are equal with
A-Z folded always share; the comparison folds A-Z alone.

Defined results: null text has no words; an item without words has no window; repeated
documents each get a row; repeated items count once; a null item_id is written as the
empty string; null doc_id is kept; empty tables give no row, or no hit; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

WINDOW = 10
#: Up to so many prefix tokens are broadcast to the words; more are joined by shuffling.
TOKENS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(C.WORD_RE), F.lit(0)), F.array().cast("array<string>"))


def exact_words(text: Column) -> Column:
    return _words(F.translate(text, C.UPPER, C.LOWER))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(w, items): the distinct windows of all items, and whose they are."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), exact_words(F.col("text")).alias("iw")).filter("size(iw) > 0")
    at = F.sequence(F.lit(1), F.greatest(F.size("iw") - (size - 1), F.lit(1)))
    items = items.select("item_id", F.explode(F.transform(at, lambda i: F.slice("iw", i, F.lit(size)))).alias("w"))
    return items.groupBy("w").agg(F.collect_set("item_id").alias("items"))


def _split(text: Column) -> Column:
    """The words of text and one empty string after them, which stands for the text itself;
    another one comes before them if the text starts with a separator."""
    return F.split(F.concat(F.coalesce(text, F.lit("")), F.lit("\n")), SEPARATORS)


def _folded(words: Column) -> Column:
    """Words as one string, A-Z folded; words hold no blanks."""
    return F.translate(F.array_join(words, " "), C.UPPER, C.LOWER)


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """wins with `token`, the rarest word of the window over all documents, and `place`."""
    vocabulary = wins.select(F.explode("w").alias("token")).select(F.lower("token").alias("token")).distinct()
    vocabulary = C.small(C.materialize(vocabulary, "vocabulary"))
    seen = docs.select(F.explode(_split(F.col("text"))).alias("word")).select(F.lower("word").alias("token")).join(vocabulary, "token")
    counts = C.small(C.materialize(seen.groupBy("token").agg(F.count("*").alias("n")), "rarity"))
    each = wins.select("w", "items", F.posexplode("w").alias("place", "word")).withColumn("token", F.lower("word")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("r")
    return each.groupBy("w", "items").agg(rarest).select("w", "items", F.col("r.token").alias("token"), F.col("r.place").alias("place"))


def _candidates(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(rid, doc_id, digest, _w, p, token): every word of a text that is a token, where
    tokens has the empty one, so that each text gives a row for the end of it."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("rid"))
    if tokens.limit(TOKENS + 1).count() <= TOKENS:
        words = rows.select("rid", "doc_id", "digest", _split(F.col("text")).alias("_w"))
        words = words.select("rid", "doc_id", "digest", "_w", F.posexplode("_w").alias("p", "word"))
        return words.withColumn("token", F.lower("word")).join(F.broadcast(tokens), "token")
    # Places depend on the text alone, so its digests join them, and no text is shuffled
    # once a word.
    rows = rows.withColumn("x2", F.xxhash64("text", F.lit(1)))
    words = rows.select("digest", "x2", F.posexplode(_split(F.col("text"))).alias("p", "word")).filter("word != ''").withColumn("token", F.lower("word"))
    places = words.join(tokens, "token").groupBy("digest", "x2").agg(F.collect_set(F.struct("p", "token")).alias("at"))
    rows = rows.withColumn("_w", _split(F.col("text"))).drop("text").join(places, ["digest", "x2"], "left")
    end = F.array(F.struct((F.size("_w") - 1).alias("p"), F.lit("").alias("token")))
    at = F.array_union(F.coalesce("at", F.array().cast("array<struct<p:int,token:string>>")), end)
    return rows.select("rid", "doc_id", "digest", "_w", F.explode(at).alias("c")).select("rid", "doc_id", "digest", "_w", "c.p", "c.token")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The operator: per document (rid, doc_id, digest, n_words, spans, items), spans being the
    (start, length) of each occurrence of a window in words, items the sorted item_ids."""
    wins = prefixes(docs, windows(benchmark, size))
    wins = C.materialize(wins.select("token", "place", F.size("w").alias("len"), F.array_join("w", " ").alias("window"), "items"), "windows")
    end = docs.sparkSession.range(1).select(F.lit("").alias("token"))
    rows = _candidates(docs, wins.select("token").distinct().unionByName(end))
    # Only the words that a window could cover go on.
    low, last = F.greatest(F.col("p") - (size - 1), F.lit(0)), F.size("_w") - 1
    lead = ((F.element_at("_w", 1) == "") & (last > 0)).cast("int")
    rows = rows.filter((F.col("token") != "") | (F.col("p") == last))
    rows = rows.select("rid", "doc_id", "digest", "p", "token", last.alias("last"), lead.alias("lead"), low.alias("low"), F.slice("_w", low + 1, F.lit(2 * size - 1)).alias("ctx"))
    rows = rows.join(C.small(wins), "token", "left")
    start = F.col("p") - F.col("place")
    fits = (start >= 0) & (start + F.col("len") <= F.col("last"))
    found = fits & (_folded(F.slice("ctx", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.col("len"))) == F.col("window"))
    end = F.col("token") == ""
    rows = rows.filter(found | end).select("rid", "doc_id", "digest", F.when(end, F.col("last") - F.col("lead")).alias("n_words"), F.when(~end, F.struct((start - F.col("lead")).alias("start"), F.col("len").alias("len"))).alias("span"), F.when(~end, F.col("items")).alias("items"))
    rows = rows.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    return rows.withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    found = hits(docs, benchmark, size)
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    found = found.withColumn("n_hit", covered.cast("long"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), b AS (
  SELECT DISTINCT item_id, w[k:k + 9] AS win FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0
), o AS (
  SELECT DISTINCT rid, k, l, item_id FROM (SELECT rid, k, l, w[k:k + l - 1] AS win FROM d, (SELECT DISTINCT len(win) AS l FROM b) AS n, unnest(range(1, len(w) - l + 2)) AS t(k)) AS p JOIN b USING (win)
), h AS (SELECT rid, count(DISTINCT x) AS n_hit FROM o, unnest(range(k, k + l)) AS t(x) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM o GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN m USING (rid)
"""
