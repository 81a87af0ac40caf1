"""Near-duplicate classes by improved consistent weighted sampling.

A text's shingles (five words, A-Z folded; a shorter text is one shingle) weigh their
frequency in the text times the mean weight of their words: half plus half of the word's
inverse document frequency over the largest one (the augmented form, which keeps words
that a large group of copies shares from counting for nothing).  SAMPLES
consistent weighted samples per text (ICWS: the same shingle at the same weight draws
the same numbers in every text) agree between two texts with the probability of their
weighted Jaccard similarity.  Texts that agree in all ROWS samples of a band share a bucket.  Buckets with
the same members are taken once.

A large bucket is dealt to blocks of bounded size, each of which also gets the bucket's
leader.  Within a block, texts without any partner that agrees in AGREE samples go; for
the rest the weighted Jaccard similarity of every pair is computed, as a matrix product
over shared shingles, and only a spanning forest of the links of SIMILARITY or more is
kept.  Links are joined to classes by alternating large-star and small-star rounds.  In a
bucket of near copies the leader ties the blocks together, and that is all.  Only texts
of a large bucket that are not in its largest class yet, the strays, then meet all its
blocks in the same way, so no link between different texts is lost, and a group of n
near copies costs about n rows.

Exact copies are one text from the start.  A pair at similarity 0.8 is missed by all
bands with probability 0.0008, and has fewer than AGREE agreeing samples with 1e-6.

Defined results: null text is the empty text; texts without words are similar to their
exact copies alone; class_id is the smallest doc_id of the class (null if it has none);
different texts may share a doc_id, and then classes may share a class_id; repeated rows
and null doc_id get rows; an empty table gives no row; other columns are ignored
(representatives keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
AGREE = 14
#: Texts and shingles to a block, on average.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
#: Parts a key's rows are dealt to where one key may have many.
SALTS = 16
#: Words in fewer documents than this share get its idf; it bounds the broadcast table
#: at (mean distinct words of a document) / MIN_SHARE rows for a corpus of any size.
MIN_SHARE, LEXICON_LIMIT = 0.0005, 8_000_000
SCALE = 4096.0


def augmented(n, total: int) -> np.ndarray:
    """Weight of words in n of total documents, in whole units of 1 / SCALE."""
    least = max(1.0, MIN_SHARE * total)
    most = 1 + log(max(total, 1) / least)
    idf = 1 + np.log(max(total, 1) / np.maximum(n, least))
    return np.round(SCALE * (0.5 + 0.5 * idf / most)).astype(np.int64)


class Weights:
    """Weights of words; those not in the table are as rare as can be."""

    def __init__(self, terms: np.ndarray, n: np.ndarray, total: int):
        self.terms = terms
        self.idf = augmented(n, total)
        self.rare = int(SCALE)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.full(len(h), self.rare)
        at = C.lookup(self.terms, h >> C.U64(64 - C.TERM_BITS))
        return np.where(at >= 0, self.idf[at], self.rare)


def weigh(docs: DataFrame) -> Weights:
    total = docs.count()
    terms, n = C.collect_terms(C.term_counts(docs, distinct=True, min_share=MIN_SHARE, total=total), LEXICON_LIMIT)
    return Weights(terms, n, total)


def weighted_shingles(data: np.ndarray, offs: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times, weight of one) of each distinct shingle, by row and shingle."""
    row, _, _, h = C.words(data, offs)
    sums = np.r_[0, np.cumsum(weights.of(h))]
    last = np.searchsorted(row, row, "right") if len(row) else row
    srow, at, shingle = C.shingles(row, h, SHINGLE)
    to = np.minimum(at + SHINGLE, last[at])
    one = (sums[to] - sums[at]) / ((to - at) * SCALE)
    key = (srow.astype(np.uint64) << C.U64(C.TERM_BITS)) | (shingle >> C.U64(64 - C.TERM_BITS))
    key, index, times = np.unique(key, return_index=True, return_counts=True)
    return (key >> C.U64(C.TERM_BITS)).astype(np.int64), key & C.U64((1 << C.TERM_BITS) - 1), times, one[index]


def samples(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(texts, SAMPLES) consistent weighted samples; rows of shingle are sorted by text."""
    out = np.zeros((n, SAMPLES), np.uint64)
    if not len(row):
        return out
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    which = row[first]
    place = np.repeat(np.arange(len(first)), count)
    high = np.log(weight).astype(np.float32)
    unit = np.float32(2.0**-32)
    half = np.float32(0.5)
    low = C.U64(0xFFFFFFFF)
    for k in range(SAMPLES):
        a, b, c = (C.seeded(shingle, 1000 + 3 * k + j) for j in range(3))
        # Gamma(2, 1) variables as products of two uniforms, and one uniform.
        r = -np.log(((a >> C.U64(32)).astype(np.float32) + half) * unit * (((a & low).astype(np.float32) + half) * unit))
        g = np.log(-np.log(((b >> C.U64(32)).astype(np.float32) + half) * unit * (((b & low).astype(np.float32) + half) * unit)))
        beta = (c >> C.U64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(high / r + beta)
        ln_a = g - r * (t - beta) - r
        best = np.minimum.reduceat(ln_a, first)
        at = np.flatnonzero(ln_a == best[place])
        _, lead = np.unique(place[at], return_index=True)
        at = at[lead]
        out[which, k] = C.mix(shingle[at] + C.mix(t[at].astype(np.int64).view(np.uint64) + C.U64(k)))
    return out


def signatures(docs: DataFrame, weights) -> DataFrame:
    """(doc_id, key, bands, sample, size): key is the md5 digest of the text; bands is null, and
    sample empty, without words; size is the number of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.chunks(batches):
            row, shingle, times, one = weighted_shingles(data, offs, weights.value)
            drawn = samples(row, shingle, times * one, rows.num_rows)
            size = np.bincount(row, minlength=rows.num_rows)
            some = size > 0
            band = np.zeros((rows.num_rows, BANDS), np.uint64)
            for j in range(ROWS):
                band = C.mix(band * C.U64(0xD6E8FEB86659FD93) + drawn[:, j::ROWS])
            band = band.view(np.int64).tolist()
            drawn = drawn.astype(np.uint32)
            raw = data.tobytes()
            keys = [hashlib.md5(raw[a:b]).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(keys, pa.binary()), pa.array([b if s else None for b, s in zip(band, some, strict=True)], pa.list_(pa.int64())), pa.array([d.tobytes() if s else b"" for d, s in zip(drawn, some, strict=True)], pa.binary()), pa.array(size, pa.int64())],
                names=["doc_id", "key", "bands", "sample", "size"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, bands array<long>, sample binary, size long")


def salted(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows.join(table, key), where table has a row a key and a key may have many rows: they
    are dealt to SALTS parts by `rep`."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(SALTS)).cast("int"))
    table = table.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.join(table, [key, "_salt"], how).drop("_salt")


def bucketed(members: DataFrame) -> DataFrame:
    """(bucket, rep, lead, parts, own) from (bucket, rep, size): buckets with one member go,
    of buckets with the same members one stays; own is the block of a member, of `parts`."""
    h = F.xxhash64("rep")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("y"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("n > 1")
    sizes = sizes.groupBy("n", "s", "x", "y", "lo", "hi").agg(F.min("bucket").alias("bucket"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("s") / BLOCK_SHINGLES), F.col("n"))).cast("int")
    rows = salted(members.select("bucket", "rep"), sizes.select("bucket", F.col("lo").alias("lead"), parts.alias("parts")), "bucket")
    return rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int"))


def blocks(rows: DataFrame) -> DataFrame:
    """(pair, rep): the blocks of bucketed() rows, each with its bucket's leader."""
    pair = F.xxhash64("bucket", "own").alias("pair")
    lead = rows.filter((F.col("parts") > 1) & (F.col("rep") == F.col("lead"))).withColumn("home", F.col("own"))
    lead = lead.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("own != home")
    return rows.select(pair, "rep").unionByName(lead.select(pair, "rep"))


def strays(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(pair, rep): members of large buckets that are not of their bucket's largest class, by
    the classes so far, in chunks, each with every block of the bucket."""
    rows = rows.filter("parts > 1").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
    rows = C.materialize(rows, "large")
    main = rows.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.filter("`all` > most").select("bucket", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("chunks"))
    rows = salted(rows, main, "bucket")
    stray = rows.filter("root != main").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")).cast("int"))
    stray = stray.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.xxhash64("bucket", "own", "chunk", F.lit(2)).alias("pair")
    return rows.select(pair, "rep").unionByName(stray.select(pair, "rep")).distinct()


def _groups(batches: Iterator[pa.RecordBatch], items) -> Iterator[tuple[int, list]]:
    """(key, items) of each run of equal keys in the first column."""
    at, held = None, []
    for keys, values in items(batches):
        for key, value in zip(keys, values, strict=True):
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append(value)
    if held:
        yield at, held


def _agreeing(dealt: DataFrame) -> DataFrame:
    """(pair, rep) of members with a partner in their pair that agrees in AGREE samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items(batches):
            for rows in batches:
                yield rows.column(0).to_pylist(), zip(rows.column(1).to_pylist(), (x.as_py() for x in rows.column(2)), strict=True)

        pairs, reps = [], []
        for key, held in _groups(batches, items):
            sample = np.array([np.frombuffer(s, np.uint32) for _, s in held])
            n = len(held)
            good = np.zeros(n, bool)
            for lo in range(0, n, 256):
                agree = np.zeros((min(256, n - lo), n), np.int8)
                for k in range(SAMPLES):
                    agree += sample[lo : lo + 256, k, None] == sample[None, :, k]
                agree[np.arange(len(agree)), lo + np.arange(len(agree))] = 0
                good[lo : lo + 256] = (agree >= AGREE).any(1)
            keep = [rep for (rep, _), g in zip(held, good, strict=True) if g]
            pairs += [key] * len(keep)
            reps += keep
            if len(reps) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(reps, pa.int64())], names=["bucket", "rep"])
                pairs, reps = [], []
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(reps, pa.int64())], names=["bucket", "rep"])

    return dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "bucket long, rep long")


def linked(sets: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Component of each weighted set (elements, weights) under the links of `similarity`;
    components are named by their first member."""
    n = len(sets)
    total = np.array([w.sum() for _, w in sets])
    which = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    element, weight = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets])
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    which, weight = which[shared], weight[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    common = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    which, weight, column = which[order], weight[order], column[order]
    width = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((n, width))
        part[which[a:b], column[a:b] - lo] = np.sqrt(weight[a:b])
        common += part @ part.T
    near = common >= similarity * (total[:, None] + total[None, :] - common) * (1 - 1e-9)
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        low = np.where(near, label[None, :], n).min(1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _links(rows: DataFrame, weights) -> DataFrame:
    """(a, b): a spanning forest of the verified links of each pair's members; rows are
    (bucket, rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items(batches):
            for rows, data, offs in C.chunks(batches):
                row, shingle, times, one = weighted_shingles(data, offs, weights.value)
                # A shingle that occurs n times is n elements, so that sets suffice.
                level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, shingle, one = np.repeat(row, times), np.repeat(shingle, times), np.repeat(one, times)
                element = np.where(level > 0, C.mix(shingle + C.mix(level.astype(np.uint64))), shingle)
                cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
                yield rows.column(0).to_pylist(), ((rep, (element[cut[i] : cut[i + 1]], one[cut[i] : cut[i + 1]])) for i, rep in enumerate(rows.column(1).to_pylist()))

        a, b = [], []
        for _, held in _groups(batches, items):
            label = linked([s for _, s in held])
            for i in np.flatnonzero(label != np.arange(len(held))).tolist():
                a.append(held[i][0])
                b.append(held[label[i]][0])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with links.
    Large-star and small-star rounds; each round is written, none is held in memory.  A hub's
    links are dealt to parts, so that it makes no large task."""
    links = C.materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    own = lambda rows, low: salted(rows.withColumn("rep", F.col("v")), low, "u").drop("rep")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = own(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = C.materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = own(large, low).select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small = C.materialize(small, "small")
        # Stars only: every node has one lower neighbour, and that one has none.
        stuck = small.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or small.select("v").distinct().join(small.select("u"), F.col("v") == F.col("u"), "left_semi").limit(1).count()
        links = small
        if not stuck:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _verified(dealt: DataFrame, texts: DataFrame, docs: DataFrame, weights) -> DataFrame:
    """(a, b): links of similarity among the members of each pair (pair, rep), written."""
    rep = F.xxhash64("key")
    close = _agreeing(dealt.join(texts.select("rep", "sample"), "rep").select("pair", "rep", "sample")).distinct()
    close = close.join(texts.select("rep", "size"), "rep")
    close = C.materialize(bucketed(close).select("bucket", "rep"), "close")
    # Of a text's copies, the rows of its smallest doc_id are read, and one of them is kept.
    need = texts.select("rep", F.coalesce("low", "rep").alias("low")).join(close.select("rep").distinct(), "rep", "left_semi")
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    body = docs.select(key.alias("key"), "doc_id", "text").select(rep.alias("rep"), F.coalesce("doc_id", rep).alias("low"), "text")
    body = body.join(need, ["rep", "low"]).groupBy("rep").agg(F.first("text").alias("text"))
    return C.materialize(_links(close.join(body, "rep").select("bucket", "rep", "text"), weights), "verified")


def classes(docs: DataFrame) -> DataFrame:
    """The operator: (doc_id, key, root, class_id) of every row; root tells classes apart."""
    spark = docs.sparkSession
    C.tune(spark)
    weights = spark.sparkContext.broadcast(weigh(docs))
    signed = C.materialize(signatures(docs, weights), "signed")
    # A text is known by its digest: different texts may share a doc_id.
    texts = C.materialize(signed.groupBy("key").agg(F.xxhash64("key").alias("rep"), F.min("doc_id").alias("low"), F.first("bands").alias("bands"), F.first("sample").alias("sample"), F.first("size").alias("size")), "texts")
    members = texts.filter("bands is not null").select("rep", "size", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("bucket"), "rep", "size")
    members = C.materialize(bucketed(members), "members")
    links = _verified(blocks(members), texts, docs, weights)
    roots = components(links)
    if members.filter("parts > 1").limit(1).count():
        rest = C.materialize(strays(members, roots), "strays")
        if rest.limit(1).count():
            roots = components(links.unionByName(_verified(rest, texts, docs, weights)))
    texts = texts.select("key", "rep", "low").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    ids = texts.groupBy("root").agg(F.min("low").alias("class_id"))
    named = texts.join(ids, "root").select("key", "root", "class_id")
    return signed.select("doc_id", "key").join(named, "key")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (any, if all are null)."""
    named = C.materialize(classes(docs), "classes")
    first = F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    keep = named.groupBy("root").agg(first.alias("first")).select("first.*")
    keep = keep.select(F.col("doc_id").alias("__graphlens_id"), F.col("key").alias("__graphlens_key"))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.withColumn("__graphlens_digest", digest)
    rows = rows.join(keep, (F.col("__graphlens_digest") == F.col("__graphlens_key")) & F.col("doc_id").eqNullSafe(F.col("__graphlens_id")))
    return rows.dropDuplicates(["doc_id", "__graphlens_digest"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.read(spark, sf_dir, "documents")).select("doc_id", "class_id")
