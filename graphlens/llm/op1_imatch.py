"""I-Match document fingerprints.

Terms (words, A-Z folded) whose inverse document frequency lies in a band form the
lexicon.  A text's distinct lexicon terms are sorted, and hashed for the whole lexicon
and for several randomised subsets of it: SEEDS random orders of the lexicon, each cut
at RATES shares (a quarter, an eighth, ...), so that short and long texts both have
subsets of a few terms.  The fingerprint lists all hashes.  Likeness is the share of
orders in which two texts agree on the narrowest cut that leaves either a term; without
such an order, whether they agree on the whole lexicon.

Defined results: null text is the empty text; an empty text, or one without words, has
the fingerprint of dashes, and likeness 1 to its kind; a text without any lexicon term uses
all its distinct terms; repeated rows each get a row; rows with equal doc_id are ordered
by text, null doc_id comes last; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

#: The band: a term is in at most MAX_SHARE and at least MIN_SHARE of all documents (and
#: in two).  At most (mean distinct terms of a document) / MIN_SHARE terms can be in it,
#: however large the corpus, which bounds what is broadcast.
MIN_SHARE, MAX_SHARE = 0.001, 0.5
LEXICON_LIMIT = 8_000_000
SEEDS, RATES = 10, 8
SUBSETS = 1 + SEEDS * RATES
EMPTY = "----"


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted terms of the band, counted over every whole text."""
    total = docs.count()
    counts = C.term_counts(docs, distinct=True, min_share=min_share, total=total)
    return C.collect_terms(counts.filter(F.col("n") <= max(2.0, max_share * total)), LEXICON_LIMIT)[0]


def _put(out: np.ndarray, column: int, row: np.ndarray, value: np.ndarray) -> None:
    """Into a column, the hash of each row's values in their order."""
    if not len(row):
        return
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    total = np.add.reduceat(value * C.powers(int(place.max()) + 1)[0][place], first)
    out[row[first], column] = (C.mix(total) >> C.U64(48)).astype(np.int32)


def fingerprint_codes(data: np.ndarray, offs: np.ndarray, lex: np.ndarray) -> np.ndarray:
    """(texts, SUBSETS) of 16-bit subset hashes, -1 for an empty subset."""
    n = len(offs) - 1
    out = np.full((n, SUBSETS), -1, np.int32)
    row, _, _, h = C.words(data, offs)
    row, term, _ = C.distinct_terms(row, h)
    known = C.lookup(lex, term) >= 0
    has = np.bincount(row[known], minlength=n) > 0
    use = known | ~has[row]
    row, term = row[use], term[use]
    value = C.seeded(term, 7)
    _put(out, 0, row, value)
    for s in range(SEEDS):
        u = C.seeded(term, 101 + s)
        picked_row, picked, picked_value = row, u, value
        for level in range(RATES):
            keep = picked < C.U64(1 << (62 - level))
            picked_row, picked, picked_value = picked_row[keep], picked[keep], picked_value[keep]
            if not len(picked_row):
                break
            _put(out, 1 + s * RATES + level, picked_row, picked_value)
    return out


def as_text(codes: np.ndarray) -> list[str]:
    return ["".join(EMPTY if c < 0 else f"{c:04x}" for c in row) for row in codes.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of orders with equal narrowest cuts, see above."""
    x, y = (c[:, 1:].reshape(len(c), SEEDS, RATES) for c in (a, b))
    some = (x >= 0) | (y >= 0)
    deepest = (RATES - 1 - np.argmax(some[:, :, ::-1], 2))[:, :, None]
    same = (np.take_along_axis(x, deepest, 2) == np.take_along_axis(y, deepest, 2))[:, :, 0]
    counted = some.any(2)
    n = counted.sum(1)
    return np.where(n == 0, a[:, 0] == b[:, 0], (same & counted).sum(1) / np.maximum(n, 1))


def fingerprints(docs: DataFrame, lex: np.ndarray) -> DataFrame:
    """The operator: (doc_id, fingerprint) of every text."""
    lex = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(as_text(fingerprint_codes(data, offs, lex.value)))], names=["doc_id", "fingerprint"])

    C.tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, doc_id, text): each bucket holds a range of doc_id, highest
    first, then, marked extra, the rows that start the next range.  One shuffle of the
    texts; the ranges come from an approximate quantile of doc_id alone."""
    spark = docs.sparkSession
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.col("doc_id").cast("double")
    cuts = docs.agg(F.percentile_approx(ids, [i / n for i in range(1, n)], 16 * n)).first()[0] or []
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    # Null comes after the lowest id: bucket -1.
    docs = docs.select("doc_id", F.col("text"), F.coalesce(ids, F.lit(0.0)).alias("_at"))
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="_at", outputCol="_b").transform(docs)
    else:
        docs = docs.withColumn("_b", F.lit(0.0))
    docs = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_b").cast("int")).alias("bucket"))
    # One row per bucket, so at most n + 1 rows.
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted(tops, key=lambda r: -r.bucket)
    before = {r.bucket: tops[i - 1].bucket for i, r in enumerate(tops)}
    table = spark.createDataFrame([(r.bucket, r.top, before[r.bucket]) for r in tops], "bucket int, top long, before int")
    joined = docs.join(F.broadcast(table), "bucket")
    places = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("x")), F.struct(F.col("before").alias("b"), F.lit(True).alias("x")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("x"))))
    rows = joined.select("doc_id", "text", F.explode(places).alias("p")).select(F.col("p.b").alias("bucket"), F.col("p.x").alias("extra"), "doc_id", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")


def compare_edits(docs: DataFrame, lex: np.ndarray) -> DataFrame:
    """Per row: the fingerprint of its text, of its edited text (the last third replaced
    from the next document in descending doc_id) and their likenesses."""
    lex = docs.sparkSession.sparkContext.broadcast(lex)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: (bucket, doc_id, text, codes)
        done = None  # the bucket whose first extra row has come
        for rows, data, offs in C.chunks(batches):
            codes = fingerprint_codes(data, offs, lex.value)
            out = []
            texts = [x or "" for x in rows.column(3).to_pylist()]
            for i, (bucket, extra, doc_id, text) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), texts, strict=True)):
                if extra and done == bucket:
                    continue
                if held is not None and held[0] == bucket:
                    n = len(held[2])
                    k = n // 3
                    edited = held[2][: n - k] + text[:k] if k else held[2]
                    out.append((held[1], n, edited, held[3], codes[i]))
                if extra:
                    held, done = None, bucket
                else:
                    held = (bucket, doc_id, text, codes[i])
            if out:
                edited = pa.array([x[2] for x in out])
                own, nxt = np.array([x[3] for x in out]), np.array([x[4] for x in out])
                changed = np.concatenate([fingerprint_codes(d, o, lex.value) for _, d, o in C.chunks(iter([pa.RecordBatch.from_arrays([edited], names=["text"])]))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array([x[1] for x in out], pa.int64()),
                        pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out]),
                        pa.array(as_text(own)),
                        pa.array(as_text(changed)),
                        pa.array(likeness(own, changed)),
                        pa.array(likeness(own, nxt)),
                    ],
                    names=names,
                )

    return _in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.tune(spark)
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_edits(docs, lexicon(docs))
