"""Quality classifier: importance resampling.

Two generative models of hashed n-grams are fitted: the target (texts labelled good) and
the raw corpus (every text).  Tokens are separated by white space; the n-grams are one
and two words (A-Z folded) and one and two word shapes (runs of lower case, upper case,
digits, and each other sign; a word said twice running is one too).  A text's log weight
is the sum of log(target / raw) over its n-grams; its score is that sum over (tokens +
PRIOR), so that long texts do not win by length and very short ones stay near neutral.

The sample is drawn by Gumbel top-k: the texts with the k largest keys, score /
TEMPERATURE plus Gumbel noise, are a draw of k texts without replacement by the weights
exp(score / TEMPERATURE).  At this temperature a text whose score is lower by 1 is 150
times less likely, so the noise decides among texts near the edge of the sample, and
which of them get in.  The sample size k is the caller's; by default it is the number of
texts on the better side of the score that parts the good labels from the others best.

Defined results: null text is empty, with log weight 0; null doc_id has no label, and
its noise comes from its text; a text with several labels is good if any says so; null
labels are none; ties of the key go to the smaller doc_id; without good labels the models
are equal, and without both kinds of labels every text is kept; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

BITS, FAMILIES = 16, 4
SIZE = FAMILIES << BITS
#: The models' target side is fitted on so many labelled rows at most, those with the
#: smallest digests of their doc_id.
FIT_LABELS = 200_000
#: Counts added to what the target model has and to what the raw model would lead one to
#: expect there, so that rare n-grams stay neutral: some, and a share of all n-grams of the
#: target, so that a larger target smooths as much.
ADDED, ADDED_SHARE = 2.0, 1e-5
PRIOR, TEMPERATURE = 18.0, 0.2
SEED = 11


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    space = (byte == 0x20) | ((byte >= 9) & (byte <= 13))
    kind = byte.copy()
    kind[(byte >= 97) & (byte <= 122) | (byte >= 128)] = 1
    kind[(byte >= 65) & (byte <= 90)] = 2
    kind[(byte >= 48) & (byte <= 57)] = 3
    return ~space, kind.astype(np.uint8)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, tokens of each row): the hashed n-grams of every text."""
    token, kind = _classes()
    row, start, end = C.runs(token[data], offs)
    odd, fold, _ = C._tables()
    up, down = C.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(odd[fold[data]] * up[: len(data)], out=sums[1:])
    word = C.mix((sums[end] - sums[start]) * down[start])
    shape = kind[data]
    # Two-byte capitals (U+00C0 to U+00DE) count as upper case.
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] <= 0x9E)) if len(data) > 1 else np.zeros(0, np.int64)
    shape[capital] = shape[capital + 1] = 2
    new = np.ones(len(data), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[start] = True
    order = np.zeros(len(data) + 1, np.int64)
    np.cumsum(new, out=order[1:])
    np.cumsum(np.where(new, odd[shape] * up[order[:-1]], C.U64(0)), out=sums[1:])
    form = C.mix((sums[end] - sums[start]) * down[order[start]] + C.U64(1))
    n = len(offs) - 1
    rows, out = [], []
    same = row[1:] == row[:-1]
    for f, h in enumerate((word, form)):
        pair = C.mix(h[:-1] * C.U64(0xD6E8FEB86659FD93) + h[1:])[same] if len(h) else h
        for g, (r, x) in enumerate(((row, h), (row[1:][same] if len(h) else row, pair))):
            if f and g and len(h):  # a word said again is a shape of its own
                x = C.mix(x + (word[1:] == word[:-1])[same].astype(np.uint64))
            rows.append(r)
            out.append((x >> C.U64(64 - BITS)).astype(np.int64) + ((2 * f + g) << BITS))
    return np.concatenate(rows), np.concatenate(out), np.bincount(row, minlength=n)


def fit_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good): at most FIT_LABELS labelled ids."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    return good.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(FIT_LABELS)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target / raw) of each n-gram bucket; raw is counted over every whole text."""
    C.tune(docs.sparkSession)
    good = fit_labels(labels).filter("good = 1")
    # At most FIT_LABELS rows.
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.col("good").isNotNull().alias("good"))
    slices = 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE), np.int64)
        for rows, data, offs in C.chunks(batches):
            row, bucket, _ = features(data, offs)
            total[0] += np.bincount(bucket, minlength=SIZE)
            chosen = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
            total[1] += np.bincount(bucket[chosen[row]], minlength=SIZE)
        parts = total.reshape(2, slices, SIZE // slices)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([parts[:, i].tobytes() for i in range(slices)], pa.binary())], names=["slice", "counts"])

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"][:1], "counts": [total.tobytes()]})

    # SIZE counts for each model, however large the corpus.
    rows = marked.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    raw, target = np.ones(SIZE), np.zeros(SIZE)
    for r in rows:
        both = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
        at = slice(r["slice"] * both.shape[1], (r["slice"] + 1) * both.shape[1])
        raw[at] += both[0]
        target[at] = both[1]
    ratio = np.zeros(SIZE)
    for f in range(FAMILIES):
        at = slice(f << BITS, (f + 1) << BITS)
        n = target[at].sum()
        expected, added = raw[at] / raw[at].sum() * n, ADDED + ADDED_SHARE * n
        ratio[at] = np.log((target[at] + added) / (expected + added))
    return ratio


def gumbel(ids: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise, a function of the id."""
    return -np.log(-np.log(C.uniform(ids, SEED)))


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The operator's first half: (doc_id, digest, n_tokens, log_weight, score, sample_key) of every text;
    digest, the text's xxhash64, tells rows of one doc_id apart."""
    C.tune(docs.sparkSession)
    ratio = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.chunks(batches):
            row, bucket, n = features(data, offs)
            weight = np.round(np.bincount(row, ratio.value[bucket], minlength=rows.num_rows), 6)
            value = np.round(weight / (n + PRIOR), 9)
            ids = rows.column(0).fill_null(-1).to_numpy().astype(np.int64).view(np.uint64)
            digest = rows.column(2).fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            ids = np.where(rows.column(0).is_null().to_numpy(zero_copy_only=False), C.mix(digest), ids)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(n), pa.array(weight), pa.array(value), pa.array(value / TEMPERATURE + gumbel(ids))], names=["doc_id", "digest", "n_tokens", "log_weight", "score", "sample_key"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, "doc_id long, digest long, n_tokens long, log_weight double, score double, sample_key double")


def parting(scores: np.ndarray, good: np.ndarray) -> float:
    """The score that parts good texts from others with the least sum of both error rates:
    the middle of the widest gap of those that do; -inf without both kinds."""
    if good.all() or not good.any():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    # Errors if the cut lies between s[i] and s[i + 1].
    errors = np.cumsum(g)[:-1] / g.sum() + (1 - np.cumsum(~g)[:-1] / (~g).sum())
    gap = np.diff(s)
    errors = np.where(gap > 0, errors, np.inf)
    if not np.isfinite(errors).any():
        return float(s[0])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    at = best[np.argmax(gap[best])]
    return float((s[at] + s[at + 1]) / 2)


def wanted(scored: DataFrame, labels: DataFrame) -> int:
    """The default sample size."""
    # At most FIT_LABELS rows, for each label and text.
    rows = scored.join(F.broadcast(fit_labels(labels)), "doc_id").groupBy("doc_id", "digest").agg(F.max("score").alias("score"), F.max("good").alias("good")).limit(FIT_LABELS).toArrow()
    cut = parting(rows.column("score").to_numpy(), rows.column("good").to_numpy() == 1)
    return scored.filter(F.col("score") >= F.lit(cut)).count()


def draw(scored: DataFrame, k: int) -> DataFrame:
    """scored with `kept`, true for the k rows with the largest keys."""
    rows = C.ranked(scored, [F.col("sample_key").desc(), F.col("doc_id").asc_nulls_last(), "digest"], "ranked")
    return rows.select(*scored.columns, (F.col("rank") < k).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The operator: score() with `kept`, true for the k texts drawn."""
    C.tune(docs.sparkSession)
    scored = C.materialize(score(docs, fit(docs, labels)), "scores")
    return draw(scored, wanted(scored, labels) if k is None else k)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: the documents that the classifier keeps, with their weights."""
    return resample(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")).filter("kept").drop("kept", "digest")
