"""Shared pieces of the training-data operators.

Text is handled as UTF-8 bytes straight out of Arrow buffers: one numpy pass splits a
whole batch into words and gives each word a 64-bit hash, so no Python object is made
per word.  Everything here is deterministic; a rerun gives the same hashes.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import runtime
from ..runtime import small  # noqa: F401  for the operators

#: Word characters: everything but ASCII other than digits and letters.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text handled in one numpy pass; a longer text is still taken whole.
CHUNK_BYTES = 2 << 20
#: Rows in one such pass, so that a row's number fits the ten top bits of a sort key.
MAX_ROWS = 1024

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers hold, whatever the text lengths, and
    sees that they find this package."""
    runtime.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: Folders written by materialize and not yet removed.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost
    executors, and later plans see one fixed version of the rows.  `by`, the last column,
    gives the folders the rows lie in."""
    spark = df.sparkSession
    path = f"{runtime.shared_dir(spark)}/graphlens/{name}-{uuid.uuid4().hex}"
    write = df.write.option("compression", compression)
    _WRITTEN.append(path)
    (write.partitionBy(by) if by else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end what materialize wrote inside, but for the table last written when
    the function given is called on it; shuffles that nothing refers to any more go too."""
    start = len(_WRITTEN)
    kept = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_WRITTEN[-1])
        return df

    try:
        yield keep
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _WRITTEN[start:]:
            if path not in kept:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        _WRITTEN[start:] = sorted(kept)
        gc.collect()
        jvm.System.gc()


def ranked(df: DataFrame, keys: list, name: str, size: str | None = None) -> DataFrame:
    """df with `rank` (long, from 0) in the order of keys, without any one-task sort; with
    `size` also `start`, the sum of that column over all earlier rows.

    Range-partitions by the keys, writes the sorted runs once with (part, idx), then adds
    each part's offset, a table with one row per partition.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    runs = runs.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid")
    runs = materialize(runs, name)
    amount = F.coalesce(F.sum(size), F.lit(0)) if size else F.lit(0)
    offsets = runs.groupBy("_part").agg(F.count("*").alias("_n"), amount.cast("long").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_size")))
    # One row per shuffle partition: bounded by the partition count.
    out = runs.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_n_before") + F.col("_idx"))
    if size:
        inside = Window.partitionBy("_part").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("start", F.col("_size_before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return out.drop("_n_before", "_size_before", "_part", "_idx")


# --- Arrow and numpy -------------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with about `limit` bytes of text each; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            to = min(to, at + MAX_ROWS, batch.num_rows)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    odd = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    byte = np.arange(256)
    word = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((fold >= 97) & (fold <= 122))
    return odd, fold, word


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, list[np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = have = out
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each maximal run of true bytes; none crosses a row's end."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offs, start, "right") - 1, start, end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word, with A-Z lower-cased, in text order."""
    odd, fold, is_word = _tables()
    row, start, end = runs(is_word[data], offs)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(odd[fold[data]] * up[: len(data)], out=sums[1:])
    return row, start, end, mix((sums[end] - sums[start]) * down[start])


def shingles(row: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of each run of k words of a row; a row with fewer words, but
    not none, gives one shingle of all its words."""
    n = len(hashes)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    out = np.zeros(n, np.uint64)
    pad = np.r_[hashes, np.zeros(k, np.uint64)]
    at = np.arange(n) - np.repeat(first, count)
    left = np.repeat(count, count) - at
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + np.where(left > j, pad[j : j + n], U64(0))
    keep = (left >= k) | ((at == 0) & (left < k))
    out = mix(out + np.minimum(left, k).astype(np.uint64))
    return row[keep], np.flatnonzero(keep), out[keep]


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x ^ U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """In (0, 1), a function of x and seed."""
    return ((seeded(x, seed) >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)


#: A term is known by the top 54 bits of its hash.
TERM_BITS = 54


def distinct_terms(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of each distinct term of a row, sorted by row and term."""
    key, times = np.unique((row.astype(np.uint64) << U64(TERM_BITS)) | (hashes >> U64(64 - TERM_BITS)), return_counts=True)
    return (key >> U64(TERM_BITS)).astype(np.int64), key & U64((1 << TERM_BITS) - 1), times


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, so that their zero bytes go away."""
    gaps = np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.ascontiguousarray(gaps).tobytes() + np.ascontiguousarray(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    n = len(raw) // 12
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def term_counts(docs: DataFrame, distinct: bool, min_share: float = 0.0, total: int = 0) -> DataFrame:
    """(term long, n long): in how many texts (distinct) or how often each word occurs.

    Counted over every whole text.  Each task merges its own counts and sends them as
    packed runs, one for each range of hashes, so no key can be hot; terms below
    max(2, min_share * total) are left out of the result only after the full count.
    """
    spark = docs.sparkSession
    bits = max(4, int(np.ceil(np.log2(8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    least = max(2, int(np.ceil(min_share * total)))

    def emit(parts: list) -> Iterator[pa.RecordBatch]:
        keys, counts = merge_counts(parts)
        cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << U64(TERM_BITS - bits))
        cuts = np.r_[cuts, len(keys)]
        out = [(b, pack(keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]])) for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, data, offs in chunks(batches):
            row, _, _, h = words(data, offs)
            if distinct:
                h = distinct_terms(row, h)[1]
            else:
                h = h >> U64(64 - TERM_BITS)
            keys, n = np.unique(h, return_counts=True)
            parts.append((keys, n.astype(np.int64)))
            held += len(keys)
            if held > 3_000_000:
                parts = [merge_counts(parts)]
                held = len(parts[0][0])
                if held > 2_000_000:
                    yield from emit(parts)
                    parts, held = [], 0
        yield from emit(parts)

    def add(pdf):
        import pandas as pd

        keys, counts = merge_counts([unpack(x) for x in pdf["packed"]])
        keep = counts >= least
        return pd.DataFrame({"term": keys[keep].astype(np.int64), "n": counts[keep]})

    return docs.select("text").mapInArrow(count, "bucket int, packed binary").groupBy("bucket").applyInPandas(add, "term long, n long")


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def collect_terms(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A term table on the driver, behind a check of its size: more than `limit` rows is
    an error, for the caller's share bounds it (see each caller)."""
    rows = counts.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"more than {limit} terms; raise the least share of documents")
    keys, n = rows.column("term").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]
