"""Token counts by separator scan.

Flat token files hold 16-bit token ids, documents one after another, each ended by the
end-of-document id, without any index.  Every block of a file is searched for the
separator at once (numpy); a block knows only what lies between its own separators.  A
prefix scan over a file's blocks then carries the tokens since the last separator, and
the number of documents ended, into the next block, so that documents that cross one
or many blocks come out whole.

Defined results: a null or empty text has 0 tokens; repeated rows each have their place;
null doc_id is kept; tokens after a file's last separator form a last document with
ended false; an empty file or table gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import common as C

END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 17
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, path: str | None = None, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(blocks, order): the documents as flat token files, one a task, and their order in
    them.  blocks: (file, block, tokens binary); order: (file, first, doc_ids)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = _encoder(path).encode_ordinary, TaskContext.get().partitionId()
        held, n, number, first = [], 0, 0, 0

        def row(number, tokens, first, ids):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([tokens], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "tokens", "first", "doc_ids"])

        for rows, _, _ in C.chunks(batches):
            ids = rows.column(0).to_pylist()
            for text in rows.column(1).to_pylist():
                held.append(np.array([*(encode(text) if text else ()), END_OF_DOCUMENT], np.uint16))
                n += len(held[-1])
            if n >= block:
                flat = np.concatenate(held)
                full = n // block * block
                for at in range(0, full, block):
                    yield row(number, flat[at : at + block].astype("<u2").tobytes(), None, None)
                    number += 1
                held, n = [flat[full:]], n - full
            yield row(None, None, first, ids)
            first += len(ids)
        if n:
            yield row(number, np.concatenate(held).astype("<u2").tobytes(), None, None)

    C.tune(docs.sparkSession)
    both = C.materialize(docs.select("doc_id", "text").mapInArrow(run, "file int, block int, tokens binary, first long, doc_ids array<long>"), "tokens")
    return both.filter("block is not null").select("file", "block", "tokens"), both.filter("block is null").select("file", "first", "doc_ids")


def read_flat(spark: SparkSession, path: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat binary token files in a folder; file is the path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content").filter("length > 0")
    count = F.ceil(F.col("length") / (2 * block)).cast("int")
    files = files.select("file", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    return files.select("file", "block", F.substring("content", F.col("block") * (2 * block) + 1, F.lit(2 * block)).alias("tokens"))


def scan(blocks: DataFrame, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """The operator: (file, ordinal, n_tokens, ended) of each document of each file."""
    C.tune(blocks.sparkSession)
    kind = blocks.schema["file"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n, seps, tail, lengths = [], [], [], []
            for tokens in rows.column(2):
                a = np.frombuffer(tokens.as_buffer() or b"", "<u2")
                at = np.flatnonzero(a == separator)
                n.append(len(a))
                seps.append(len(at))
                tail.append(len(a) - int(at[-1]) - 1 if len(at) else len(a))
                lengths.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(x, pa.int64()) for x in (n, seps, tail)), pa.array(lengths, pa.list_(pa.int64()))], names=["file", "block", "n", "seps", "tail", "lengths"])

    found = blocks.select("file", "block", "tokens").mapInArrow(search, f"file {kind}, block int, n long, seps long, tail long, lengths array<long>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("base", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.withColumn("last_end", F.when(F.col("seps") > 0, F.col("at") + F.col("n") - F.col("tail")))
    found = found.withColumn("carry", F.col("at") - F.coalesce(F.max("last_end").over(before), F.lit(0)))
    found = found.withColumn("open", F.when(F.lead("block").over(order).isNull(), F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("n"))))
    ended = found.select("file", "base", "carry", F.posexplode("lengths").alias("p", "length"))
    ended = ended.select("file", (F.col("base") + F.col("p")).alias("ordinal"), (F.col("length") + F.when(F.col("p") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = found.filter("open > 0").select("file", (F.col("base") + F.col("seps")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, order = write_flat(C.read(spark, sf_dir, "documents"))
    ids = order.select("file", "first", F.posexplode("doc_ids").alias("p", "doc_id")).select("file", (F.col("first") + F.col("p")).alias("ordinal"), "doc_id")
    return scan(blocks).join(ids, ["file", "ordinal"]).select("doc_id", "n_tokens")
