import random

import numpy as np

from graphlens.llm import op5_tokens as op

from .helpers import awkward, docs


def test_scan_stitches_blocks(spark):
    rng = random.Random(4)
    want, rows = {}, []
    for file in range(6):
        stream, lengths = [], []
        for _ in range(rng.choice([0, 1, 40])):
            n = rng.choice([0, 0, 1, 3, 60])
            stream += [rng.randint(0, 9) for _ in range(n)] + [op.END_OF_DOCUMENT]
            lengths.append((n, True))
        tail = rng.choice([0, 0, 7, 50])
        if tail:
            stream += [1] * tail
            lengths.append((tail, False))
        want |= {(file, i): x for i, x in enumerate(lengths)}
        a = np.array(stream, "<u2")
        rows += [(file, b, a[at : at + 8].tobytes()) for b, at in enumerate(range(0, len(a), 8))]
    rng.shuffle(rows)
    blocks = spark.createDataFrame(rows, "file int, block int, tokens binary")
    got = {(r.file, r.ordinal): (r.n_tokens, r.ended) for r in op.scan(blocks).collect()}
    assert got == want


def test_counts_are_those_of_the_tokenizer(spark):
    rows = awkward()
    encode = op._encoder(op.vocabulary_path()).encode_ordinary
    blocks, order = op.write_flat(docs(spark, rows), block=64)
    ids = {(r.file, r.first + i): d for r in order.collect() for i, d in enumerate(r.doc_ids)}
    got = sorted((str(ids[r.file, r.ordinal]), r.n_tokens) for r in op.scan(blocks).collect() if r.ended)
    assert got == sorted((str(i), len(encode(t or ""))) for i, t, _ in rows)


def test_flat_binary_files(spark, tmp_path):
    a = np.array([5, 6, op.END_OF_DOCUMENT, op.END_OF_DOCUMENT, 7, 8, 9], "<u2")
    (tmp_path / "x.bin").write_bytes(a.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (1, 2, 3, 100):
        got = sorted((r.ordinal, r.n_tokens, r.ended) for r in op.scan(op.read_flat(spark, str(tmp_path), block)).collect())
        assert got == [(0, 2, True), (1, 0, True), (2, 3, False)]


def test_empty_table(spark):
    blocks, order = op.write_flat(docs(spark, []))
    assert op.scan(blocks).collect() == [] and order.collect() == []
