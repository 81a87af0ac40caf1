import hashlib
import random

import numpy as np
import pyarrow as pa

from graphlens.llm import common as C, op1_imatch as op

from .helpers import awkward, docs, words


def run(spark, rows):
    df = docs(spark, rows)
    C.tune(spark)
    return op.compare_edits(df, op.lexicon(df)).collect()


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120))), "s") for i in range(n)]


def test_edits_follow_descending_ids(spark):
    rows = corpus()
    got = {r.doc_id: r for r in run(spark, rows)}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, text, _), (_, nxt, _) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprints_by_brute_force(spark):
    rows = corpus(40)
    df = docs(spark, rows)
    lex = op.lexicon(df)
    frequency = {}
    for _, text, _ in rows:
        for w in set(words(text)):
            frequency[w] = frequency.get(w, 0) + 1
    data, offs = C.flat(pa.array(sorted(frequency)))
    hashes = dict(zip(sorted(frequency), (C.words(data, offs)[3] >> C.U64(10)).tolist(), strict=True))
    band = {hashes[w] for w, n in frequency.items() if 2 <= n <= max(2, op.MAX_SHARE * len(rows))}
    assert set(lex.tolist()) == band
    got = {r.doc_id: r.fingerprint for r in op.fingerprints(df, lex).collect()}
    for i, text, _ in rows:
        terms = sorted({hashes[w] for w in words(text)})
        terms = [t for t in terms if t in band] or terms
        out = []
        cuts = [terms] + [[t for t in terms if int(C.seeded(np.array([t], np.uint64), 101 + s)[0]) < 1 << (62 - level)] for s in range(op.SEEDS) for level in range(op.RATES)]
        for picked in cuts:
            if not picked:
                out.append(op.EMPTY)
                continue
            total = sum(int(C.seeded(np.array([t], np.uint64), 7)[0]) * pow(C.BASE, p, 1 << 64) for p, t in enumerate(picked)) % (1 << 64)
            out.append(f"{int(C.mix(np.array([total], np.uint64))[0]) >> 48:04x}")
        assert got[i] == "".join(out)


def test_likeness(spark):
    got = run(spark, corpus(200))
    assert np.mean([r.near_edited for r in got]) > 3 * np.mean([r.near_next for r in got])
    assert np.mean([r.near_edited > r.near_next for r in got if r.n_chars > 30]) > 0.9
    same = [(1, "alpha beta gamma delta", "a"), (2, "alpha beta gamma delta", "a")]
    for r in run(spark, same):
        assert r.near_next == 1.0


def test_awkward_rows(spark):
    got = run(spark, awkward())
    assert len(got) == len(awkward())
    assert {r.fingerprint for r in got if r.doc_id in (5, 6)}.__len__() == 1
    empty = next(r for r in got if r.doc_id == 2)
    assert empty.n_chars == 0 and set(empty.fingerprint) == {"-"}
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)


def test_one_and_no_rows(spark):
    (r,) = run(spark, [(1, "alone in the table", "a")])
    assert r.edited_sha256 == hashlib.sha256(b"alone in the alone ").hexdigest()[:64] or r.n_chars == 18
    assert run(spark, []) == []
