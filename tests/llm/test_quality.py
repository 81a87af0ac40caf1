import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa

from graphlens.llm import common as C, op4_quality as op

from .helpers import awkward, docs, fold


def corpus(seed=2, n=400):
    rng = random.Random(seed)
    syllables = ["the", "an", "er", "on", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows, quality = [], {}
    for i in range(n):
        ws = [word() for _ in range(rng.randint(3, 200))]
        junk = i % 7 == 0
        kind = i // 7 % 3
        if junk:
            ws = [w.upper() + "!!" for w in ws] if kind == 0 else [w + " |" for w in ws] if kind == 1 else [ws[0]] * (10 + len(ws))
        rows.append((i, " ".join(ws).capitalize() if not junk else " ".join(ws), "a"))
        quality[i] = 0 if junk else 1
    return rows, quality


def labels(spark, quality, some):
    return spark.createDataFrame([(i, quality[i], 0) for i in some], "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    rows, quality = corpus()
    seen = [i for i in quality if i % 2]
    got = {r.doc_id: r.kept for r in op.resample(docs(spark, rows), labels(spark, quality, seen)).collect()}
    held = [i for i in quality if not i % 2]
    assert len(got) == len(rows)
    assert np.mean([got[i] for i in held if quality[i]]) == 1.0
    assert np.mean([got[i] for i in held if not quality[i]]) <= 0.1


def test_weights_by_brute_force(spark):
    rows, quality = corpus(n=60)
    df = docs(spark, rows)
    ratio = op.fit(df, labels(spark, quality, list(quality)))
    raw, target = np.ones(op.SIZE), np.zeros(op.SIZE)
    own = {}
    for i, text, _ in rows:
        data, offs = C.flat(pa.array([text]))
        _, bucket, _ = op.features(data, offs)
        own[i] = bucket
        np.add.at(raw, bucket, 1)
        if quality[i]:
            np.add.at(target, bucket, 1)
    for f in range(op.FAMILIES):
        at = slice(f << op.BITS, (f + 1) << op.BITS)
        expected = raw[at] / raw[at].sum() * target[at].sum()
        added = op.ADDED + op.ADDED_SHARE * target[at].sum()
        assert np.allclose(ratio[at], np.log((target[at] + added) / (expected + added)))
    for r in op.score(df, ratio).collect():
        assert abs(r.log_weight - ratio[own[r.doc_id]].sum()) < 1e-4


def plain_grams(text):
    """The n-grams as strings, without any hashing."""
    tokens = [t for t in re.split("[\\x20\\x09-\\x0d]+", text) if t]
    folded = [fold(t) for t in tokens]
    kind = lambda c: "d" if c.isdigit() else "u" if "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" else "l" if "a" <= c <= "z" or ord(c) > 127 else c
    shapes = ["".join(k for k, _ in itertools.groupby(map(kind, t))) for t in tokens]
    again = [a == b for a, b in itertools.pairwise(folded)]
    return [folded, list(itertools.pairwise(folded)), shapes, list(zip(shapes, shapes[1:], again, strict=False))]


def test_scores_by_plain_ngrams(spark):
    rows, quality = corpus(n=150)
    got = {r.doc_id: r.score for r in op.score(docs(spark, rows), op.fit(docs(spark, rows), labels(spark, quality, list(quality)))).collect()}
    grams = {i: plain_grams(t) for i, t, _ in rows}
    weight = dict.fromkeys(grams, 0.0)
    for f in range(4):
        raw = collections.Counter(x for g in grams.values() for x in g[f])
        target = collections.Counter(x for i, g in grams.items() if quality[i] for x in g[f])
        n, added = target.total(), op.ADDED + op.ADDED_SHARE * target.total()
        for i, g in grams.items():
            weight[i] += sum(math.log((target[x] + added) / ((raw[x] + 1) / (raw.total() + (1 << op.BITS)) * n + added)) for x in g[f])
    want = [weight[i] / (len(grams[i][0]) + op.PRIOR) for i in sorted(grams)]
    have = [got[i] for i in sorted(grams)]
    # Only n-grams that share a bucket differ.
    assert np.corrcoef(want, have)[0, 1] > 0.999 and np.quantile(np.abs(np.array(want) - have), 0.9) < 0.15


def keyed(spark, scores):
    ids = np.arange(len(scores), dtype=np.uint64)
    keys = np.array(scores) / op.TEMPERATURE + op.gumbel(ids)
    return spark.createDataFrame([(int(i), 0, float(s), float(k)) for i, s, k in zip(ids, scores, keys, strict=True)], "doc_id long, digest long, score double, sample_key double")


def test_the_draw_follows_the_weights(spark):
    heavy = op.TEMPERATURE * math.log(3)
    rows = op.draw(keyed(spark, [0.0, heavy] * 10_000), 1000).filter("kept").collect()
    assert len(rows) == 1000
    assert abs(sum(r.score > 0 for r in rows) - 750) < 60  # four standard deviations


def test_noise_decides_among_close_scores(spark):
    """Without the noise the best scores would be the sample."""
    rows, quality = corpus(n=300)
    got = op.resample(docs(spark, rows), labels(spark, quality, list(quality)), k=120).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {r.doc_id for r in sorted(got, key=lambda r: -r.sample_key)[:120]}
    assert 10 < len(kept - {r.doc_id for r in sorted(got, key=lambda r: -r.score)[:120]}) < 110
    assert all(quality[i] for i in kept)


def test_sample_size_by_labels(spark):
    assert op.parting(np.array([-3.0, -2, 1, 2]), np.array([False, False, True, True])) == -0.5
    assert op.parting(np.array([-3.0, 1, -2, 2]), np.array([False, False, True, True])) == -2.5
    assert op.parting(np.array([1.0, 1.0]), np.array([True, True])) == float("-inf")
    rows, quality = corpus(n=200)
    got = op.resample(docs(spark, rows), labels(spark, quality, list(quality))).collect()
    cut = op.parting(np.array([r.score for r in got]), np.array([quality[r.doc_id] == 1 for r in got]))
    assert sum(r.kept for r in got) == sum(r.score >= cut for r in got)


def test_awkward_rows_and_labels(spark):
    df = docs(spark, awkward())
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, None), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = op.resample(df, odd).collect()
    assert len(got) == len(awkward())
    none = odd.limit(0)
    assert all(r.kept for r in op.resample(df, none).collect())
    assert op.resample(docs(spark, []), odd).collect() == []
