import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphlens.llm import common as C, op8_neardup as op

from .helpers import awkward, docs, words


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows = [(i, " ".join(text(rng.randint(1, 150))), "a") for i in range(120)]
    i = 120
    for _ in range(15):
        base = text(rng.randint(30, 200))
        for _ in range(rng.randint(2, 12)):
            ws = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            rows.append((i, " ".join(ws), "a"))
            i += 1
    shared = " ".join(text(60))  # a passage of many texts makes none of them copies
    rows += [(i + k, " ".join(text(90)) + " " + shared + " " + " ".join(text(90)), "a") for k in range(30)]
    rng.shuffle(rows)
    return rows


def plain_classes(rows, total=None):
    n = len(rows)
    df = Counter(w for _, t, _ in rows for w in set(words(t)))
    least = max(1.0, op.MIN_SHARE * n)
    most = 1 + np.log(max(n, 1) / least)
    idf = lambda w: round(op.SCALE * (0.5 + 0.5 * (1 + np.log(n / max(df[w], least))) / most)) if df[w] >= 2 else op.SCALE
    sets = []
    for _, t, _ in rows:
        ws, c = words(t), Counter()
        for i in range(max(1, len(ws) - 4) if ws else 0):
            s = tuple(ws[i : i + 5])
            c[s] += sum(idf(w) for w in s) / len(s)
        sets.append(c)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            if not same and sets[a] and sets[b]:
                common = sum(min(w, sets[b][s]) for s, w in sets[a].items() if s in sets[b])
                same = common >= op.SIMILARITY * (sum(sets[a].values()) + sum(sets[b].values()) - common)
            if same:
                parent[find(a)] = find(b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    low = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted(((rows[i][0], low[find(i)]) for i in range(n)), key=str)


def run(spark, rows):
    return sorted(((r.doc_id, r.class_id) for r in op.classes(docs(spark, rows)).collect()), key=str)


def test_classes_by_brute_force(spark):
    assert run(spark, corpus()) == plain_classes(corpus())


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 3)
    assert run(spark, corpus(2)) == plain_classes(corpus(2))


def test_blocks_by_shingles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_SHINGLES", 400)
    assert run(spark, corpus(4)) == plain_classes(corpus(4))


def test_a_large_bucket_costs_about_its_rows(spark):
    """Not the pairs of its blocks: strays alone meet all of them."""
    n = 20 * op.BLOCK
    members = spark.range(n).select(F.lit(5).cast("long").alias("bucket"), F.xxhash64("id").alias("rep"), F.lit(10).cast("long").alias("size"))
    rows = C.materialize(op.bucketed(members), "m")
    dealt = op.blocks(rows)
    assert dealt.count() == n + 19 and dealt.groupBy("pair").count().agg(F.max("count")).first()[0] < 1.3 * op.BLOCK
    low = rows.agg(F.min("rep")).first()[0]
    roots = rows.filter(F.col("rep") != low).select(F.col("rep").alias("node"), F.lit(low).alias("root"))
    assert op.strays(rows, roots).count() == 0
    few = op.strays(rows, roots.filter(F.pmod("node", F.lit(n // 4)) > 5))
    assert n <= few.count() < 1.2 * n and few.groupBy("pair").count().agg(F.max("count")).first()[0] < 1.5 * op.BLOCK


def test_recall_of_near_copies(spark):
    """Pairs of similarity 0.8 or more, by plain five-word Jaccard, end in one class."""
    rng = random.Random(12)
    word = lambda: f"w{min(rng.randrange(3000), rng.randrange(3000))}"
    rows = []
    for g in range(60):
        base = [word() for _ in range(rng.randint(40, 300))]
        for k in range(4):
            ws = list(base)
            for _ in range(round(len(ws) * rng.choice([0, 0.005, 0.01, 0.02]))):
                ws[rng.randrange(len(ws))] = word()
            rows.append((4 * g + k, " ".join(ws), "a"))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t, _ in rows}
    near = [(a, b) for a in sets for b in sets if a < b and a // 4 == b // 4 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    classes = dict(run(spark, rows))
    assert len(near) > 150
    assert np.mean([classes[a] == classes[b] for a, b in near]) >= 0.97
    assert all(classes[a] // 4 == a // 4 for a in classes)


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 1 << 54, 400, dtype=np.uint64)
    wa, wb = rng.uniform(1, 5, 400), rng.uniform(1, 5, 400)
    wa[:60], wb[340:] = 0, 0
    agree = []
    for k in range(60):
        e = C.mix(element + C.U64(k)) >> C.U64(10)
        draw = [op.samples(np.zeros(int((w > 0).sum()), np.int64), np.sort(e[w > 0]), w[w > 0][np.argsort(e[w > 0])], 1)[0] for w in (wa, wb)]
        agree.append(np.mean(draw[0] == draw[1]))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs(np.mean(agree) - want) < 0.04


def test_link_matrix():
    a = (np.array([1, 2, 3, 4, 5], np.uint64), np.ones(5))
    b = (np.array([1, 2, 3, 4, 6], np.uint64), np.ones(5))
    c = (np.array([1, 2, 3, 4], np.uint64), np.ones(4))
    assert op.linked([a, b]).tolist() == [0, 1]
    assert op.linked([a, b, c]).tolist() == [0, 0, 0]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in parent if find(x) != x}
    assert {r.node: r.root for r in op.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_representatives(spark):
    rows = corpus(3)
    classes = dict(plain_classes(rows))
    kept = op.representatives(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(classes.values()))
    assert kept[0].bucket == "x"


def test_awkward_rows(spark):
    assert run(spark, awkward()) == plain_classes(awkward())
    kept = op.representatives(docs(spark, awkward())).collect()
    # One text of each class: the empty ones, the short ones, and each other text.
    assert len(kept) == len({c if c is not None else f"-{t}" for (i, c), t in zip(plain_classes(awkward()), range(99), strict=False)})
    assert run(spark, []) == [] and op.representatives(docs(spark, [])).collect() == []


def test_different_texts_of_one_doc_id(spark):
    rng = random.Random(8)
    a, b, c = ([f"{x}{rng.randrange(3000)}" for _ in range(100)] for x in "abc")
    near = lambda ws: " ".join([*ws[:50], "edit", *ws[51:]])
    # Links of one text of doc_id 7 say nothing of its other texts.
    rows = [(7, " ".join(a), "a"), (7, " ".join(b), "a"), (7, " ".join(c), "a"), (7, " ".join(c), "a"), (8, near(a), "a"), (3, near(b), "a")]
    assert run(spark, rows) == plain_classes(rows) == [(3, 3), (7, 3), (7, 7), (7, 7), (7, 7), (8, 7)]
    kept = sorted((r.doc_id, r.text) for r in op.representatives(docs(spark, rows)).collect())
    assert kept == sorted([(3, near(b)), (7, " ".join(a)), (7, " ".join(c))])


def test_near_copies_without_ids(spark):
    ws = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join([*ws[:i], "edit", *ws[i + 1 :]]), "a") for i in (20, 50, 80)]
    assert len(op.representatives(docs(spark, [*rows, (None, "another text", "a")])).collect()) == 2


def test_arrow_offsets():
    column = pa.array(["a b", None, "c"]).slice(1)
    data, offs = C.flat(column)
    assert bytes(data) == b"c" and offs.tolist() == [0, 0, 1]
