import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from graphlens.llm import common as C, op6_suffix as op

from .helpers import awkward, docs, words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(s):
    assert op.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def lyndon_prefix(s):
    return max(k for k in range(1, len(s) + 1) if all(s[:k] < s[i:k] for i in range(1, k)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=30))
def test_groups_are_lyndon_prefixes(s):
    group, ordered, length = op.lyndon_groups(s)
    rank = {g: i for i, g in enumerate(ordered)}
    prefix = [tuple(s[i : i + lyndon_prefix(s[i:])]) for i in range(len(s))]
    assert length == [len(p) for p in prefix]
    order = {p: i for i, p in enumerate(sorted(set(prefix)))}
    used = sorted({rank[g] for g in group})
    assert [used.index(rank[g]) for g in group] == [order[p] for p in prefix]


def test_linear_on_hard_strings():
    for s in ([1] * 20_000, [1, 0] * 10_000, list(range(20_000)), list(range(20_000, 0, -1))):
        assert len(op.suffix_array(s)) == len(s)


def plain(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(x[i : i + op.LENGTH] for x in texts for i in range(len(x) - op.LENGTH + 1))
    out = []
    for (doc_id, _, _), x in zip(rows, texts, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - op.LENGTH + 1):
            if seen[x[i : i + op.LENGTH]] > 1:
                gone[i : i + op.LENGTH] = b"\1" * op.LENGTH
        spans = sum(1 for i in range(len(x)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((doc_id, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted((r + p for r, p in zip(out, plain_passages(rows), strict=True)), key=str)


def plain_passages(rows):
    n = op.WORDS.length
    texts = [words(t) for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    out = []
    for w in texts:
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        out.append((sum(1 for i in range(len(w)) if hit[i] and (not i or not hit[i - 1])), sum(hit)))
    return out


def run(spark, rows):
    return sorted((tuple(r) for r in op.report(docs(spark, rows)).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(90) for _ in range(5)] + ["ab" * 300, "x" * 450]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, rng.randint(0, 60)])
            parts += [p[cut : len(p) - rng.choice([0, rng.randint(0, 90)])], text(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", ""]).join(parts), "a"))
    base = text(300)
    for i in range(40, 60):  # near copies
        ws = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = word()
        rows.append((i, " ".join(ws), "a"))
    return [*rows, (60, rows[0][1], "a"), (61, rows[5][1] * 2, "a")]


def test_by_brute_force(spark):
    for seed in (1, 2):
        assert run(spark, corpus(seed)) == plain(corpus(seed))


def test_hot_cores_are_halved(spark, monkeypatch):
    rows = corpus(3)
    for bound in (1, 3):
        monkeypatch.setattr(op, "BOUND", bound)
        assert run(spark, rows) == plain(rows)


def test_passages_with_other_spacing(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(55)
    rows = [(1, " ".join(text(30) + passage + text(30)), "a"), (2, ",\n".join(text(20) + [w.upper() for w in passage]), "a"), (3, " ".join(text(100) + passage[:49]), "a"), (4, " ".join(text(60)), "a")]
    got = run(spark, rows)
    assert got == plain(rows)
    assert [r[5:] for r in got] == [(1, 55), (1, 55), (0, 0), (0, 0)] and all(r[2] == 0 for r in got)


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 500)
    rows = corpus(4)[:20]
    assert run(spark, rows) == plain(rows)


def test_runs_do_not_depend_on_segments(monkeypatch):
    data = C._tables()[0][np.frombuffer(random.Random(5).randbytes(3000), np.uint8)]
    whole = [x.tolist() for x in op.runs(data)]
    for size in (100, 500, 777):
        monkeypatch.setattr(op, "SEGMENT", size)
        assert [x.tolist() for x in op.runs(data)] == whole


def test_unique_long_text_keeps_all(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=650_000))
    passage = long[op.SEGMENT - 300 : op.SEGMENT + 300]  # a repeat over the cut is still found
    other = "".join(rng.choices("abcdefgh ", k=650_000))
    rows = [(1, long, "a"), (2, other, "a"), (3, "x" + passage + "y", "a")]
    got = {r.doc_id: r for r in op.report(docs(spark, rows)).collect()}
    assert (got[2].n_removed, got[2].n_spans) == (0, 0)
    assert got[2].kept_sha256 == hashlib.sha256(other.encode()).hexdigest()
    assert (got[1].n_removed, got[1].n_spans, got[3].n_removed) == (600, 1, 600)


def test_awkward_rows(spark):
    rows = [r for r in awkward() if len(r[1] or "") < 10_000]
    assert run(spark, rows) == plain(rows)
    assert len(run(spark, awkward())) == len(awkward())
    assert run(spark, []) == []
