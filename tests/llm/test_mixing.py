import hashlib
import random

import pytest

from graphlens.llm import common as C, op2_mixing as op

from .helpers import awkward, docs


def plain_targets(sizes):
    """Targets by water filling, one cap at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: op.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= 3 * sizes[s]}
        if not full:
            out |= {s: weight[s] * share for s in open_}
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(spark, rows):
    got = op.mixed(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(op_words(t))
    want = plain_targets(sizes)
    taken = {}
    by_source = sorted({(r.source_size, round(r.target, 6)) for r in got})
    assert by_source == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[(r.source_size, r.target)] = taken.get((r.source_size, r.target), 0) + r.taken
    # The queues' order and the budget decide, and nothing else does.
    served = plain_queue(rows, sizes, want)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(i), len(op_words(t)), n) for (i, t, _), n in zip(rows, served, strict=True))
    assert sum(r.taken for r in got) == sum(sizes.values())
    if len({(sizes[s], want[s]) for s in sizes}) == len(sizes):
        # What other sources leave to their next documents is served beyond the targets.
        largest = sum(max(len(op_words(t)) for _, t, x in rows if x == s) for s in sizes)
        for (_, target), n in taken.items():
            assert abs(n - target) <= largest
    return got


def plain_queue(rows, sizes, want):
    """Words taken of each row: all copies by finish time, until the budget is served."""
    digest = lambda i: hashlib.md5((op.SEED + ("" if i is None else str(i))).encode()).hexdigest()
    size = [len(op_words(t)) for _, t, _ in rows]
    order = sorted((k for k in range(len(rows)) if size[k]), key=lambda k: (digest(rows[k][0]), size[k]))
    at, served = {}, []
    for copy in range(3):
        for k in order:
            source = rows[k][2]
            at[source] = at.get(source, 0) + size[k]
            served.append((at[source] / want[source], digest(rows[k][0]), size[k], copy, k))
    left, taken = sum(sizes.values()), [0] * len(rows)
    for *_, words, _, k in sorted(served):
        taken[k] += min(words, left)
        left -= min(words, left)
    return taken


def op_words(text):
    import re

    return re.findall(op.SIZE_RE, text or "")


def test_targets_are_met(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 50), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(300)] + [(900, "tiny", None)]
    first = check(spark, rows)
    assert sorted(map(tuple, first)) == sorted(map(tuple, op.mixed(docs(spark, rows)).collect()))


def test_one_repeated_row_is_split(spark):
    """A third of all rows are one row: neither order puts them into one task."""
    rows = [(7, "a b c", "x")] * 400 + [(None, "d e", "y")] * 300 + [(i, "w " * (i % 9), "z") for i in range(500)]
    check(spark, rows)


def test_one_source_takes_all(spark):
    got = check(spark, [(1, "a b c", "x"), (2, "d", "x")])
    assert sum(r.taken for r in got) == 4


@pytest.mark.parametrize("rows", [awkward(), [(1, None, None)], [(1, "", "a"), (2, None, "b")]])
def test_awkward_rows(spark, rows):
    check(spark, rows)


def test_empty_table(spark):
    assert op.mixed(docs(spark, [])).collect() == []


def test_order_is_a_queue(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(200)]
    sized = op.sized(docs(spark, rows))
    order = op.mix(sized, C.materialize(op.targets(sized), "t")).orderBy("offset").collect()
    at = 0
    for r in order:
        assert r.offset == at
        at += r.words
    assert [r.finish for r in order] == sorted(r.finish for r in order)
