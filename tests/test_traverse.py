"""Closures, paths and cycles against plain models."""

import random

import pytest

from graphlens.operators import traverse
from graphlens.schema import CALL_KINDS, CONE_KINDS, IMPACT_KINDS


def graph(spark, edges):
    rows = [(a, k, b, "parser_extract", 80) for a, k, b in edges]
    return spark.createDataFrame(rows, "source_node_id string, kind string, target_node_id string, provenance string, confidence int")


def random_edges(seed, n=14, m=26):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", rng.choice([*IMPACT_KINDS, "imports"]), f"n{rng.randrange(n):02d}") for _ in range(m)]


def closure(edges, start, kinds, backward, depth=None):
    steps = [(b, a) if backward else (a, b) for a, k, b in edges if kinds is None or k in kinds]
    seen, frontier, d = {}, {start}, 0
    while frontier and (depth is None or d < depth):
        d += 1
        frontier = {b for a, b in steps if a in frontier} - seen.keys()
        seen |= dict.fromkeys(frontier, d)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_closures(spark, seed):
    edges = random_edges(seed)
    e = graph(spark, edges)
    pairs = lambda df: {r.node_id: r.depth for r in df.collect()}
    assert pairs(traverse.impact(e, "n03")) == closure(edges, "n03", IMPACT_KINDS, True)
    assert pairs(traverse.impact(e, "n03", 2)) == closure(edges, "n03", IMPACT_KINDS, True, 2)
    assert pairs(traverse.forward_impact(e, "n03")) == closure(edges, "n03", None, False)
    assert pairs(traverse.forward_impact(e, "n03", 0)) == {}
    assert pairs(traverse.dependency_cone(e, "n05")) == closure(edges, "n05", CONE_KINDS, True)


def test_seed_only_on_a_cycle(spark):
    e = graph(spark, [("a", "calls", "b"), ("b", "calls", "a"), ("c", "calls", "a")])
    assert {r.node_id for r in traverse.impact(e, "a").collect()} == {"a", "b", "c"}
    assert {r.node_id for r in traverse.impact(e, "c").collect()} == set()
    assert traverse.impact(e, "nobody").count() == 0


def test_long_chains_compact(spark, monkeypatch):
    monkeypatch.setattr(traverse, "COMPACT", 2)
    e = graph(spark, [(f"n{i:02d}", "calls", f"n{i + 1:02d}") for i in range(9)])
    assert traverse.forward_impact(e, "n00").count() == 9
    assert traverse.trace(e, "n00", "n09").first().length == 9
    assert traverse.trace(e, "n00", "n09", 8).count() == 0


def shortest(edges, start, end, kinds):
    steps = sorted({(a, b) for a, k, b in edges if kinds is None or k in kinds})
    paths = {start: [start]}
    frontier = {start: [start]}
    while frontier and end not in paths:
        new = {}
        for a, b in steps:
            if a in frontier and b not in paths:
                p = frontier[a] + [b]
                new[b] = min(new.get(b, p), p)
        paths |= new
        frontier = new
    return paths.get(end)


def test_shortest_paths(spark):
    for seed in (5, 6):
        edges = random_edges(seed, 10, 22)
        e = graph(spark, edges)
        for a, b, kinds in (("n00", "n07", None), ("n02", "n05", CALL_KINDS)):
            want = shortest(edges, a, b, kinds) if a != b else [a]
            got = traverse.shortest_path(e, a, b, kinds).collect()
            assert [(r.path, r.length) for r in got] == ([(want, len(want) - 1)] if want else [])
    assert [tuple(r) for r in traverse.trace(graph(spark, []), "x", "x").collect()] == [(["x"], 0)]


def components(edges):
    steps = {(a, b) for a, k, b in edges if k == "calls"}
    nodes = {x for s in steps for x in s}
    reach = {n: set(closure(edges, n, ("calls",), False)) for n in nodes}
    out = set()
    for n in nodes:
        group = {m for m in reach[n] if n in reach[m]}
        if n in reach[n]:
            out.add((min(group), n))
    return out


@pytest.mark.parametrize("seed", (1, 2))
def test_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12):02d}", "calls", f"n{rng.randrange(12):02d}") for _ in range(17)]
    got = {(r.component, r.node_id) for r in traverse.cycles(graph(spark, edges)).collect()}
    assert got == components(edges)


def test_self_loops_and_none(spark):
    e = graph(spark, [("a", "calls", "a"), ("a", "calls", "b"), ("c", "renders", "c")])
    assert [tuple(r) for r in traverse.cycles(e).collect()] == [("a", "a")]
    assert traverse.cycles(graph(spark, [])).count() == 0


def test_neighbours_pages_boundaries(spark):
    e = graph(spark, [("a", "calls", "b"), ("c", "renders", "b"), ("c", "calls", "b"), ("d", "imports", "b"), ("file:x", "imports", "a")])
    nodes = spark.createDataFrame([("a", "p/a.py", "function", "a", "a"), ("b", "p/b.py", "function", "b", "b"), ("c", "p/b.py", "class", "c", "c")], "node_id string, path string, kind string, name string, qname string")
    page = traverse.page(traverse.neighbours(e, "b", True), ["node_id"], 1, 1)
    assert [(r.node_id, r.total, r.truncated) for r in page.collect()] == [("c", 2, False)]
    assert traverse.page(traverse.neighbours(e, "b", True), ["node_id"], 5, 99).count() == 0
    summary = traverse.with_summary(traverse.seed(spark, "a", "zz"), nodes)
    assert {r.node_id: r.name for r in summary.collect()} == {"a": "a", "zz": None}
    assert [(r.source_path, r.kind) for r in traverse.module_boundary(e, nodes).collect()] == [("p/a.py", "calls")]
    assert traverse.module_boundary(e, nodes, "b").count() == 0
