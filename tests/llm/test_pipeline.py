import random
from collections import Counter

from graphlens.llm import common as C, op2_mixing, op3_pii, op4_quality, op8_neardup, op9_decontam

from .helpers import awkward, docs
from .test_decontam import plain as plain_hits
from .test_mixing import plain_queue, plain_targets
from .test_neardup import corpus as near_corpus, plain_classes


def tables(spark, path, rows, bench, labels):
    docs(spark, rows, extra=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def sample():
    rng = random.Random(8)
    rows = [(i, t, f"s{i % 3}") for i, t, _ in near_corpus(5)]
    top = max(i for i, _, _ in rows) + 1
    junk = [(top + i, " ".join(f"W{rng.randrange(900)}!!" for _ in range(40)), "s1") for i in range(25)]
    item = " ".join(f"bench{i}" for i in range(30))
    leak = [(top + 100 + i, f"some words{i} before " + item + f" and after{i}", "s2") for i in range(4)]
    private = [(top + 200 + i, f"unique{i} mail me{i}@corp.example or call +1 (706) 555-313{i} soon{i}", "s0") for i in range(4)]
    labels = [(i, 1, 0) for i, _, _ in rows if i % 2] + [(i, 0, 0) for i, _, _ in junk if i % 2]
    return rows + junk + leak + private, [(1, item)], labels, {i for i, _, _ in junk}, {i for i, _, _ in leak}, {i for i, _, _ in private}


def test_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rows, bench, labels, junk, leak, private = sample()
    path = tables(spark, tmp_path / "t", rows, bench, labels)
    table = spark.read.parquet(f"{path}/documents.parquet")
    text = {i: t for i, t, _ in rows}
    first = C.materialize(p.quality(spark, table, path), "a")
    assert first.columns == table.columns
    kept = {r.doc_id for r in first.collect()}
    assert kept == {i for i, _, _ in rows} - junk
    second = C.materialize(p.near_dedup(spark, first, path), "b")
    classes = dict(plain_classes([r for r in rows if r[0] in kept]))
    kept = {r.doc_id for r in second.collect()}
    assert kept == set(classes.values()) and second.columns == table.columns
    third = C.materialize(p.decontaminate(spark, second, path), "c")
    hit = {d for d, *_, bad in plain_hits([(i, text[i], "") for i in kept], bench) if bad}
    assert hit == leak & kept
    kept -= hit
    assert {r.doc_id for r in third.collect()} == kept and third.columns == table.columns
    fourth = C.materialize(p.private(spark, third, path), "d")
    assert fourth.columns == table.columns
    for r in fourth.collect():
        if r.doc_id in private:
            assert "[EMAIL]" in r.text and "[PHONE]" in r.text and "@" not in r.text
        else:
            assert r.text == text[r.doc_id]
        assert r.n_chars == len(r.text)
    last = p.mixture(spark, fourth, path).collect()
    assert Counter(r.doc_id for r in last) == Counter(kept)
    sizes = Counter()
    for r in fourth.collect():
        sizes[r.source] += len(r.text.split())
    want = plain_targets(sizes)
    # The queues decide, row by row; a source misses its target by what it would serve next.
    left = [(r.doc_id, r.text, r.source) for r in fourth.collect()]
    assert {r.doc_id: r.taken for r in last} == {i: n for (i, _, _), n in zip(left, plain_queue(left, sizes, want), strict=True)}
    taken = Counter()
    for (_, _, source), n in zip(left, plain_queue(left, sizes, want), strict=True):
        taken[source] += n
    largest = Counter({s: max(len(t.split()) for _, t, x in left if x == s) for s in sizes})
    assert sum(taken.values()) == sum(sizes.values()) and all(abs(taken[s] - want[s]) <= largest.total() for s in sizes)


def test_run_and_registration(spark, tmp_path):
    import __spark_entry__ as e
    import corpus_pipeline as p

    rows, bench, labels, *_ = sample()
    path = tables(spark, tmp_path / "t", rows, bench, labels)
    assert e.queries()["pipeline"] is p.run
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontaminate", "private", "mixture"]
    assert p.run(spark, path).count() > 50
    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_awkward_rows(spark, tmp_path):
    import corpus_pipeline as p

    path = tables(spark, tmp_path / "t", awkward(), [(1, "nothing of this occurs anywhere"), (None, None)], [(5, 1, 0), (None, None, None)])
    assert p.run(spark, path).count() == op8_neardup.representatives(docs(spark, awkward())).count()
    empty = tables(spark, tmp_path / "e", [], [], [])
    assert p.run(spark, empty).collect() == []
    assert op2_mixing and op3_pii and op4_quality and op9_decontam


def test_null_ids_are_told_apart(spark, tmp_path):
    import corpus_pipeline as p

    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, f"before {item} after", "a"), (None, "a clean text without an id", "a"), (7, f"x {item}", "a"), (7, "a clean text of the same id", "a")]
    path = tables(spark, tmp_path / "t", rows, [(1, item)], [(7, 1, 0)])
    table = spark.read.parquet(f"{path}/documents.parquet")
    assert sorted(r.text for r in p.decontaminate(spark, table, path).collect()) == ["a clean text of the same id", "a clean text without an id"]
