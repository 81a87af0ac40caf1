import hashlib

from pyspark.sql import functions as F

from graphlens.llm import common as C, op7_merkle as op

PAGE = "page_id long, url string, html string, sha256 string, node long, a string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGE).repartition(3)


def sample(n=300):
    return [(i * 7 % 1009, f"http://h/{i}", f"<p>page {i} é</p>" * (1 + i % 5)) for i in range(n)]


def plain_record(i, url, html):
    body = html or ""
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


def test_finds_the_damage(spark):
    rows = sample()
    bad = {rows[5][0], rows[100][0], rows[299][0]}
    lost, extra = rows[42][0], (5000, "u", "h")
    other = [(i, u, h.replace("page", "pave") if i in bad else h) for i, u, h in rows if i != lost] + [extra]
    got = {r.page_id: r for r in op.audit(pages(spark, rows), pages(spark, other)).collect()}
    assert len(got) == len(rows) + 1
    assert {i for i, r in got.items() if r.state == "corrupt"} == bad
    assert got[lost].state == "missing" and got[5000].state == "extra"
    at = 0
    for i, u, h in sorted(rows):
        record = plain_record(i, u, h)
        assert (got[i].offset, got[i].n_bytes, got[i].sha256) == (at, len(record), hashlib.sha256(record).hexdigest())
        at += len(record)


def trees(spark, *tables, fanout):
    rows = [op.records(pages(spark, t)) for t in tables]
    plan = op.layout(*rows, fanout=fanout)
    return plan, [op.tree(r, plan, "t", fanout) for r in rows]


def plain_tree(rows, plan, fanout):
    """Levels {(range, sub): (bytes, hash)}, made one dictionary after the other."""
    digests, last = [], (object(), 0)
    for i, sha, n in sorted(((i, hashlib.sha256(plain_record(i, u, h)).hexdigest(), len(plain_record(i, u, h))) for i, u, h in rows), key=lambda r: (r[0] is not None, r[0], r[1])):
        last = (i, last[1] + 1 if last[0] == i else 0)
        digests.append((0 if i is None else (i - plan.low) // plan.width + 1, last[1], sha, n))
    level = {}
    for r, copy, sha, n in digests:
        level.setdefault((r, copy // fanout), []).append((n, sha))
    out = []
    while True:
        level = {k: (sum(n for n, _ in v), hashlib.sha256(":".join([str(sum(n for n, _ in v)), ",".join(h for _, h in v)]).encode()).hexdigest()) for k, v in level.items()}
        out.append(level)
        if len(out) > plan.height:
            return out
        up = {}
        for (r, s), v in sorted(level.items()):
            up.setdefault((r, s // fanout) if len(out) <= plan.copies else (r // fanout, s), []).append(v)
        level = up


def test_trees_by_brute_force(spark):
    rows = sample(100) + [(77, "u", f"copy {i}") for i in range(20)] + [(None, "u", f"null {i}") for i in range(5)]
    plan, (a,) = trees(spark, rows, fanout=4)
    want = plain_tree(rows, plan, 4)
    assert plan.copies == 2 and len(a.levels) == len(want)
    for table, level in zip(a.levels, want, strict=True):
        assert {(r.range, r.sub): (r.n_bytes, r.hash) for r in table.collect()} == level
    assert list(want[-1]) == [(0, 0)]


def test_equal_replicas_end_at_the_root(spark):
    rows = sample(100)
    plan, (a, b) = trees(spark, rows, rows, fanout=8)
    differ, compared = op.descend(a, b, plan, 8)
    assert differ.count() == 0 and [c.count() for c in compared] == [1]


def test_the_descent_reads_only_children_of_nodes_that_differ(spark):
    rows = [(i, "u", f"page {i}") for i in range(600)]
    other = [(i, u, h + "!" if i == 321 else h) for i, u, h in rows]
    plan, (a, b) = trees(spark, rows, other, fanout=8)
    # Records and nodes elsewhere could be anything: they are not looked at.
    differ, compared = op.descend(a, b, plan, 8)
    assert [(r.range, r.sub) for r in differ.collect()] == [(321 // plan.width + 1, 0)]
    assert len(compared) == plan.height + 1 and max(c.count() for c in compared) <= 8
    files = lambda t: set(t.inputFiles())
    below = op._below(b.levels[0], differ, "", 8, plan.folders[0])
    part = {r.part for r in below.select("part").collect()}
    assert len(part) == 1 and 0 < len([f for f in files(b.levels[0]) if f"part={min(part)}/" in f]) < len(files(b.levels[0]))
    plan_text = below._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan_text and "part" in plan_text.split("PartitionFilters: [")[1].split("]")[0]


def test_damage_among_records_of_one_key(spark):
    rows = [(7, "u", f"copy {i:03d}") for i in range(70)] + sample(50)
    other = [(i, u, h.replace("copy 050", "copy 05O")) for i, u, h in rows]
    got = op.audit(pages(spark, rows), pages(spark, other), fanout=16).collect()
    assert len(got) == len(rows) and {r.page_id for r in got if r.state != "intact"} == {7}


def test_awkward_rows(spark):
    rows = [(None, None, None), (None, "u", "é" * 10_000), (1, "u", ""), (1, "u", ""), (2, None, "x" * 100_000), (2, "v", None)]
    got = op.audit(pages(spark, rows), pages(spark, rows[:-1])).collect()
    assert len(got) == len(rows)
    assert sum(r.state != "intact" for r in got) in (1, 2)
    assert {r.state for r in op.audit(pages(spark, rows), pages(spark, [])).collect()} == {"missing"}
    assert {r.state for r in op.audit(pages(spark, []), pages(spark, rows)).collect()} == {"extra"}
    assert op.audit(pages(spark, []), pages(spark, [])).collect() == []
    assert C.materialize(op.decayed(pages(spark, rows)), "d").filter(F.col("page_id") == 1).count() == 2
