"""Edges of references, against a plain join."""

import random

import pyarrow.parquet as pq
import pytest

from graphlens.operators import resolve

REFS = "path string, language string, content_hash binary, kind string, name string, qname string, container string"


def tables(spark, seed=5):
    rng = random.Random(seed)
    names, owners = ["get", "run", "find"], [f"A{i}" for i in range(6)]
    symbols = [(f, k, f"{f}:{n}:{i}") for f in ("python", "php") for i in range(40) for n in [rng.choice(names)] for k in (n, f"{rng.choice(owners)}::{n}", f"m{i % 3}.{n}")]
    # One definition in two families, and one under the keys of many equal files.
    symbols += [("python", "get", "both"), ("php", "A1::get", "both"), *(("python", f"copy{i}.get", "copied") for i in range(30))]
    keys = sorted({(f, k) for f, k, _ in symbols}) + [("python", "unknown"), ("php", "")]
    refs = []
    for _ in range(600):
        f, k = rng.choice(keys)
        kind = "import" if f == "python" and rng.random() < 0.3 else "trait_use"
        digest = rng.choice([b"\x01\xab", b"", None]) if rng.random() < 0.2 else bytes([rng.randrange(8)])
        refs.append((f"f{rng.randrange(9)}", f, digest, kind, k, rng.choice([k, None]), rng.choice(["1", "2", None])))
    return refs, symbols


def plain(refs, symbols):
    out = set()
    for path, f, digest, kind, name, qname, container in refs:
        edge = resolve.EDGE_KINDS[kind]
        if container is not None:
            source = None if digest is None else f"{digest.hex()}:{container}"
        else:
            source = f"file:{path}" if edge in ("imports", "exports") else None
        key = name if qname is None else qname
        if source is not None and key:
            out |= {(source, edge, node) for sf, sk, node in symbols if (sf, sk) == (f, key)}
    return sorted(out)


@pytest.mark.parametrize("many", [1, 2, 16])
def test_edges_by_plain_join(spark, monkeypatch, many):
    monkeypatch.setattr(resolve, "MANY_KEYS", many)
    monkeypatch.setattr(resolve, "CHUNK", 4)
    refs, symbols = tables(spark)
    got = resolve.edges(spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, "family string, key string, node_id string"))
    assert sorted((r.source_node_id, r.kind, r.target_node_id) for r in got.collect()) == plain(refs, symbols)
    assert {(r.provenance, r.confidence) for r in got.collect()} == {("parser_extract", 80)}


def test_edges_of_no_rows(spark):
    refs, symbols = tables(spark)
    none = spark.createDataFrame([], REFS), spark.createDataFrame([], "family string, key string, node_id string")
    assert resolve.edges(none[0], spark.createDataFrame(symbols, none[1].schema)).collect() == []
    assert resolve.edges(spark.createDataFrame(refs, REFS), none[1]).collect() == []


def test_nothing_is_shuffled_after_the_join(spark):
    """A shared name makes references x definitions edges; they must not be made distinct."""
    refs = spark.range(200).selectExpr("'f' path", "'python' language", "unhex(hex(id)) content_hash", "'call' kind", "'get' name", "cast(null as string) qname", "'1' container")
    symbols = spark.range(300).selectExpr("'python' family", "'get' key", "string(id) node_id")
    got = resolve.edges(refs, symbols)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == got.distinct().count() == 60_000


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_edges_in_tiles(spark, monkeypatch, bytes_):
    """Many small tiles, or definitions that are too large to be broadcast."""
    monkeypatch.setattr(resolve, "TILE_BYTES", 200)
    monkeypatch.setattr(resolve, "BROADCAST_BYTES", bytes_)
    refs, symbols = tables(spark, seed=6)
    got = resolve.edges(spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, "family string, key string, node_id string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("RepartitionByExpression" in plan) == (bytes_ > 0)
    assert sorted((r.source_node_id, r.kind, r.target_node_id) for r in got.collect()) == plain(refs, symbols)


def test_packed_strings(spark):
    rows = [("a", "", "x y"), ("", " 3 ", "é\u20ac 1"), ("1 2", "\0", ""), ("😀", "a", "b")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.select(resolve._packed("a", "b", "c").alias("p")).select(*resolve._unpacked("p", "a", "b", "c"))
    assert [tuple(r) for r in got.collect()] == rows


def test_edges_take_little_disk(spark, tmp_path):
    """80 000 sources of 66 bytes, more than one file's dictionary holds: none of the files
    may fall back to plain strings, which take some bytes an edge in place of some bits."""
    refs = spark.range(80_000).selectExpr("'f' path", "'python' language", "unhex(sha2(string(id), 256)) content_hash", "'call' kind", "'get' name", "cast(null as string) qname", "'1' container")
    symbols = spark.range(10).selectExpr("'python' family", "'get' key", "concat('node:', string(id)) node_id")
    resolve.edges(refs, symbols).write.parquet(f"{tmp_path}/edges")
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 800_000
    groups = [m.row_group(i) for f in (tmp_path / "edges").glob("*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert not [c.path_in_schema for g in groups for c in map(g.column, range(g.num_columns)) if "PLAIN" in c.encodings]
