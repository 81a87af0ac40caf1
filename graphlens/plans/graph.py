"""Graph queries over the test tables: each a function and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, search, traverse
from ..schema import CALL_KINDS, CONE_KINDS, IMPACT_KINDS
from ..sources.tables import graph

#: Vertices v and edges e in SQL.
V = """v AS (
  SELECT 'region:' || r_regionkey AS node_id, 'geo/' || r_name AS path, 'class' AS kind, r_name AS name, r_name AS qname FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'geo/' || r_name, 'method', n_name, r_name || '::' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier/' || n_name, 'function', s_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer:' || c_custkey, 'customer/' || n_name, 'function', c_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'part/' || p_brand, 'constant', p_name, p_brand || '::' || p_name FROM part
)"""
E = """t AS (
  SELECT s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
), m AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
e AS (
  SELECT 'nation:' || s_nationkey AS source, 'calls' AS kind, 'nation:' || c_nationkey AS target FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, c_nationkey) AS r FROM t) WHERE r <= 2
  UNION ALL SELECT 'nation:' || n_nationkey, 'inherits', 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'implements', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'references', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'part:' || l_partkey, 'renders', 'supplier:' || l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS r FROM m) WHERE r = 1
  UNION ALL SELECT 'file:part/' || p_brand, 'imports', 'part:' || p_partkey FROM part
)"""
G = f"WITH RECURSIVE {V}, {E}"


def _in(kinds) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


def _closure(start: str, kinds=None, backward: bool = True) -> str:
    a, b = ("source", "target") if backward else ("target", "source")
    test = f" AND e.kind IN {_in(kinds)}" if kinds else ""
    return f"{G}, r AS (SELECT {a} AS node_id FROM e WHERE {b} = '{start}'{test} UNION SELECT e.{a} FROM r JOIN e ON e.{b} = r.node_id{test})"


def _bounded(start: str, depth: int, kinds=None, backward: bool = True) -> str:
    a, b = ("source", "target") if backward else ("target", "source")
    test = f" AND e.kind IN {_in(kinds)}" if kinds else ""
    return f"{G}, r AS (SELECT {a} AS node_id, 1 AS depth FROM e WHERE {b} = '{start}'{test} UNION SELECT e.{a}, depth + 1 FROM r JOIN e ON e.{b} = r.node_id{test} WHERE depth < {depth}) SELECT node_id, min(depth) AS depth FROM r GROUP BY node_id"


def _paths(start: str, end: str, depth: int, kinds=None) -> str:
    test = f" WHERE kind IN {_in(kinds)}" if kinds else ""
    return f"""{G}, s AS (SELECT DISTINCT source, target FROM e{test}),
r AS (SELECT ['{start}'] AS p, '{start}' AS node, 0 AS n UNION ALL SELECT list_append(p, target), target, n + 1 FROM r JOIN s ON source = node WHERE n < {depth} AND node <> '{end}' AND NOT list_contains(p, target))
SELECT array_to_string(p, '>') AS path, CAST(n AS INTEGER) AS length FROM r WHERE node = '{end}' ORDER BY n, p LIMIT 1"""


def _with_graph(f):
    return lambda spark, sf_dir: f(*graph(spark, sf_dir))


def _impact_page(v, e):
    found = traverse.impact(e, "region:1").select("node_id")
    page = traverse.page(found, ["node_id"], 500)
    return traverse.with_summary(page, v).select("node_id", "name", "kind", "qname", "path", "total", "truncated")


def _path(rows):
    return rows.select(F.array_join("path", ">").alias("path"), F.col("length").cast("int").alias("length"))


def _neighbour(v, e, node_id, backward, limit=200, offset=0):
    page = traverse.page(traverse.neighbours(e, node_id, backward), ["node_id"], limit, offset)
    return traverse.with_summary(page, v).select("node_id", "name", "kind", "qname", "path", "total", "truncated")


def _neighbour_sql(node_id, backward, limit=200, offset=0):
    a, b = ("source", "target") if backward else ("target", "source")
    return f"{G}, n AS (SELECT DISTINCT {a} AS node_id FROM e WHERE {b} = '{node_id}' AND kind IN {_in(CALL_KINDS)}) SELECT p.node_id, name, kind, qname, path, total, {offset + limit} < total AS truncated FROM (SELECT node_id, count(*) OVER () AS total FROM n ORDER BY node_id LIMIT {limit} OFFSET {offset}) AS p LEFT JOIN v USING (node_id)"


_HIT = "SELECT DISTINCT node_id, name, kind, qname, path FROM v"
_FIRST = " ORDER BY name, kind, node_id LIMIT 64"


def _members(v, e):
    return search.members(v)


def _top_hubs(v, e):
    calls = e.filter(F.col("kind").isin(*IMPACT_KINDS)).groupBy(F.col("target_node_id").alias("node_id")).agg(F.count("*").alias("in_degree"))
    return traverse.with_summary(calls, v).select("node_id", "kind", "path", "in_degree")


def _node(v, e):
    ids = traverse.seed(e.sparkSession, "nation:10", "part:1", "nobody:0")
    rows = context.related(e, ids.join(v, "node_id", "left"), 20)
    return rows.select("node_id", "path", "kind", "name", "qname", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


_NODE_SQL = f"""{G}, i AS (SELECT unnest(['nation:10', 'part:1', 'nobody:0']) AS node_id),
a AS (SELECT node_id, string_agg(x, ',' ORDER BY x) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY x) AS r FROM (SELECT DISTINCT target AS node_id, source AS x FROM e WHERE kind IN {_in(CALL_KINDS)})) WHERE r <= 20 GROUP BY node_id),
b AS (SELECT node_id, string_agg(x, ',' ORDER BY x) AS callees FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY x) AS r FROM (SELECT DISTINCT source AS node_id, target AS x FROM e WHERE kind IN {_in(CALL_KINDS)})) WHERE r <= 20 GROUP BY node_id)
SELECT node_id, path, kind, name, qname, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM i LEFT JOIN v USING (node_id) LEFT JOIN a USING (node_id) LEFT JOIN b USING (node_id)"""

QUERIES = {
    "impact_unbounded": (_with_graph(_impact_page), _closure("region:1", IMPACT_KINDS) + " SELECT p.node_id, name, kind, qname, path, total, 500 < total AS truncated FROM (SELECT node_id, count(*) OVER () AS total FROM r ORDER BY node_id LIMIT 500) AS p LEFT JOIN v USING (node_id)"),
    "impact_depth_1": (_with_graph(lambda v, e: traverse.impact(e, "region:1", 1)), _bounded("region:1", 1, IMPACT_KINDS)),
    "impact_depth_2": (_with_graph(lambda v, e: traverse.impact(e, "region:1", 2)), _bounded("region:1", 2, IMPACT_KINDS)),
    "forward_reach": (_with_graph(lambda v, e: traverse.forward_impact(e, "part:1").select("node_id")), _closure("part:1", None, False) + " SELECT node_id FROM r"),
    "forward_reach_2": (_with_graph(lambda v, e: traverse.forward_impact(e, "part:1", 2)), _bounded("part:1", 2, None, False)),
    "reach_zero_depth": (_with_graph(lambda v, e: traverse.forward_impact(e, "part:1", 0).select("node_id")), "SELECT 'x' AS node_id WHERE false"),
    "dependency_cone": (_with_graph(lambda v, e: traverse.dependency_cone(e, "nation:10").select("node_id")), _closure("nation:10", CONE_KINDS) + " SELECT node_id FROM r"),
    "changes_if": (_with_graph(lambda v, e: traverse.changes_if(e, "nation:10").select("node_id")), _closure("nation:10", IMPACT_KINDS) + " SELECT node_id FROM r"),
    "cycles": (
        _with_graph(lambda v, e: traverse.cycles(e)),
        f"""{G}, c AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE kind = 'calls'), r AS (SELECT a, b FROM c UNION SELECT r.a, c.b FROM r JOIN c ON r.b = c.a),
x AS (SELECT f.a AS node_id, min(f.b) AS component FROM r AS f JOIN r AS g ON f.a = g.b AND f.b = g.a GROUP BY f.a)
SELECT component, node_id FROM x""",
    ),
    "shortest_path_len": (_with_graph(lambda v, e: _path(traverse.shortest_path(e, "part:1", "region:1"))), _paths("part:1", "region:1", 8)),
    "trace_path": (_with_graph(lambda v, e: _path(traverse.trace(e, "nation:0", "nation:10"))), _paths("nation:0", "nation:10", 8, CALL_KINDS)),
    "trace_self": (_with_graph(lambda v, e: _path(traverse.trace(e, "nobody:1", "nobody:1"))), "SELECT 'nobody:1' AS path, CAST(0 AS INTEGER) AS length"),
    "callers": (_with_graph(lambda v, e: _neighbour(v, e, "nation:10", True)), _neighbour_sql("nation:10", True)),
    "callees": (_with_graph(lambda v, e: _neighbour(v, e, "part:1", False)), _neighbour_sql("part:1", False)),
    "callers_page": (_with_graph(lambda v, e: _neighbour(v, e, "supplier:1", True, 5, 2)), _neighbour_sql("supplier:1", True, 5, 2)),
    "module_boundary": (_with_graph(lambda v, e: traverse.module_boundary(e, v)), f"{G} SELECT a.path AS source_path, b.path AS target_path, e.kind, source AS source_node_id, target AS target_node_id FROM e JOIN v AS a ON source = a.node_id JOIN v AS b ON target = b.node_id WHERE a.path <> b.path"),
    "module_boundary_source": (_with_graph(lambda v, e: traverse.module_boundary(e, v, "supplier/")), f"{G} SELECT a.path AS source_path, b.path AS target_path, e.kind, source AS source_node_id, target AS target_node_id FROM e JOIN v AS a ON source = a.node_id JOIN v AS b ON target = b.node_id WHERE a.path <> b.path AND contains(a.path, 'supplier/')"),
    "module_boundary_both": (_with_graph(lambda v, e: traverse.module_boundary(e, v, "supplier/", "ASIA")), f"{G} SELECT a.path AS source_path, b.path AS target_path, e.kind, source AS source_node_id, target AS target_node_id FROM e JOIN v AS a ON source = a.node_id JOIN v AS b ON target = b.node_id WHERE a.path <> b.path AND contains(a.path, 'supplier/') AND contains(b.path, 'ASIA')"),
    "find_symbol": (_with_graph(lambda v, e: search.find_symbol(v, "Supplier#000000001")), f"WITH {V} {_HIT} WHERE name = 'Supplier#000000001' OR qname = 'Supplier#000000001'"),
    "find_symbol_kind": (_with_graph(lambda v, e: search.find_symbol(v, "ASIA", "class")), f"WITH {V} {_HIT} WHERE (name = 'ASIA' OR qname = 'ASIA') AND kind = 'class'"),
    "search_exact": (_with_graph(lambda v, e: search.search(v, "EUROPE", "exact")), f"WITH {V} {_HIT} WHERE name = 'EUROPE' OR qname = 'EUROPE'{_FIRST}"),
    "search_prefix": (_with_graph(lambda v, e: search.search(v, "ASIA", "prefix")), f"WITH {V} {_HIT} WHERE starts_with(name, 'ASIA') OR starts_with(qname, 'ASIA'){_FIRST}"),
    "search_contains": (_with_graph(lambda v, e: search.search(v, "00")), f"WITH {V} {_HIT} WHERE contains(name, '00') OR contains(qname, '00'){_FIRST}"),
    "search_kind": (_with_graph(lambda v, e: search.search(v, "1", kind="function")), f"WITH {V} {_HIT} WHERE (contains(name, '1') OR contains(qname, '1')) AND kind = 'function'{_FIRST}"),
    "search_path_prefix": (_with_graph(lambda v, e: search.search(v, "A", path_prefix="geo/A")), f"WITH {V} {_HIT} WHERE (contains(name, 'A') OR contains(qname, 'A')) AND starts_with(path, 'geo/A'){_FIRST}"),
    "trigram_index": (_with_graph(lambda v, e: search.trigrams(v)), f"WITH {V}, n AS (SELECT DISTINCT name FROM v) SELECT DISTINCT name, substr(lower(name), i, 3) AS trigram FROM n, unnest(range(1, length(name) - 1)) AS t(i)"),
    "trigram_candidates": (_with_graph(lambda v, e: search.candidates(search.trigrams(v), "mer#00000012")), f"WITH {V} SELECT DISTINCT name FROM v WHERE contains(name, 'mer#00000012')"),
    "files_page": (_with_graph(lambda v, e: search.files(v, "customer/", 10, 3)), f"WITH {V}, p AS (SELECT DISTINCT path FROM v WHERE starts_with(path, 'customer/')) SELECT path, count(*) OVER () AS total FROM p ORDER BY path LIMIT 10 OFFSET 3"),
    "nodes_in_file": (_with_graph(lambda v, e: search.nodes_in_file(v, "geo/ASIA")), f"WITH {V} SELECT node_id, kind, name, qname FROM v WHERE path = 'geo/ASIA' ORDER BY node_id"),
    "kind_counts": (_with_graph(lambda v, e: search.kind_counts(v)), f"WITH {V} SELECT path, kind, count(*) AS n FROM v GROUP BY path, kind"),
    "status_counts": (_with_graph(lambda v, e: search.status(v, e)), f"WITH {V}, {E} SELECT (SELECT count(DISTINCT path) FROM v) AS files, (SELECT count(DISTINCT node_id) FROM v) AS nodes, (SELECT count(*) FROM (SELECT name, kind FROM v UNION SELECT qname, kind FROM v)) AS symbols, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM e WHERE kind IN {_in(CALL_KINDS)})) AS call_edges"),
    "members": (_with_graph(_members), f"WITH {V} SELECT DISTINCT o.node_id AS owner_id, m.node_id AS member_id FROM v AS o JOIN v AS m ON o.path = m.path AND starts_with(m.qname, o.qname || '::') WHERE o.kind IN ('class', 'interface', 'trait', 'enum', 'component') AND o.node_id <> m.node_id"),
    "member_callers": (_with_graph(lambda v, e: search.member_calls(v, e, "region:1", True)), f"WITH {V}, {E}, own AS (SELECT m.node_id FROM v AS o JOIN v AS m ON o.path = m.path AND starts_with(m.qname, o.qname || '::') WHERE o.node_id = 'region:1' AND m.node_id <> 'region:1') SELECT DISTINCT source AS node_id FROM e JOIN own ON target = own.node_id WHERE kind IN {_in(CALL_KINDS)} AND source NOT IN (SELECT node_id FROM own)"),
    "member_callees": (_with_graph(lambda v, e: search.member_calls(v, e, "region:1", False)), f"WITH {V}, {E}, own AS (SELECT m.node_id FROM v AS o JOIN v AS m ON o.path = m.path AND starts_with(m.qname, o.qname || '::') WHERE o.node_id = 'region:1' AND m.node_id <> 'region:1') SELECT DISTINCT target AS node_id FROM e JOIN own ON source = own.node_id WHERE kind IN {_in(CALL_KINDS)} AND target NOT IN (SELECT node_id FROM own)"),
    "node_relations": (_with_graph(_node), _NODE_SQL),
    "in_degree": (_with_graph(_top_hubs), f"WITH {V}, {E}, d AS (SELECT target AS node_id, count(*) AS in_degree FROM e WHERE kind IN {_in(IMPACT_KINDS)} GROUP BY target) SELECT node_id, kind, path, in_degree FROM d LEFT JOIN v USING (node_id)"),
}
