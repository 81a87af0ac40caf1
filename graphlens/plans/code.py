"""Resolution, classification and text rules over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import framework, resolve
from ..sources.tables import read

_EXT = ["php", "blade.php", "PHP", "js", "cjs", "mjs", "ts", "tsx", "py", "go", "rs", "jsx", "txt", "min.JS"]


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values, by):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({by} % {len(values)} + 1 AS INTEGER)]"


def _lang(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit("."), _pick(_EXT, F.col("doc_id"))).alias("path"))
    return d.select("path", T.language("path").alias("language"), T.language("path", wide=True).alias("language_wide"))


def _lang_case(wide):
    rows = [(s, n) for s, n in T.SUFFIXES + (T.MORE_SUFFIXES if wide else ())]
    return "CASE " + " ".join(f"WHEN ends_with(lower(path), '{s}') THEN '{n}'" for s, n in rows) + " END"


def _defs(spark, sf):
    """Parts as definitions of files in five languages."""
    p = read(spark, sf, "part")
    lang = _pick(["python", "go", "rust", "typescript", "php"], F.col("p_partkey"))
    ext = _pick(["py", "go", "rs", "ts", "php"], F.col("p_partkey"))
    stem = _pick(["index", "mod", "util"], F.floor(F.col("p_partkey") / 5))
    name = F.regexp_replace("p_name", "[^A-Za-z0-9]", "_")
    path = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit("/"), stem, F.lit("."), ext)
    kind = F.when(F.col("p_size") > 25, "function").otherwise("method")
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id"), lang.alias("language"), path.alias("path"), kind.alias("kind"), name.alias("name"), F.concat(F.col("p_type"), F.lit("."), name).alias("qname"), F.when(F.col("p_size") % 2 == 0, 1).alias("parent"))


_DEFS = f"""d AS (
  SELECT 'part:' || p_partkey AS node_id, {_pick_sql(["python", "go", "rust", "typescript", "php"], "p_partkey")} AS language,
    'src/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '/' || {_pick_sql(["index", "mod", "util"], "(p_partkey // 5)")} AS stem, 'src/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS folder,
    CASE WHEN p_size > 25 THEN 'function' ELSE 'method' END AS kind, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS name, p_type || '.' || regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS qname, CASE WHEN p_size % 2 = 0 THEN 1 END AS parent FROM part
), f AS (SELECT *, CASE language WHEN 'typescript' THEN 'js' ELSE language END AS family, regexp_replace(regexp_replace(stem, '^src/', ''), '/mod$', '') AS module FROM d),
s AS (
  SELECT family, qname AS key, node_id FROM f UNION SELECT family, name, node_id FROM f WHERE family <> 'php' OR kind = 'function'
  UNION SELECT family, stem || '#local#' || name, node_id FROM f WHERE family = 'js' UNION SELECT family, stem || '#' || name, node_id FROM f WHERE family = 'js' AND parent IS NULL
  UNION SELECT family, regexp_replace(stem, '/index$', '') || '#' || name, node_id FROM f WHERE family = 'js' AND parent IS NULL AND ends_with(stem, '/index')
  UNION SELECT family, replace(stem, '/', '.') || '.' || name, node_id FROM f WHERE family = 'python' AND parent IS NULL
  UNION SELECT family, folder || '#' || name, node_id FROM f WHERE family = 'go' AND parent IS NULL
  UNION SELECT family, replace(module, '/', '::') || '::' || name, node_id FROM f WHERE family = 'rust' AND parent IS NULL
)"""


def _symbol_keys(spark, sf):
    return resolve.symbol_table(_defs(spark, sf))


def _unique_keys(spark, sf):
    return resolve.unique(_symbol_keys(spark, sf))


def _refs(spark, sf):
    """Order lines as references to parts, by the keys of their languages."""
    # Only what a reference needs is shuffled, and no line outside of any definition that is
    # not an import: such a call makes no edge.
    line = read(spark, sf, "lineitem").filter("l_linestatus = 'F' and l_linenumber is not null or l_returnflag = 'R'").select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("named"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("container"))
    d = _defs(spark, sf)
    key = F.when(F.col("language") == "typescript", F.concat(T.js_module("path"), F.lit("#"), "name")).when(F.col("language") == "go", F.concat(T.directory("path"), F.lit("#"), "name")).otherwise(F.col("qname"))
    target = d.select(F.regexp_replace("node_id", "^part:", "").cast("long").alias("pk"), "language", key.alias("qname"), "name")
    kind = F.when(F.col("language") == "go", "go_selector_call").when(F.col("language") == "rust", "rust_call").when(F.col("named"), "import_named").otherwise("call")
    rows = line.join(target, F.col("l_partkey") == F.col("pk"))
    return rows.select("language", F.concat(F.lit("o/"), F.col("l_suppkey").cast("string")).alias("path"), F.unhex(F.sha2(F.col("l_suppkey").cast("string"), 256)).alias("content_hash"), kind.alias("kind"), "name", "qname", "container")


def _resolved(spark, sf):
    return resolve.edges(_refs(spark, sf), resolve.symbol_table(_defs(spark, sf))).select("source_node_id", "kind", "target_node_id")


_RESOLVED = f"""WITH {_DEFS}, r AS (
  SELECT f.family, CASE WHEN l_linestatus = 'F' THEN sha256(CAST(l_suppkey AS VARCHAR)) || ':' || l_linenumber WHEN l_returnflag = 'R' AND f.language NOT IN ('go', 'rust') THEN 'file:o/' || l_suppkey END AS source,
    CASE WHEN l_returnflag = 'R' AND f.language NOT IN ('go', 'rust') THEN 'imports' ELSE 'calls' END AS kind,
    CASE WHEN f.language = 'typescript' THEN stem || '#' || name WHEN f.language = 'go' THEN folder || '#' || name ELSE qname END AS key
  FROM lineitem JOIN f ON node_id = 'part:' || l_partkey
)
SELECT DISTINCT source AS source_node_id, kind, node_id AS target_node_id FROM r JOIN s USING (family, key) WHERE source IS NOT NULL"""

_REF_KINDS = [*resolve.EDGE_KINDS, "type_reference", "instantiates", "route_handler", "decorator", "jsx_element", "blade_extends"]


def _edge_kinds(spark, sf):
    e = read(spark, sf, "events").select(_pick(_REF_KINDS, F.col("event_id")).alias("ref_kind"))
    return e.groupBy("ref_kind", resolve.edge_kind("ref_kind").alias("edge_kind")).agg(F.count("*").alias("n"))


_EDGE_KINDS = "WITH k AS (SELECT " + _pick_sql(_REF_KINDS, "event_id") + " AS ref_kind FROM events) SELECT ref_kind, CASE ref_kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in resolve.EDGE_KINDS.items()) + " ELSE 'references' END AS edge_kind, count(*) AS n FROM k GROUP BY ref_kind"

_RECEIVERS = ["Route", "Cache", "User", "Queue", "Event", "View", "Post"]
_METHODS = ["get", "find", "push", "dispatch", "make", "where", "match", "remember", "fire"]


def _framework(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    arg = lambda kind, value, *items: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.array(*items).cast("array<string>").alias("items"))
    target = F.concat(F.lit("App\\C"), F.col("o_custkey").cast("string"))
    path = F.concat(F.lit("/o/"), k.cast("string"))
    args = F.when(k % 3 == 0, F.array(arg("string", path), arg("class", target))).when(k % 3 == 1, F.array(arg("string", path), arg("string", F.concat(target, F.lit("@show"))))).otherwise(F.array(arg("class", target), arg("array", F.lit(None).cast("string"), F.concat(F.lit("class:"), target), F.lit("string:index"))))
    calls = o.select(F.lit("static").alias("receiver_kind"), _pick(_RECEIVERS, k).alias("receiver"), _pick(_METHODS, F.floor(k / 7)).alias("method"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("scope"), F.lit(0).alias("start"), args.alias("args"))
    return framework.laravel(calls).select("source_node_id", "kind", "target_node_id", "confidence")


_list = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_FRAMEWORK = f"""WITH c AS (
  SELECT {_pick_sql(_RECEIVERS, "o_orderkey")} AS receiver, {_pick_sql(_METHODS, "(o_orderkey // 7)")} AS method, 's' || o_custkey AS scope, o_orderkey % 3 AS shape, 'App\\C' || o_custkey AS target, '/o/' || o_orderkey AS path FROM orders
), x AS (
  SELECT *, CASE WHEN receiver = 'Route' AND method IN {_list(framework.ROUTE_VERBS)} THEN 'routes_to' WHEN receiver = 'Route' AND method = 'match' THEN NULL WHEN receiver = 'View' AND method = 'make' THEN NULL
    WHEN receiver = 'Event' AND method IN ('dispatch', 'fire') THEN 'dispatches_event' WHEN receiver = 'Queue' AND method = 'push' THEN CASE WHEN shape = 2 THEN 'dispatches_job' END
    WHEN receiver IN {_list(framework.FACADES)} THEN 'facade_call' WHEN method IN {_list(framework.QUERY_METHODS)} THEN 'uses_model' END AS kind FROM c
)
SELECT DISTINCT 'lh:' || CASE kind WHEN 'routes_to' THEN 'route:' || method || ' ' || CASE WHEN shape = 2 THEN scope || '@0' ELSE path END ELSE scope END AS source_node_id, kind,
  'lh:' || CASE kind WHEN 'routes_to' THEN CASE shape WHEN 0 THEN target || '::__invoke' WHEN 1 THEN target || '::show' ELSE target || '::index' END WHEN 'dispatches_event' THEN CASE WHEN shape = 2 THEN target ELSE path END WHEN 'dispatches_job' THEN target WHEN 'facade_call' THEN receiver || '::' || method ELSE receiver END AS target_node_id,
  CAST(CASE kind WHEN 'routes_to' THEN CASE WHEN shape = 1 THEN 70 ELSE 90 END WHEN 'dispatches_event' THEN CASE WHEN shape = 2 THEN 90 ELSE 70 END WHEN 'uses_model' THEN 70 ELSE 90 END AS INTEGER) AS confidence
FROM x WHERE kind IS NOT NULL"""

_NAMES = ["useThing", "use", "used", "useX", "Foo", "_Foo", "foo", "__Bar", "MAX_SIZE", "Max", "_1", "A1", "$x", "a-b", ""]


def _predicates(spark, sf):
    e = read(spark, sf, "events").select("event_id", _pick(_NAMES, F.col("event_id")).alias("name"))
    return e.select("event_id", T.is_hook("name").alias("hook"), T.is_component("name").alias("component"), T.is_screaming("name").alias("constant"), T.is_identifier("name").alias("identifier"))


def _links(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


def _paths(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.concat(F.lit("a/b/../"), F.regexp_extract("url", r"^https?://([^?#]*)", 1), F.lit("/./x/../y.ts")).alias("raw"))
    return p.select("page_id", T.normal_path("raw").alias("path"), T.without_extension(T.normal_path("raw")).alias("stem"), T.directory(T.normal_path("raw")).alias("folder"))


def _numbered(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", T.numbered("text", 7).alias("numbered"))


QUERIES = {
    "lang_detect": (_lang, f"WITH d AS (SELECT 'src/f' || doc_id || '.' || {_pick_sql(_EXT, 'doc_id')} AS path FROM documents) SELECT path, {_lang_case(False)} AS language, {_lang_case(True)} AS language_wide FROM d"),
    "symbol_keys": (_symbol_keys, f"WITH {_DEFS} SELECT family, key, node_id FROM s"),
    "unique_symbols": (_unique_keys, f"WITH {_DEFS} SELECT family, key, min(node_id) AS node_id FROM s GROUP BY family, key HAVING count(*) = 1"),
    "resolve_edges": (_resolved, _RESOLVED),
    "edge_kind_map": (_edge_kinds, _EDGE_KINDS),
    "framework_rules": (_framework, _FRAMEWORK),
    "hook_component_predicates": (
        _predicates,
        f"WITH n AS (SELECT event_id, {_pick_sql(_NAMES, 'event_id')} AS name FROM events) SELECT event_id, regexp_matches(name, '^use[A-Z]') AS hook, regexp_matches(name, '^_*[A-Z]') AS component, regexp_matches(name, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AS constant, regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') AS identifier FROM n",
    ),
    "page_links": (_links, "SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY ALL"),
    "path_normalise": (_paths, r"WITH p AS (SELECT page_id, 'a/' || trim(regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+', '/', 'g'), '/') AS base FROM pages) SELECT page_id, base || '/y.ts' AS path, base || '/y' AS stem, base AS folder FROM p"),
    "numbered_lines": (_numbered, "SELECT doc_id, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)), lambda x, i: CAST(i + 6 AS VARCHAR) || chr(9) || rtrim(x, chr(13)) || chr(10)), '') END AS numbered FROM documents"),
}
