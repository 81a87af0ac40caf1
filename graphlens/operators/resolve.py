"""Cross-file resolution: symbol keys, import rewriting, references to edges.

refs are rows (path, language, content_hash, id, kind, name, qname, alias, container),
nodes rows (path, language, node_id, kind, name, qname, parent).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import runtime
from ..functions import text as T
from ..schema import FAMILY

JS = ("javascript", "typescript", "tsx")
# PHP kinds that are found by their bare name, and the edge kind of each
# kind of reference; any other reference is `references`.
PHP_BARE = ("class", "interface", "trait", "enum", "function")
EDGE_KINDS = {
    "call": "calls",
    "member_call": "calls",
    "method_call": "calls",
    "static_call": "calls",
    "nullsafe_method_call": "calls",
    "go_selector_call": "calls",
    "rust_call": "calls",
    "extends": "inherits",
    "inheritance": "inherits",
    "implements": "implements",
    "trait_use": "uses",
    "import": "imports",
    "import_esm": "imports",
    "import_cjs": "imports",
    "import_go": "imports",
    "import_rust": "imports",
    "import_named": "imports",
    "import_default": "imports",
    "import_namespace": "imports",
    "export": "exports",
    "export_esm": "exports",
    "export_cjs": "exports",
    "jsx_component": "renders",
    "blade_view": "renders",
    "blade_component": "renders",
    "blade_x_component": "renders",
}

#: Definitions of one key that are joined as one row.
CHUNK = 1000
#: Definitions with more keys (those of equal files share them) are made distinct after the
#: join instead, as their pairs of keys would be many.
MANY_KEYS = 16
#: Definitions of no more bytes of node ids are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of different sources, and of different targets, that a tile of edges aims at: a
#: Parquet dictionary, with which an edge takes some bits, holds 1 MiB a column.
TILE_BYTES = 800_000
#: Edges that a tile aims at, at most, and the most tiles.
TILE_EDGES = 1 << 26
TILES = 10_000


@dataclass
class Project:
    """What the configuration files of a tree say."""

    base_url: str = ""
    aliases: Sequence[tuple[str, str]] = ()  # pattern, first target; in pattern order
    go_module: str | None = None
    packages: Sequence[str] = field(default_factory=tuple)  # folders of Python packages


def _mapped(column: Column, values: dict[str, str], other: str | None = None) -> Column:
    out = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)
    return out if other is None else F.coalesce(out, F.lit(other))


def family(language: Column | str) -> Column:
    return _mapped(T.col(language), FAMILY)


def edge_kind(kind: Column | str) -> Column:
    return _mapped(T.col(kind), EDGE_KINDS, "references")


def symbol_table(nodes: DataFrame) -> DataFrame:
    """(family, key, node_id): every key under which a definition is found."""
    f, name, path, language = family("language"), F.col("name"), F.col("path"), F.col("language")
    js = language.isin(*JS)
    top = F.col("parent").isNull()
    prefix = T.js_module("path")
    folder = T.directory("path")
    keyed = lambda test, *parts: F.when(test, F.concat(*parts))
    bare = (name != F.col("qname")) & ((f != "php") | F.col("kind").isin(*PHP_BARE))
    keys = F.array(
        F.col("qname"),
        F.when(bare, name),
        keyed(js, prefix, F.lit("#local#"), name),
        keyed(js & top, prefix, F.lit("#"), name),
        keyed(js & top & F.endswith(prefix, F.lit("/index")), F.regexp_replace(prefix, "/index$", ""), F.lit("#"), name),
        keyed((language == "python") & top & (T.python_module("path") != ""), T.python_module("path"), F.lit("."), name),
        keyed((language == "go") & top & (folder != ""), folder, F.lit("#"), name),
        keyed((language == "rust") & top & (T.rust_module("path") != ""), T.rust_module("path"), F.lit("::"), name),
    )
    rows = nodes.select(f.alias("family"), F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))).alias("key"), "node_id")
    return rows.distinct()


def unique(symbols: DataFrame) -> DataFrame:
    """(family, key, node_id) of keys that name exactly one definition."""
    counted = symbols.groupBy("family", "key").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
    return counted.filter("n = 1").drop("n")


def js_resolved(module: Column, path: Column, project: Project) -> Column:
    """Path of a module without extension; null for packages from outside the tree."""
    relative = module.isin(".", "..") | F.startswith(module, F.lit("./")) | F.startswith(module, F.lit("../"))
    out = F.when(relative, T.normal_path(F.concat(T.directory(path), F.lit("/"), module)))
    for pattern, target in project.aliases:
        head, star, last = pattern.partition("*")
        if star:
            hit = F.startswith(module, F.lit(head)) & F.endswith(module, F.lit(last)) & (F.length(module) >= len(head) + len(last))
            caught = F.substring(module, F.lit(len(head) + 1), F.length(module) - len(head) - len(last))
            to = F.replace(F.lit(target), F.lit("*"), caught)
        else:
            hit, to = module == pattern, F.lit(target.replace("*", ""))
        out = out.when(hit, T.normal_path(F.concat(F.lit(project.base_url + "/"), to)))
    return out


def _js(refs: DataFrame, project: Project) -> DataFrame:
    kind, name, qname, path = (F.col(c) for c in ("kind", "name", "qname", "path"))
    module, symbol = F.substring_index(qname, "#", 1), F.expr("substring(qname, instr(qname, '#') + 1)")
    hashed = F.contains(qname, F.lit("#"))
    bound = F.concat(js_resolved(module, path, project), F.lit("#"), symbol)
    local = F.concat(T.js_module("path"), F.lit("#local#"), name)
    new = (
        F.when(kind.isin("import_esm", "import_cjs"), F.coalesce(js_resolved(name, path, project), qname))
        .when(kind.isin("import_named", "import_default", "import_namespace"), F.coalesce(F.concat(js_resolved(qname, path, project), F.lit("#"), name), qname))
        .when(kind.isin("call", "jsx_component", "member_call", "member_access") & hashed, F.coalesce(bound, qname))
        .when(kind.isin("call", "jsx_component") & qname.isNull() & T.is_identifier("name"), local)
        .otherwise(qname)
    )
    return refs.withColumn("qname", new)


def _python(refs: DataFrame, project: Project) -> DataFrame:
    spark = refs.sparkSession
    packages = spark.createDataFrame([(p,) for p in project.packages], "package string")
    heads = runtime.small(packages.select(F.substring_index("package", "/", 1).alias("head")).filter("head != ''").distinct())
    suffix = F.concat(F.lit("."), F.col("name"))
    stripped = F.when(F.endswith("qname", suffix), F.substring(F.col("qname"), F.lit(1), F.length("qname") - F.length(suffix))).otherwise(F.col("qname"))
    rows = refs.withColumn("_m", F.coalesce(stripped, F.col("name")))
    rows = rows.withColumn("_dots", F.length(F.regexp_extract("_m", r"^\.*", 0))).withColumn("_rest", F.regexp_replace("_m", r"^\.+", ""))
    parts = F.filter(F.split(T.directory("path"), "/"), lambda p: p != "")
    up = F.size(parts) - (F.col("_dots") - 1)
    rows = rows.withColumn("_base", F.when((F.col("_dots") > 0) & (up >= 0), F.array_join(F.slice(parts, F.lit(1), F.greatest(up, F.lit(0))), "/")))
    rows = rows.join(heads, F.substring_index("_m", ".", 1) == F.col("head"), "left").join(runtime.small(packages.distinct()), F.col("_base") == F.col("package"), "left")
    dotted = F.replace(F.col("_base"), F.lit("/"), F.lit("."))
    there = F.when(F.col("_rest") == "", dotted).when(dotted == "", F.col("_rest")).otherwise(F.concat(dotted, F.lit("."), F.col("_rest")))
    resolved = F.when(F.col("_dots") == 0, F.when(F.col("head").isNotNull(), F.col("_m"))).when((F.col("_base") == "") | F.col("package").isNotNull(), there)
    new = F.when(F.col("qname").isNotNull(), F.concat(resolved, suffix)).otherwise(resolved)
    return rows.withColumn("qname", F.when(F.col("kind") == "import", F.coalesce(new, "qname")).otherwise(F.col("qname"))).select(*refs.columns)


def _bindings(rows: DataFrame, local: Column, value: Column) -> DataFrame:
    """(b_path, b_local, b_value): the last binding of each local name of a file."""
    return rows.groupBy(F.col("path").alias("b_path"), local.alias("b_local")).agg(F.max_by(value, F.col("id")).alias("b_value"))


def _go(refs: DataFrame, project: Project) -> DataFrame:
    module = project.go_module
    if module is None:
        return refs
    name = F.col("name")
    inside = F.when(name == module, "").when(F.startswith(name, F.lit(module + "/")), F.substring(name, F.lit(len(module) + 2), F.length(name)))
    rows = refs.withColumn("qname", F.when(F.col("kind") == "import_go", F.coalesce(inside, "qname")).otherwise(F.col("qname")))
    found = rows.filter((F.col("kind") == "import_go") & F.col("alias").isNotNull()).withColumn("_in", inside).filter("_in is not null")
    bound = _bindings(found, F.col("alias"), F.col("_in"))
    use = F.col("kind").isin("go_selector_call", "instantiates") & F.contains("qname", F.lit("#"))
    rows = rows.withColumn("_local", F.when(use, F.substring_index("qname", "#", 1)))
    rows = rows.join(bound, (F.col("path") == F.col("b_path")) & (F.col("_local") == F.col("b_local")), "left")
    new = F.when(F.col("b_value").isNotNull(), F.concat("b_value", F.lit("#"), F.expr("substring(qname, instr(qname, '#') + 1)"))).otherwise(F.col("qname"))
    return rows.withColumn("qname", new).select(*refs.columns)


def rust_normal(raw: Column, module: Column) -> Column:
    """A Rust path from the crate's root: crate::, self:: and one super:: are resolved."""
    path = F.regexp_replace(F.regexp_replace(F.trim(raw), ";+$", ""), "[ \n\t]", "")
    parent = F.when(F.contains(module, F.lit("::")), F.regexp_replace(module, "::[^:]*$", "")).otherwise("")
    below = lambda base, rest: F.when(base == "", rest).otherwise(F.concat(base, F.lit("::"), rest))
    return (
        F.when(F.startswith(path, F.lit("crate::")), F.regexp_replace(path, "^crate::", ""))
        .when(F.startswith(path, F.lit("self::")), below(module, F.regexp_replace(path, "^self::", "")))
        .when(F.startswith(path, F.lit("super::")), below(parent, F.regexp_replace(path, "^super::", "")))
        .otherwise(path)
    )


def _rust(refs: DataFrame) -> DataFrame:
    module = T.rust_module("path")
    known = F.col("kind").isin("import_rust", "rust_call") & F.col("qname").isNotNull()
    rows = refs.withColumn("qname", F.when(known, rust_normal(F.col("qname"), module)).otherwise(F.col("qname")))
    bound = _bindings(rows.filter("kind = 'import_rust' and qname is not null"), F.coalesce("alias", "name"), F.col("qname"))
    rows = rows.withColumn("_local", F.when((F.col("kind") == "rust_call") & F.col("qname").isNull(), F.col("name")))
    rows = rows.join(bound, (F.col("path") == F.col("b_path")) & (F.col("_local") == F.col("b_local")), "left")
    return rows.withColumn("qname", F.coalesce("qname", "b_value")).select(*refs.columns)


def rewritten(refs: DataFrame, project: Project) -> DataFrame:
    """refs with qname resolved against the tree's imports, language by language."""
    out = _js(refs.filter(F.col("language").isin(*JS)), project)
    out = out.unionByName(_python(refs.filter("language = 'python'"), project))
    out = out.unionByName(_go(refs.filter("language = 'go'"), project))
    out = out.unionByName(_rust(refs.filter("language = 'rust'")))
    return out.unionByName(refs.filter(F.col("language").isin("php", "blade")))


def lookup_key(refs: DataFrame) -> Column:
    """The key under which a reference is looked up; null if it must not be."""
    f, kind, qname = family("language"), F.col("kind"), F.col("qname")
    precise = ((f == "js") & kind.isin("call", "member_call", "member_access", "jsx_component")) | ((f == "go") & (kind == "go_selector_call"))
    member = (f == "php") & kind.isin("method_call", "static_call", "nullsafe_method_call")
    return F.when(precise, F.when(F.contains(qname, F.lit("#")), qname)).when(member, F.when(F.contains(qname, F.lit("::")), qname)).otherwise(F.coalesce(qname, F.col("name")))


def _first_keys(symbols: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The definitions under keys in use, as three tables: (family, key, earlier, nodes), up
    to about CHUNK definitions a row, with the other keys that come before this one for
    them; (family, key, other), the keys that come before a key for any definition;
    (family, key, node_id) of definitions with more than MANY_KEYS keys, which are in
    neither.  Of a definition's keys the one with the most definitions comes first, so a key
    has few before it: a name comes before the qualified names that end in it."""
    known = runtime.written(symbols.join(runtime.small(used), ["family", "key"], "left_semi").select("family", "key", "node_id").distinct(), "known")
    count = known.groupBy("family", "key").agg(F.count("*").alias("n"))
    keys = known.groupBy("node_id").agg(F.count("*").alias("keys"))
    known = runtime.written(known.join(runtime.small(count), ["family", "key"]).join(keys, "node_id"), "known")
    several = known.filter((F.col("keys") > 1) & (F.col("keys") <= MANY_KEYS))
    order = several.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "family", "key"))).alias("all"))
    order = order.select("node_id", F.posexplode(F.transform("all", lambda k: F.struct(k["family"].alias("family"), k["key"].alias("key")))).alias("at", "k"), "all")
    before = F.transform(F.slice("all", F.lit(1), F.col("at")), lambda k: F.struct(k["family"].alias("family"), k["key"].alias("key")))
    order = order.select("node_id", "k.family", "k.key", (-F.element_at("all", F.col("at") + 1)["n"]).alias("n"), before.alias("earlier"))
    first = known.filter("keys = 1").select("node_id", "family", "key", "n", F.array().cast(order.schema["earlier"].dataType).alias("earlier")).unionByName(order)
    chunk = F.pmod(F.xxhash64("node_id"), F.ceil(F.col("n") / CHUNK))
    nodes = first.groupBy("family", "key", "earlier", chunk.alias("chunk")).agg(F.collect_list("node_id").alias("nodes")).drop("chunk")
    pairs = order.select("family", "key", F.explode("earlier").alias("other")).distinct()
    return nodes, pairs, known.filter(F.col("keys") > MANY_KEYS).select("family", "key", "node_id")


def _packed(*columns: str) -> Column:
    """Strings as one, which takes less of a shuffle than a struct: lengths, then bytes."""
    return F.concat(*(F.concat(F.octet_length(c).cast("string"), F.lit(" ")) for c in columns), *columns)


def _unpacked(packed: str, *columns: str) -> list[Column]:
    head = F.substring_index(packed, " ", len(columns))
    start, out = F.octet_length(head) + 2, []
    for i, c in enumerate(columns):
        n = F.substring_index(F.substring_index(head, " ", i + 1), " ", -1).cast("int")
        out.append(F.substring(F.col(packed).cast("binary"), start, n).cast("string").alias(c))
        start = start + n
    return out


def _tiled(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """References dealt by tiles, those of some files under some keys, and in order of their
    keys.  The edges of a tile have few different sources and few different targets, and
    those of a key repeat one list of targets, so they compress well; a key with many
    references or definitions is in the tiles of many files."""
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n))
    down = max(1, -(-size // TILE_BYTES))
    most = keys.groupBy(part(down, "family", "key").alias("g")).agg(F.sum(F.col("n") * F.col("m")).alias("edges")).select(F.max("edges")).first()[0] or 0
    length = 2 * F.length("hash") + F.length("place") + 4
    sources = rows.select(F.approx_count_distinct(F.struct("hash", "place")) * F.avg(length)).first()[0] or 0
    across = min(max(1, -(-int(sources) // TILE_BYTES), -(-most // TILE_EDGES)), max(1, TILES // down))
    if across * down > 1:
        inside = F.startswith("place", F.lit(":"))
        tile = part(across, "hash", F.when(~inside, F.col("place"))) * down + part(down, "family", "key")
        rows = rows.repartitionById(across * down, tile.cast("int"))
    # The filter holds for every row; without it the order, which a join need not keep, would
    # be optimised away.
    return rows.sortWithinPartitions("family", "key").filter(F.monotonically_increasing_id() >= 0)


def edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of rewritten refs: one for each definition found under the key.  A reference
    outside of any definition counts only as an import or export, of its file.

    A name that many share gives references x definitions rows, so nothing is shuffled after
    that join: references are made distinct before it, file by file, and where a source refers to a
    definition by several keys, the edge comes from the first of them alone."""
    rows = refs.withColumn("family", family("language")).withColumn("key", lookup_key(refs)).withColumn("ekind", edge_kind("kind"))
    at_file = F.when(F.col("ekind").isin("imports", "exports"), F.concat(F.lit("file:"), "path"))
    # The source is hash in hexadecimal, then place; T.node_id() of a container.
    inside = F.col("container").isNotNull()
    rows = rows.withColumn("hash", F.when(inside, F.col("content_hash")).otherwise(F.lit(b""))).withColumn("place", F.when(inside, F.concat(F.lit(":"), F.col("container").cast("string"))).otherwise(at_file))
    own = ["hash", "place", "ekind"]
    rows = rows.filter("family is not null and key is not null and key != '' and hash is not null and place is not null")
    # Distinct by file: its digest, which does not compress, is shuffled once a task and not
    # with each reference, and then stands on neighbouring rows.
    of_file = F.when(inside, "").otherwise(F.col("place")).alias("file")
    parts = ["family", "key", "place", "ekind"]
    files = rows.groupBy("hash", of_file).agg(F.collect_set(_packed(*parts)).alias("refs"))
    rows = files.select("hash", F.explode("refs").alias("ref")).select("hash", *_unpacked("ref", *parts))
    rows = runtime.written(rows.select("family", "key", *own), "references")
    runtime.swept(rows.sparkSession)
    used = runtime.written(rows.groupBy("family", "key").agg(F.count("*").alias("m")), "used")
    nodes, pairs, many = _first_keys(symbols, used.select("family", "key"))
    pairs, many = runtime.written(pairs, "pairs"), runtime.written(many, "many")
    shown = rows.withColumn("seen", F.lit(None).cast(nodes.schema["earlier"].dataType))
    if not pairs.isEmpty():
        others = rows.select(F.struct("family", "key").alias("other"), *own)
        both = rows.join(runtime.small(pairs), ["family", "key"]).join(others, ["other", *own])
        seen = runtime.written(both.groupBy("family", "key", *own).agg(F.collect_set("other").alias("seen")), "seen")
        shown = rows.join(runtime.small(seen), ["family", "key", *own], "left")
    source = F.concat(F.lower(F.hex("hash")), "place").alias("source_node_id")
    nodes = runtime.written(nodes, "definitions")
    weight = F.aggregate("nodes", F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 4)
    keys = nodes.groupBy("family", "key").agg(F.sum(F.size("nodes")).alias("n"), F.sum(weight).alias("bytes")).join(used, ["family", "key"])
    size = keys.select(F.sum("bytes")).first()[0] or 0
    # At most BROADCAST_BYTES.
    if size <= BROADCAST_BYTES:
        nodes, shown = F.broadcast(nodes), _tiled(shown, keys, size)
    out = shown.join(nodes, ["family", "key"]).filter("seen is null or not arrays_overlap(earlier, seen)")
    out = out.select(source, F.col("ekind").alias("kind"), "nodes").select("source_node_id", "kind", F.explode("nodes").alias("target_node_id"))
    if not many.isEmpty():
        out = out.unionByName(rows.join(many, ["family", "key"]).select(source, F.col("ekind").alias("kind"), F.col("node_id").alias("target_node_id")).distinct())
    return out.withColumns({"provenance": F.lit("parser_extract"), "confidence": F.lit(80)})


def merged(*parts: DataFrame) -> DataFrame:
    """Edges without repeats of (source, kind, target); the most confident stays."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max(F.struct("confidence", "provenance")).alias("b")
    return out.groupBy("source_node_id", "kind", "target_node_id").agg(best).select("source_node_id", "kind", "target_node_id", "b.provenance", "b.confidence")
