"""Extraction, resolution and framework rules over a small tree of files in several
languages, each with forms of its own; the rows that must come out are listed as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import extract, runtime
from ..functions import text as T
from ..operators import framework, resolve
from ..operators.resolve import Project
from ..sources.tables import read

TREE = {
    "lib/util.js": "import def, * as all from './other';\nimport './side';\nconst fs = require('fs');\nconst { read: rd } = require('./io');\nexport default function start() { return rd(fs.open(1)); }\nclass Box extends Crate { put(x) { this.items.push(x); } }\nmodule.exports = { Box, start };\nexports.more = start;\n",
    "src/types.ts": "import type { Row } from '@app/rows';\nexport interface Shape { area(): number }\nexport type Pair = [Row, Shape];\nexport enum Mode { On, Off }\nexport abstract class Base implements Shape { area(): number { return 1; } }\nexport const make = (r: Row): Base => new Base();\n",
    "src/app/rows.ts": "export interface Row { id: number }\nexport function rows(): Row[] { return []; }\n",
    "src/main.ts": "import { rows as load } from '@app/rows';\nimport { make } from './types';\nexport function main() { return make(load()[0]); }\n",
    "pkg/__init__.py": "",
    "pkg/core/__init__.py": "",
    "pkg/core/base.py": "class Base:\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n",
    "pkg/core/user.py": "from .base import Base as B, helper\nfrom ..tools import *\nimport pkg.core.base\n\nclass User(B):\n    def go(self):\n        return helper()\n",
    "pkg/tools.py": "async def tool(x):\n    return x\n",
    "cmd/main.go": 'package main\n\nimport (\n\tst "example.com/app/store"\n\t"fmt"\n)\n\nconst Limit = 3\n\nvar cache = 1\n\nfunc main() {\n\tst.Open(Limit)\n\tfmt.Println(cache)\n}\n',
    "store/store.go": "package store\n\ntype Store interface {\n\tClose() error\n}\n\nfunc Open(n int) int { return n }\n",
    "src/lib.rs": "mod net;\nuse crate::net::{dial as call_up, Link};\npub const PORT: u16 = 1;\npub trait Peer { fn meet(&self); }\npub enum State { Up, Down }\npub fn start() { call_up(); self::inner(); }\nfn inner() {}\n",
    "src/net.rs": "use super::PORT;\npub struct Link;\npub fn dial() { super::start(); }\nimpl Link { pub fn open() {} }\n",
    "app/Models/Post.php": "<?php\nnamespace App\\Models;\nuse App\\Jobs\\{Send, Clean as Wipe};\nuse App\\Events\\Posted;\n\nclass Post extends Model {\n    public function user() { return $this->belongsTo(User::class); }\n    public function tags() { return $this->hasMany($kind); }\n    public function publish() {\n        event(new Posted($this));\n        dispatch(new Send());\n        return view('posts.show');\n    }\n}\n",
    "app/Providers/AppProvider.php": "<?php\nnamespace App\\Providers;\n\nclass AppProvider {\n    public function register() {\n        $this->app->bind(Store::class, DiskStore::class);\n        $this->app->singleton('clock', Clock::class);\n    }\n}\n",
    "resources/views/posts/show.blade.php": "@extends('layouts.main')\n@include('posts.parts')\n<x-card/>\n",
    "web/Panel.tsx": "import { useState } from 'react';\nexport function useThing() { return useState(0); }\nexport function Panel() { useThing(); return <Side/>; }\nclass Old extends React.Component { render() { return null; } }\nconst Memo = memo(Panel);\n",
    "bad/broken.py": "def half(:\n    pass\n",
    "bad/broken.go": "package bad\n\nfunc half( {\n",
    "bad/fine.py": "x = 1\n",
}
PROJECT = Project(base_url="src", aliases=(("@app/*", "app/*"),), go_module="example.com/app", packages=("pkg", "pkg/core"))


def _facts(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(TREE.items()), "path string, source string")
    rows = rows.select("path", T.language("path").alias("language"), F.col("source").cast("binary").alias("content"))
    return runtime.written(extract.extracted(rows.withColumn("content_hash", T.content_hash("content"))), "facts")


def _local(path: str):
    return F.col("path").startswith(path)


def _nodes(*paths: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = extract.nodes(_facts(spark)).filter(F.col("path").isin(*paths))
        return rows.select("path", "kind", "name", F.coalesce("qname", F.lit("")).alias("qname"))

    return query


def _refs(*paths: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = extract.refs(_facts(spark)).filter(F.col("path").isin(*paths))
        return rows.select("path", "kind", "name", F.coalesce("qname", F.lit("")).alias("qname"), F.coalesce("alias", F.lit("")).alias("alias"))

    return query


def _resolved(language: str):
    """Resolved edges between named definitions of one language: (source, kind, target)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = _facts(spark)
        nodes = extract.nodes(facts)
        symbols = resolve.symbol_table(nodes)
        refs = extract.refs(facts).filter(F.col("language") == language)
        edges = resolve.edges(resolve.rewritten(refs, PROJECT), symbols)
        names = nodes.select("node_id", F.concat_ws(" ", "path", "qname").alias("named"))
        rows = edges.join(names.select(F.col("node_id").alias("target_node_id"), F.col("named").alias("target")), "target_node_id")
        rows = rows.join(names.select(F.col("node_id").alias("source_node_id"), F.col("named").alias("s")), "source_node_id", "left")
        return rows.select(F.coalesce("s", "source_node_id").alias("source"), "kind", "target")

    return query


def _framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All framework edges of the tree: relations, bindings, events, jobs, Blade, React."""
    facts = _facts(spark)
    nodes, refs = extract.nodes(facts), extract.refs(facts)
    edges = framework.laravel(extract.calls(facts.filter("language = 'php'"))).unionByName(framework.blade(refs)).unionByName(framework.react(nodes, refs))
    return edges.select("source_node_id", "kind", "target_node_id", "confidence")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framework.views(extract.calls(_facts(spark).filter("language = 'php'"))).select("scope", "view")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framework.diagnostics(extract.calls(_facts(spark).filter("language = 'php'"))).select("scope", "message")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse."""
    return extract.diagnostics(_facts(spark)).select("path").distinct()


ALL = {
    "extract_js_forms_nodes": _nodes("lib/util.js"),
    "extract_js_forms_refs": _refs("lib/util.js"),
    "extract_ts_forms_nodes": _nodes("src/types.ts"),
    "extract_ts_forms_refs": _refs("src/types.ts"),
    "extract_python_forms_refs": _refs("pkg/core/user.py"),
    "extract_php_forms_refs": _refs("app/Models/Post.php"),
    "extract_go_forms_nodes": _nodes("cmd/main.go", "store/store.go"),
    "extract_rust_forms_nodes": _nodes("src/lib.rs", "src/net.rs"),
    "resolve_python": _resolved("python"),
    "resolve_ts": _resolved("typescript"),
    "resolve_go": _resolved("go"),
    "resolve_rust": _resolved("rust"),
    "framework_edges": _framework,
    "framework_views": _views,
    "framework_diagnostics": _messages,
    "syntax_diagnostics": _broken,
}


#: Column names and the rows that must come out of each query.
EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "extract_js_forms_nodes": (
        "path, kind, name, qname",
        [
            ('lib/util.js', 'class', 'Box', 'Box'),
            ('lib/util.js', 'function', 'start', 'start'),
            ('lib/util.js', 'method', 'put', 'put'),
            ('lib/util.js', 'variable', 'fs', 'fs'),
        ],
    ),
    "extract_js_forms_refs": (
        "path, kind, name, qname, alias",
        [
            ('lib/util.js', 'call', 'rd', '', ''),
            ('lib/util.js', 'export_cjs', 'exports.more', '', ''),
            ('lib/util.js', 'export_cjs', 'module.exports', '', ''),
            ('lib/util.js', 'export_esm', 'start', '', ''),
            ('lib/util.js', 'import_cjs', './io', '', ''),
            ('lib/util.js', 'import_cjs', 'fs', '', ''),
            ('lib/util.js', 'import_default', 'default', './other', 'def'),
            ('lib/util.js', 'import_esm', './other', '', ''),
            ('lib/util.js', 'import_esm', './side', '', ''),
            ('lib/util.js', 'import_namespace', '*', './other', 'all'),
            ('lib/util.js', 'member_access', 'exports', '', ''),
            ('lib/util.js', 'member_access', 'items', '', ''),
            ('lib/util.js', 'member_access', 'more', '', ''),
            ('lib/util.js', 'member_call', 'open', '', ''),
            ('lib/util.js', 'member_call', 'push', '', ''),
        ],
    ),
    "extract_ts_forms_nodes": (
        "path, kind, name, qname",
        [
            ('src/types.ts', 'arrow_function', 'make', 'make'),
            ('src/types.ts', 'class', 'Base', 'Base'),
            ('src/types.ts', 'interface', 'Shape', 'Shape'),
            ('src/types.ts', 'method', 'area', 'area'),
            ('src/types.ts', 'type_alias', 'Pair', 'Pair'),
        ],
    ),
    "extract_ts_forms_refs": (
        "path, kind, name, qname, alias",
        [
            ('src/types.ts', 'export_esm', 'Base', '', ''),
            ('src/types.ts', 'export_esm', 'Mode', '', ''),
            ('src/types.ts', 'export_esm', 'Pair', '', ''),
            ('src/types.ts', 'export_esm', 'Shape', '', ''),
            ('src/types.ts', 'export_esm', 'make', '', ''),
            ('src/types.ts', 'import_esm', '@app/rows', '', ''),
            ('src/types.ts', 'import_named', 'Row', '@app/rows', 'Row'),
            ('src/types.ts', 'type_reference', 'Base', '', ''),
            ('src/types.ts', 'type_reference', 'Row', '', ''),
            ('src/types.ts', 'type_reference', 'Row', '', ''),
            ('src/types.ts', 'type_reference', 'Shape', '', ''),
            ('src/types.ts', 'type_reference', 'Shape', '', ''),
        ],
    ),
    "extract_python_forms_refs": (
        "path, kind, name, qname, alias",
        [
            ('pkg/core/user.py', 'call', 'helper', '', ''),
            ('pkg/core/user.py', 'import', '*', '..tools.*', ''),
            ('pkg/core/user.py', 'import', 'Base', '.base.Base', 'B'),
            ('pkg/core/user.py', 'import', 'helper', '.base.helper', ''),
            ('pkg/core/user.py', 'import', 'pkg.core.base', '', ''),
            ('pkg/core/user.py', 'inheritance', 'B', '', ''),
        ],
    ),
    "extract_php_forms_refs": (
        "path, kind, name, qname, alias",
        [
            ('app/Models/Post.php', 'call', 'dispatch', 'dispatch', ''),
            ('app/Models/Post.php', 'call', 'event', 'event', ''),
            ('app/Models/Post.php', 'call', 'view', 'view', ''),
            ('app/Models/Post.php', 'extends', 'Model', 'Model', ''),
            ('app/Models/Post.php', 'import', 'Posted', 'App\\Events\\Posted', ''),
            ('app/Models/Post.php', 'import', 'Send', 'App\\Jobs\\Send', ''),
            ('app/Models/Post.php', 'import', 'Wipe', 'App\\Jobs\\Clean', ''),
            ('app/Models/Post.php', 'method_call', 'belongsTo', 'App\\Models\\Post::belongsTo', ''),
            ('app/Models/Post.php', 'method_call', 'hasMany', 'App\\Models\\Post::hasMany', ''),
        ],
    ),
    "extract_go_forms_nodes": (
        "path, kind, name, qname",
        [
            ('cmd/main.go', 'constant', 'Limit', 'Limit'),
            ('cmd/main.go', 'function', 'main', 'main'),
            ('cmd/main.go', 'variable', 'cache', 'cache'),
            ('store/store.go', 'function', 'Open', 'Open'),
            ('store/store.go', 'interface', 'Store', 'Store'),
        ],
    ),
    "extract_rust_forms_nodes": (
        "path, kind, name, qname",
        [
            ('src/lib.rs', 'constant', 'PORT', 'PORT'),
            ('src/lib.rs', 'enum', 'State', 'State'),
            ('src/lib.rs', 'function', 'inner', 'inner'),
            ('src/lib.rs', 'function', 'start', 'start'),
            ('src/lib.rs', 'method', 'meet', 'Peer.meet'),
            ('src/lib.rs', 'module', 'net', 'net'),
            ('src/lib.rs', 'trait', 'Peer', 'Peer'),
            ('src/net.rs', 'function', 'dial', 'dial'),
            ('src/net.rs', 'method', 'open', 'Link.open'),
            ('src/net.rs', 'struct', 'Link', 'Link'),
        ],
    ),
    "resolve_python": (
        "source, kind, target",
        [
            ('file:pkg/core/user.py', 'imports', 'pkg/core/base.py Base'),
            ('file:pkg/core/user.py', 'imports', 'pkg/core/base.py helper'),
            ('pkg/core/base.py Base.run', 'calls', 'pkg/core/base.py helper'),
            ('pkg/core/user.py User.go', 'calls', 'pkg/core/base.py helper'),
        ],
    ),
    "resolve_ts": (
        "source, kind, target",
        [
            ('file:src/app/rows.ts', 'exports', 'src/app/rows.ts Row'),
            ('file:src/app/rows.ts', 'exports', 'src/app/rows.ts rows'),
            ('file:src/main.ts', 'exports', 'src/main.ts main'),
            ('file:src/main.ts', 'imports', 'src/app/rows.ts rows'),
            ('file:src/main.ts', 'imports', 'src/types.ts make'),
            ('file:src/types.ts', 'exports', 'src/types.ts Base'),
            ('file:src/types.ts', 'exports', 'src/types.ts Pair'),
            ('file:src/types.ts', 'exports', 'src/types.ts Shape'),
            ('file:src/types.ts', 'exports', 'src/types.ts make'),
            ('file:src/types.ts', 'imports', 'src/app/rows.ts Row'),
            ('src/app/rows.ts rows', 'references', 'src/app/rows.ts Row'),
            ('src/main.ts main', 'calls', 'src/app/rows.ts rows'),
            ('src/main.ts main', 'calls', 'src/types.ts make'),
            ('src/types.ts Base', 'references', 'src/types.ts Shape'),
            ('src/types.ts Pair', 'references', 'src/app/rows.ts Row'),
            ('src/types.ts Pair', 'references', 'src/types.ts Shape'),
            ('src/types.ts make', 'references', 'src/app/rows.ts Row'),
            ('src/types.ts make', 'references', 'src/types.ts Base'),
        ],
    ),
    "resolve_go": (
        "source, kind, target",
        [
            ('cmd/main.go main', 'calls', 'store/store.go Open'),
        ],
    ),
    "resolve_rust": (
        "source, kind, target",
        [
            ('file:src/lib.rs', 'imports', 'src/net.rs Link'),
            ('file:src/lib.rs', 'imports', 'src/net.rs dial'),
            ('file:src/net.rs', 'imports', 'src/lib.rs PORT'),
            ('src/lib.rs start', 'calls', 'src/lib.rs inner'),
            ('src/lib.rs start', 'calls', 'src/net.rs dial'),
            ('src/net.rs dial', 'calls', 'src/lib.rs start'),
        ],
    ),
    "framework_edges": (
        "source_node_id, kind, target_node_id, confidence",
        [
            ('lh:App\\Models\\Post\\publish', 'dispatches_event', 'lh:Posted', 90),
            ('lh:App\\Models\\Post\\publish', 'dispatches_job', 'lh:Send', 90),
            ('lh:App\\Models\\Post\\user', 'relates_to', 'lh:User', 90),
            ('lh:Memo', 'react_component', 'lh:react.component', 70),
            ('lh:Panel', 'react_component', 'lh:react.component', 90),
            ('lh:Panel', 'react_uses_hook', 'lh:react.hook.useThing', 70),
            ('lh:Store', 'binds', 'lh:DiskStore', 90),
            ('lh:useThing', 'react_hook', 'lh:react.hook', 90),
            ('lh:useThing', 'react_uses_hook', 'lh:react.hook.useState', 90),
            ('lh:view.posts.show', 'extends_view', 'lh:view.layouts.main', 90),
            ('lh:view.posts.show', 'includes_view', 'lh:view.posts.parts', 90),
            ('lh:view.posts.show', 'uses_component', 'lh:component.card', 90),
        ],
    ),
    "framework_views": (
        "scope, view",
        [
            ('App\\Models\\Post\\publish', 'posts.show'),
        ],
    ),
    "framework_diagnostics": (
        "scope, message",
        [
            ('App\\Models\\Post\\tags', 'hasMany: the related model is not a class constant'),
            ('App\\Providers\\AppProvider\\register', 'singleton: the abstract is not a class constant'),
        ],
    ),
    "syntax_diagnostics": (
        "path",
        [
            ('bad/broken.go',),
            ('bad/broken.py',),
        ],
    ),
}


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    quoted = F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    return part.select("p_partkey", T.unquoted(quoted).alias("bare"), T.tail("p_name", " ").alias("last"), T.tail(F.concat(F.lit("App\\"), F.col("p_brand")), "\\").alias("short"))


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times, and the same a lifetime earlier, before 1970."""
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", T.epoch_seconds(ts).alias("seconds"), T.epoch_seconds(ts - F.expr("INTERVAL 40000 DAYS")).alias("before"))


def _literal(value: object) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns})"


QUERIES = {name: (query, _values(*EXPECTED[name])) for name, query in ALL.items()} | {
    "text_pieces": (_pieces, "SELECT p_partkey, p_name AS bare, split_part(p_name, ' ', -1) AS last, p_brand AS short FROM part"),
    "event_seconds": (
        _seconds,
        "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds, CAST(-((-epoch_us(ts - INTERVAL 40000 DAYS)) // 1000000) AS BIGINT) AS before FROM events",
    ),
}
