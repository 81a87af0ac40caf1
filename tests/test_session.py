"""End to end: trees to graphs, updates, snapshots, streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphlens import extract, index
from graphlens.operators import changes, framework, resolve
from graphlens.session import GraphSession
from graphlens.sources import scan
from graphlens.store import Store

TREE = {
    "helper.ts": "export function helper() { return 1; }\n",
    "app.ts": "import { helper } from './helper';\nexport function main() { return helper(); }\n",
    "lib/money.ts": "export function format(x) { return x; }\n",
    "components/Price.tsx": "function format(v) { return v; }\nexport const Price = () => <b>{format(1)}</b>;\n",
    "pages/show.tsx": "import { format } from '../lib/money';\nexport function Show() { return <p>{format(2)}</p>; }\n",
    "util/index.ts": "export const join = () => 1;\n",
    "useutil.ts": "import { join } from './util';\nimport { log } from '@app/log';\nexport function go() { log(); return join(); }\n",
    "src/shared/log.ts": "export function log() {}\n",
    "tsconfig.json": '{\n // aliases\n "compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["shared/*"],},},\n}\n',
    "list.ts": "export function map() {}\nexport function run(xs) { return xs.map(x => x); }\n",
    "components/Button.tsx": "export const Button = () => <button>ok</button>;\n",
    "pages/Page.tsx": "import { Button } from '../components/Button';\nimport { useState } from 'react';\nexport function Page() { const [a] = useState(0); return <Button/>; }\n",
    "hooks/useCounter.ts": "import { useState } from 'react';\nexport function useCounter() { return useState(0); }\n",
    "pkg/__init__.py": "",
    "pkg/_util.py": "def fmt(x):\n    return x\n",
    "pkg/app.py": "from ._util import fmt\nfrom pkg._util import fmt as again\nimport os\nclass A(Base):\n    def run(self):\n        return fmt(1)\n",
    "routes/web.php": "<?php\nuse App\\Http\\UserController;\nRoute::get('/users', [UserController::class, 'index']);\nRoute::post('/u', 'UserController@store');\n",
    "app/Models/User.php": "<?php\nnamespace App\\Models;\nclass User { public function posts() { return $this->hasMany(Post::class); } }\n",
    "app/Services/NavResolver.php": "<?php\nnamespace App\\Services;\nclass NavResolver { public function resolve() {} }\n",
    "app/Services/Other.php": "<?php\nnamespace App\\Services;\nclass Other { public function resolve() {} }\n",
    "app/Services/Menu.php": "<?php\nnamespace App\\Services;\nclass Menu { public function __construct(private NavResolver $nav) {} public function show() { $this->nav->resolve(); Log::info('x'); event(new Shown($this)); dispatch(new Job); $x->resolve(); } }\n",
    "app/Providers/P.php": "<?php\nclass P { public function register() { $this->app->bind(Abs::class, Conc::class); Post::find(1); } }\n",
    "resources/views/users/index.blade.php": "@extends('layouts.app')\n@include('partials.nav')\n<x-alert/>\n@component('card')@endcomponent\n",
    "go.mod": "module example.com/app // x\n",
    "internal/server/server.go": "package server\nfunc Start() {}\n",
    "cmd/main.go": 'package main\nimport srv "example.com/app/internal/server"\nfunc main() { srv.Start() }\n',
    "src/server.rs": "pub fn stop() {}\n",
    "src/main.rs": "use crate::server::stop;\nfn main() { stop(); }\n",
    ".gitignore": "skip/\n*.gen.py\n!keep.gen.py\n",
    "skip/a.py": "def no(): pass\n",
    "x.gen.py": "def no(): pass\n",
    "keep.gen.py": "def yes(): pass\n",
    "node_modules/m.js": "function no() {}\n",
    "notes.txt": "text",
}


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    root, store = tmp_path_factory.mktemp("tree"), tmp_path_factory.mktemp("store")
    for path, text in TREE.items():
        put(root, path, text)
    s = GraphSession(spark, str(root), str(store))
    s.summary = s.sync().first()
    return s


def edges(session):
    """Edges with names instead of ids."""
    names = {r.node_id: f"{r.path}:{r.qname}" for r in session.nodes.collect()}
    return {(names.get(r.source_node_id, r.source_node_id), r.kind, names.get(r.target_node_id, r.target_node_id)) for r in session.edges.collect()}


def test_scan_and_rules(session):
    paths = {r.path for r in session.store.files().collect()}
    assert paths == {p for p in TREE if p.endswith((".ts", ".tsx", ".py", ".php", ".go", ".rs"))} - {"skip/a.py", "x.gen.py"}
    assert session.summary.files_scanned == session.summary.files_indexed == len(paths)


def test_resolution(session):
    got = edges(session)
    calls = {(a, b) for a, k, b in got if k == "calls"}
    assert ("app.ts:main", "helper.ts:helper") in calls
    assert ("pages/show.tsx:Show", "lib/money.ts:format") in calls
    assert ("components/Price.tsx:Price", "components/Price.tsx:format") in calls
    assert ("pages/show.tsx:Show", "components/Price.tsx:format") not in calls and ("components/Price.tsx:Price", "lib/money.ts:format") not in calls
    assert ("useutil.ts:go", "util/index.ts:join") in calls and ("useutil.ts:go", "src/shared/log.ts:log") in calls
    assert not any(b == "list.ts:map" for _, b in calls)
    assert ("pkg/app.py:A.run", "pkg/_util.py:fmt") in calls
    assert ("cmd/main.go:main", "internal/server/server.go:Start") in calls
    assert ("src/main.rs:main", "src/server.rs:stop") in calls
    resolve_to = {b for a, b in calls if a == r"app/Services/Menu.php:App\Services\Menu::show" and "resolve" in b}
    assert resolve_to == {r"app/Services/NavResolver.php:App\Services\NavResolver::resolve"}
    assert ("file:app.ts", "imports", "helper.ts:helper") in got and ("file:pkg/app.py", "imports", "pkg/_util.py:fmt") in got
    assert ("pages/Page.tsx:Page", "renders", "components/Button.tsx:Button") in got


def test_framework_edges(session):
    got = edges(session)
    assert ("lh:route:get /users", "routes_to", "lh:UserController::index") in got
    assert ("lh:route:post /u", "routes_to", "lh:UserController::store") in got
    kinds = {(k, b) for _, k, b in got if b.startswith("lh:")}
    assert {("relates_to", "lh:Post"), ("facade_call", "lh:Log::info"), ("dispatches_event", "lh:Shown"), ("dispatches_job", "lh:Job"), ("uses_model", "lh:Post")} <= kinds
    assert ("lh:Abs", "binds", "lh:Conc") in got
    view = "lh:view.users.index"
    assert {(view, "extends_view", "lh:view.layouts.app"), (view, "includes_view", "lh:view.partials.nav"), (view, "uses_component", "lh:component.alert"), (view, "uses_component", "lh:component.card")} <= got
    assert ("lh:Page", "react_component", "lh:react.component") in got and ("lh:useCounter", "react_hook", "lh:react.hook") in got
    assert ("lh:Page", "react_uses_hook", "lh:react.hook.useState") in got
    confidence = {(r.kind, r.target_node_id): r.confidence for r in session.edges.collect()}
    assert confidence["routes_to", "lh:UserController::index"] == 90 and confidence["routes_to", "lh:UserController::store"] == 70 and confidence["uses_model", "lh:Post"] == 70


def test_tools(session):
    helper = session.find_symbol("helper").first().node_id
    main = next(r.node_id for r in session.find_symbol("main").collect() if r.path == "app.ts")
    assert [r.node_id for r in session.callers_of(helper).collect()] == [main]
    assert [r.name for r in session.callees_of(main).collect()] == ["helper"]
    n = session.node(helper).first()
    assert n.source == "function helper() { return 1; }" and n.source_lines == "1\tfunction helper() { return 1; }\n" and n.callers == [main]
    assert session.node("nobody").first().name is None
    assert {r.name for r in session.impact(helper).collect()} >= {"main"}
    assert session.trace(main, helper).first().path == [main, helper]
    assert [r.path for r in session.files("pkg/").collect()] == ["pkg/_util.py", "pkg/app.py"]
    c = session.context("Page", mode="exact").first()
    assert c.total_matches == 1 and "useState" in c.source
    e = session.explore([helper, "nobody:1", main], byte_budget=40).collect()
    assert [(r.pos, r.known) for r in e] == [(0, True), (1, False), (2, True)] and e[0].bytes_used == 40
    assert [r.kind for r in session.nodes_in_file("pkg/app.py").collect()] == ["class", "method"]
    owner = session.find_symbol(r"App\Services\Menu", "class").first().node_id
    assert len(session.node(owner).first().members) == 2
    assert session.status().first().files > 20
    assert session.call("search", name="helper", mode="exact").count() == 1
    for bad in (lambda: session.call("nothing"), lambda: session.search("x" * 10_001), lambda: session.impact("x" * 1025), lambda: session.explore(["x"] * 257), lambda: session.search("x", mode="y")):
        with pytest.raises(ValueError):
            bad()
    assert session.cycles().count() >= 0 and session.module_boundary("pages/", "components/").count() == 1
    assert session.diagnostics().count() == 0 and session.content_files().count() > 10


def test_updates_equal_a_rebuild(session):
    before = {tuple(r) for r in session.edges.collect()}
    put(session.root, "helper.ts", "export function other() { return 1; }\nexport function helper() { return other(); }\n")
    put(session.root, "copy.ts", TREE["app.ts"])
    os.remove(os.path.join(session.root, "keep.gen.py"))
    s = session.sync().first()
    assert (s.files_indexed, s.operation) == (2, "sync")
    assert "keep.gen.py" not in {r.path for r in session.store.files().collect()}
    grown = {tuple(r) for r in session.edges.collect()}
    nodes = {r.node_id for r in session.nodes.collect()}
    assert ("helper.ts:helper", "calls", "helper.ts:other") in edges(session) and grown != before
    session.reindex()
    assert {tuple(r) for r in session.edges.collect()} == grown and {r.node_id for r in session.nodes.collect()} == nodes
    assert session.sync().first().files_indexed == 0
    # Only the named path is taken.
    put(session.root, "pkg/new.py", "def new(): pass\n")
    put(session.root, "pkg/late.py", "def late(): pass\n")
    assert index.apply_changes(session.spark, session.root, session.store, ["pkg/new.py"])["files_indexed"] == 1
    assert session.find_symbol("new").count() == 1 and session.find_symbol("late").count() == 0
    # Files of equal content share a node, of which the first path shows.
    assert session.store.read("active_node").filter("name = 'main' and language = 'typescript'").count() == 2
    assert [r.path for r in session.find_symbol("main").collect() if r.path.endswith(".ts")] == ["app.ts"]


def test_readers_keep_their_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = [("a", "calls", "b", "parser_extract", 80)]
    store.write(edge=spark.createDataFrame(row, store.read("edge").schema))
    old, first = store.read("edge"), store.version()
    store.truncate()
    assert store.version() != first and store.read("edge").count() == 0 and old.count() == 1
    assert Store(spark, str(tmp_path)).version() == store.version()


def test_changes_of_a_stream(spark, tmp_path):
    from graphlens.streaming import apply_stream, change_schema, changes_between

    listing = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime long")
    got = {(r.path, r.kind) for r in changes_between(listing([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]), listing([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)])).collect()}
    assert got == {("b", "modified"), ("c", "deleted"), ("d", "created")}
    events = [("x.py", "created", 1.0, 1), ("y.py", "modified", 1.5, 2), ("x.py", "deleted", 2.0, 3)]
    df = spark.createDataFrame(events, "path string, kind string, t double, seq long").select("path", "kind", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "seq")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = apply_stream(spark.readStream.schema(change_schema).parquet(str(tmp_path / "in")), seen.append, str(tmp_path / "ck"), max_paths=1)
    q.awaitTermination()
    assert seen == [["x.py"], ["y.py"]]


def test_debounced_stream(spark, tmp_path):
    from graphlens.streaming import change_schema, debounced_stream

    events = [("x", "created", 0, 1), ("y", "modified", 60, 2), ("x", "modified", 90, 3), (".gitignore", "created", 500, 4), ("z", "deleted", 20_000, 5)]
    df = spark.createDataFrame(events, "path string, kind string, ms long, seq long").select("path", "kind", F.timestamp_millis("ms").alias("ts"), "seq")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = debounced_stream(spark.readStream.schema(change_schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = sorted((r.created, r.modified, r.deleted, r.ignore_file_changed) for r in spark.sql("select * from debounced").collect())
    assert ([], ["x", "y"], [], False) in got and ([".gitignore"], [], [], True) in got


def plain_sessions(events, gap):
    out, last, n = {}, None, 0
    for path, kind, t, seq in sorted(events, key=lambda e: (e[2], e[3])):
        if last is None or t - last > gap:
            n += 1
        last = t
        old = out.get((n, path))
        out[n, path] = (kind, 1 + (old[1] if old else 0))
    return out


def test_debounced_table(spark):
    rng = random.Random(3)
    events = [(f"p{rng.randrange(4)}", rng.choice(["created", "modified", "deleted"]), float(rng.choice([rng.randrange(60), rng.randrange(40_000)])), i) for i in range(80)]
    df = spark.createDataFrame(events, "path string, kind string, t double, seq long").select("path", "kind", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "seq")
    got = {(r.session, r.path): (r.kind, r.events) for r in changes.debounced(df, 30.0).collect()}
    assert got == plain_sessions(events, 30.0)
    lists = changes.batches(changes.sessions(df, "30 seconds"), ["start"]).collect()
    assert len({r.start for r in lists}) == len(lists) > 1


def test_manifest_and_replacement(spark):
    scanned = spark.createDataFrame([("same", "h", 1), ("dirty-hash", "x", 1), ("dirty-size", "h", 2), ("new", "h", 1), ("dirty-generation", "h", 1)], "path string, content_hash string, size long")
    active = spark.createDataFrame([("same", "h", 1, 5), ("dirty-hash", "h", 1, 5), ("dirty-size", "h", 1, 5), ("gone", "h", 1, 5), ("dirty-generation", "h", 1, 4)], "path string, content_hash string, size long, generation long")
    got = {r.path: r.state for r in changes.manifest_diff(scanned, active).collect()}
    assert got == {"dirty-hash": "dirty", "dirty-size": "dirty", "dirty-generation": "dirty", "new": "missing", "gone": "deleted"}
    assert {r.path for r in changes.unchanged_skipped(scanned, active).collect()} == {"dirty-hash", "new"}
    out = changes.replaced(active, scanned.filter("path = 'same'"), active.limit(0))
    assert out.count() == 4
    versions = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4)], "path string, g long, seq long")
    assert sorted((r.path, r.seq) for r in changes.latest(versions, "path", "g", "seq").collect()) == [("a", 2), ("b", 4)]


def test_enclosing(spark):
    rng = random.Random(1)
    c = [("f", i, a, a + rng.choice([0, 1, 5, 40, 400]), i) for i in range(60) for a in [rng.randrange(500)]]
    p = [("f", i, a, a + rng.choice([0, 1, 9])) for i in range(80) for a in [rng.randrange(500)]]
    got = {r.point_id: r.container_id for r in changes.enclosing(spark.createDataFrame(p, "path string, point_id long, p_start long, p_end long"), spark.createDataFrame(c, "path string, container_id long, c_start long, c_end long, c_order long")).collect()}
    for _, i, s, e in p:
        hits = [(b - a, o, k) for _, k, a, b, o in c if a <= s and b >= e and (a < s or b > e)]
        assert got[i] == (min(hits)[2] if hits else None)


def test_ignore_rules():
    from graphlens.sources.ignore import IgnoreRules

    r = IgnoreRules.of([(".gitignore", "*.log\n/only\nsub/deep/\n!keep.log\nfoo/**/bar\n# c\n\\#x\nq?\n[ab].c\n"), ("sub/.gitignore", "!x.log\n"), (".graphlensignore", "mine/\n!never.log\n"), (".git/info/exclude", "ex\n")])
    yes = ("a.log", "d/a.log", "only", "sub/deep/f.py", "foo/bar", "foo/1/2/bar", "#x", "qz", "a.c", "mine/a.py", "ex", "node_modules/x.js", "d/vendor/y", ".git/config", "mine/keep.log")
    no = ("keep.log", "d/only", "sub/x.log", "foo", "q", "c.c", "never.log", "../a.log", "/a.log", "deep/f")
    assert [p for p in yes if not r.matched(p)] == [] and [p for p in no if r.matched(p)] == []


def test_configuration():
    assert scan.jsonc('{"a": "// no", /* x */ "b": [1, 2,], // y\n}') == {"a": "// no", "b": [1, 2]}
    assert scan.tsconfig("{") == ("", []) and scan.tsconfig('{"compilerOptions": {"baseUrl": ".", "paths": {"b": ["x"], "a/*": ["y/*", "z/*"]}}}') == ("", [("a/*", "y/*"), ("b", "x")])
    assert scan.go_module("// m\nmodule a/b // c\n") == "a/b" and scan.go_module("go 1.2") is None


def test_keys_and_rules(spark):
    refs = spark.createDataFrame([("python", "call", None, "f"), ("javascript", "call", "f", "f"), ("javascript", "call", "m#f", "f"), ("go", "go_selector_call", "fmt", "x"), ("php", "method_call", "resolve", "resolve"), ("php", "static_call", "A::b", "b"), ("javascript", "jsx_element", None, "div")], "language string, kind string, qname string, name string")
    assert [r.k for r in refs.select(resolve.lookup_key(refs).alias("k")).collect()] == ["f", None, "m#f", None, None, "A::b", "div"]
    rust = spark.createDataFrame([("crate::a::b", "m"), ("self::x", "m::n"), ("super::x", "m::n"), ("super::x", "m"), ("self::x", ""), ("std::y ;", "m")], "q string, m string")
    assert [r[0] for r in rust.select(resolve.rust_normal(F.col("q"), F.col("m"))).collect()] == ["a::b", "m::n::x", "m::x", "x", "x", "std::y"]
    views = spark.createDataFrame([("resources/views/a/b.blade.php",), ("x/resources/views/c.php",), ("views/a.blade.php",)], "path string")
    assert [r[0] for r in views.select(framework.view_name("path")).collect()] == ["view.a.b", "view.c", None]
    calls = spark.createDataFrame([("none", None, "view", "s", 0, [("string", "home", [])])], "receiver_kind string, receiver string, method string, scope string, start int, args array<struct<kind:string,value:string,items:array<string>>>")
    assert [tuple(r) for r in framework.views(calls).collect()] == [("home", "s")] and framework.laravel(calls).count() == 0


def test_diagnostics_of_rules(spark):
    call = "receiver_kind string, receiver string, method string, scope string, start int, args array<struct<kind:string,value:string,items:array<string>>>"
    rows = [
        ("this", None, "hasMany", "a", 0, []),
        ("this", None, "hasMany", "b", 0, [("class", "X", [])]),
        ("this", None, "belongsTo", "c", 0, [("other", None, [])]),
        ("container", None, "bind", "d", 0, [("class", "X", []), ("other", None, [])]),
        ("static", "Route", "get", "e", 0, [("string", "/x", []), ("other", None, [])]),
        ("static", "Route", "get", "f", 0, [("string", "/x", []), ("class", "X", [])]),
        ("none", None, "event", "g", 0, [("other", None, [])]),
        ("none", None, "strlen", "h", 0, [("other", None, [])]),
    ]
    got = framework.diagnostics(spark.createDataFrame(rows, call))
    assert sorted(r.scope for r in got.collect()) == ["a", "c", "d", "e", "g"]


def test_own_languages(spark, monkeypatch):
    from graphlens.extract.base import Facts

    def toy(content, path):
        f = Facts(content.decode())
        f.node("word", content.decode(), None, 0, len(content))
        return f

    monkeypatch.setitem(extract.LANGUAGES, "toy", toy)
    extract.register_language("toy", toy)
    out = extract.extracted(spark.createDataFrame([("a", "toy", b"h", b"hello")], "path string, language string, content_hash binary, content binary"))
    assert extract.nodes(out).first().name == "hello"


def test_lines_and_markdown(session):
    import json

    from graphlens import render, rpc

    helper = session.find_symbol("helper").first().node_id
    ask = lambda method, **params: json.dumps({"id": 1, "method": method, "params": params})
    lines = ["{", "[]", "", ask("nothing"), ask("search", name="helper", mode="odd"), ask("search", oops=1), ask("find_symbol", name="helper"), ask("node", node_id=helper)]
    replies = [json.loads(x) for x in rpc.serve(session, lines)]
    assert [r.get("error", {}).get("code") for r in replies] == [rpc.PARSE, rpc.INVALID_REQUEST, rpc.NO_METHOD, rpc.INVALID_PARAMS, rpc.INVALID_PARAMS, None, None]
    assert replies[-2]["result"][0]["node_id"] == helper and replies[-1]["result"][0]["content_hash"] in helper
    texts = {}
    for method, params in (("search", {"name": "help"}), ("callers_of", {"node_id": helper}), ("impact", {"node_id": helper}), ("nodes_in_file", {"path": "pkg/app.py"}), ("files", {}), ("node", {"node_id": helper}), ("context", {"name": "Page"}), ("explore", {"node_ids": [helper, "x:1"]}), ("trace", {"source": helper, "target": helper}), ("status", {}), ("node", {"node_id": "nobody"})):
        texts[method] = rpc.handle(session, ask(method, format="markdown", **params))["result"]
    assert "**helper** (function)" in texts["search"] and "Callers of" in texts["callers_of"] and "Not found: `x:1`" in texts["explore"]
    assert texts["trace"].startswith("## 0 steps") and texts["node"] == "No node `nobody`." and "| files |" in texts["status"]
    assert render.render("trace", []) == "No path." and render.plural(1, "match", "matches") == "1 match" and render.plural(2000, "file") == "2,000 files"


def test_stream_of_a_tree(spark, tmp_path):
    from graphlens.streaming import TreeChanges, freshness

    root = tmp_path / "tree"
    put(root, "a.py", "x = 1\n")
    put(root, "d/b.py", "y = 1\n")
    put(root, ".git/c", "no")
    spark.dataSource.register(TreeChanges)
    events = spark.readStream.format("tree_changes").option("path", str(root)).option("state", str(tmp_path / "state")).load()
    seen = []
    q = events.writeStream.foreachBatch(lambda df, n: seen.append(sorted((r.path, r.kind) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        os.remove(root / "a.py")
        put(root, "d/b.py", "y = 22\n")
        put(root, "new.py", "z = 1\n")
        q.processAllAvailable()
        state = freshness(q)
    finally:
        q.stop()
    got = [x for batch in seen for x in batch]
    assert got[:2] == [("a.py", "created"), ("d/b.py", "created")]
    assert set(got[2:]) >= {("a.py", "deleted"), ("d/b.py", "modified"), ("new.py", "created")}
    assert set(state) == {"catching_up", "pending_paths", "rss_bytes", "warnings"} and freshness(None)["catching_up"] is False


def test_store_lookups(session):
    import hashlib

    with open(os.path.join(session.root, "app.ts"), "rb") as f:
        assert session.store.active_file_hash("app.ts") == hashlib.sha256(f.read()).digest()
    assert session.store.active_file_hash("nothing") is None and session.store.schema_version() == 1
    assert {r.relation for r in session.store.relations().collect()} >= {"active_file", "active_node", "edge", "symbol"}
