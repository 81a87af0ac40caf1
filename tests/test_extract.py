"""Extractors on small sources of each language."""

import pytest

from graphlens import extract as X


def facts(language, source, path="a"):
    f = X.facts(source.encode(), path, language)
    data = source.encode()
    for n in f.nodes:
        s = n["span"]
        assert 0 <= s["start_byte"] <= s["end_byte"] <= len(data)
        assert s["start_row"] == data[: s["start_byte"]].count(b"\n")
        assert s["start_col"] == s["start_byte"] - (data.rfind(b"\n", 0, s["start_byte"]) + 1)
    assert [n["id"] for n in f.nodes] == list(range(len(f.nodes)))
    return f


def nodes(f, *keys):
    return [tuple(n[k] for k in keys) for n in f.nodes]


def refs(f, *kinds):
    return [(r["name"], r["qname"]) for r in f.refs if r["kind"] in kinds]


PYTHON = '''import os
import numpy as np
from typing import List
from .foo import bar as b
from pkg.mod import *

MAX_RETRIES = 3
retries = 2

@app.route('/')
def index():
    return a.b.c(1).d()

class User(BaseUser):
    LIMIT = 5

    async def fetch(self, é):
        def inner():
            pass
        return inner()
'''


def test_python():
    f = facts("python", PYTHON)
    assert nodes(f, "kind", "name", "qname", "parent") == [
        ("constant", "MAX_RETRIES", "MAX_RETRIES", None),
        ("function", "index", "index", None),
        ("class", "User", "User", None),
        ("method", "fetch", "User.fetch", 2),
        ("function", "inner", "User.fetch.inner", 3),
    ]
    assert refs(f, "import") == [("os", None), ("numpy", None), ("List", "typing.List"), ("bar", ".foo.bar"), ("*", "pkg.mod.*")]
    assert [r["alias"] for r in f.refs if r["kind"] == "import"] == [None, "np", None, "b", None]
    assert refs(f, "decorator") == [("app.route('/')", None)] and refs(f, "inheritance") == [("BaseUser", None)]
    held = {(r["kind"], r["name"]): r["container"] for r in f.refs}
    assert held["decorator", "app.route('/')"] == 1 and held["inheritance", "BaseUser"] == 2
    assert held["call", "a.b.c.d"] == 1 and held["call", "a.b.c"] == 1 and held["call", "inner"] == 3
    assert not f.diagnostics


def test_broken_python_keeps_the_rest():
    f = facts("python", "def good():\n    return 1\n\ndef bad(:\n    x = (\n\ndef more():\n    pass\n")
    assert {"good"} <= {n["name"] for n in f.nodes} and f.diagnostics
    assert all(d["severity"] == "Error" for d in f.diagnostics)


TSX = """import React, { useState as us } from 'react';
import * as Icons from './icons';
import './side.css';
const fs = require("fs");
export const Button = ({ label }: Props): JSX.Element => {
  const [a, setA] = us(0);
  return <div onClick={() => setA(a + 1)}>Don't {label.map(v => <Icons.Home key={v} />)}<Price v={fmt(a)}/></div>;
};
export default class Foo extends Base implements Bar {
  async load(id: string): Promise<User[]> { return this.api.get<User>(`/u/${enc(id)}`); }
}
interface Shape { area(): number; kind: Kind }
type Id = string | Shape;
function helper(a: Id) { const re = /a'b/g; return a ? run(a) : other({ k: 1 }); }
export * from './more';
module.exports = helper;
"""


def test_tsx():
    f = facts("tsx", TSX)
    assert nodes(f, "kind", "name", "parent") == [
        ("variable", "fs", None),
        ("arrow_function", "Button", None),
        ("class", "Foo", None),
        ("method", "load", 2),
        ("interface", "Shape", None),
        ("type_alias", "Id", None),
        ("function", "helper", None),
        ("variable", "re", 6),
    ]
    assert refs(f, "import_esm", "import_cjs") == [("react", None), ("./icons", None), ("./side.css", None), ("fs", None)]
    assert refs(f, "import_default", "import_named", "import_namespace") == [("default", "react"), ("useState", "react"), ("*", "./icons")]
    assert refs(f, "export_esm", "export_cjs") == [("Button", None), ("Foo", None), ("./more", None), ("module.exports", None)]
    assert refs(f, "call") == [("us", "react#useState"), ("setA", None), ("fmt", None), ("enc", None), ("run", None), ("other", None)]
    assert refs(f, "member_call") == [("map", None), ("get", None)]
    assert refs(f, "jsx_element", "jsx_component") == [("div", None), ("Icons.Home", "./icons#Home"), ("Price", None)]
    assert {"Props", "Bar", "Promise", "User", "Kind", "Shape", "Id"} <= {n for n, _ in refs(f, "type_reference")}
    assert not f.diagnostics


def test_javascript():
    f = facts("javascript", "function* gen() {}\nconst A = class { m() { return 1 } };\nlet x = 1, y = function () {};\nclass B { get v() { return this.w; } static s() {} }\nexports.z = gen;\nfoo?.bar?.(1); new Date();\n")
    assert nodes(f, "kind", "name") == [("function", "gen"), ("class", "A"), ("method", "m"), ("variable", "x"), ("function", "y"), ("class", "B"), ("method", "v"), ("method", "s")]
    assert refs(f, "export_cjs") == [("exports.z", None)]
    assert refs(f, "call") == [] and refs(f, "member_call") == [("bar", None)]


PHP = r"""<?php
namespace App\Services;
use App\Nav\NavResolver;
use App\Models\{User, Post as P};
abstract class Nav extends Base implements Shown, \Other\Thing {
    use Loud;
    const MAX = 3;
    private ?NavResolver $resolver = null;
    public function __construct(private User $user, P $post) { $post->save(); }
    public function go(NavResolver $r) {
        $r->resolve('x'); $this->resolver->resolve(1); $this->helper()?->again(); self::make(); User::find(1); parent::go($r);
        (new NavResolver())->resolve(2); $other->unknown();
        return view('home');
    }
}
enum Status: string { case On = 'on'; public function label() { return strtoupper($this->value); } }
function free($a) { return 1; }
"""


def test_php():
    f = facts("php", PHP)
    space = r"App\Services"
    assert nodes(f, "kind", "qname") == [
        ("namespace", space),
        ("class", rf"{space}\Nav"),
        ("constant", rf"{space}\Nav::MAX"),
        ("property", rf"{space}\Nav::resolver"),
        ("method", rf"{space}\Nav::__construct"),
        ("method", rf"{space}\Nav::go"),
        ("enum", rf"{space}\Status"),
        ("enum_case", rf"{space}\Status::On"),
        ("method", rf"{space}\Status::label"),
        ("function", rf"{space}\free"),
    ]
    assert refs(f, "import") == [("NavResolver", r"App\Nav\NavResolver"), ("User", r"App\Models\User"), ("P", r"App\Models\Post")]
    assert refs(f, "extends", "implements", "trait_use") == [("Base", "Base"), ("Shown", "Shown"), (r"Other\Thing", r"Other\Thing"), ("Loud", "Loud")]
    resolve = r"App\Nav\NavResolver::resolve"
    assert refs(f, "method_call") == [("save", r"App\Models\Post::save"), ("resolve", resolve), ("resolve", resolve), ("helper", rf"{space}\Nav::helper"), ("resolve", resolve), ("unknown", None)]
    assert refs(f, "nullsafe_method_call") == [("again", None)]
    assert refs(f, "static_call") == [("make", rf"{space}\Nav::make"), ("find", r"App\Models\User::find"), ("go", None)]
    assert refs(f, "call") == [("view", "view"), ("strtoupper", "strtoupper")]


def test_php_blocks_and_errors():
    f = facts("php", "<p>html <?php namespace A { class X {} } namespace B { class X { public function y() { } } ?> tail")
    assert [q for _, q in nodes(f, "kind", "qname")] == ["A", r"A\X", "B", r"B\X", r"B\X::y"]
    assert f.diagnostics


GO = """package server

import (
	"fmt"
	srv "example.com/app/internal/server"
	"example.com/app/my-lib"
)

const Max = 3
var a, b = 1, 2
type Server struct { addr string }
type Handler interface { Serve() }
type ID = string

func New(addr string) *Server { return &Server{addr: addr} }
func (s *Server) Start(ctx int) error {
	fmt.Println("x"); srv.Run(); helper(1)
	r.GET("/users", s.list)
	http.HandleFunc("/x", handle)
	return nil
}
"""


def test_go():
    f = facts("go", GO)
    assert nodes(f, "kind", "name", "qname", "parent") == [
        ("constant", "Max", "Max", None),
        ("variable", "a", "a", None),
        ("variable", "b", "b", None),
        ("struct", "Server", "Server", None),
        ("interface", "Handler", "Handler", None),
        ("type_alias", "ID", "ID", None),
        ("function", "New", "New", None),
        ("method", "Start", "Server.Start", None),
        ("route", "GET /users", "route:GET /users", 7),
        ("route", "ANY /x", "route:ANY /x", 7),
    ]
    assert [(r["name"], r["alias"]) for r in f.refs if r["kind"] == "import_go"] == [("fmt", "fmt"), ("example.com/app/internal/server", "srv"), ("example.com/app/my-lib", "my_lib")]
    assert ("Run", "srv#Run") in refs(f, "go_selector_call") and refs(f, "call") == [("helper", None)]
    assert refs(f, "instantiates") == [("Server", None)]
    assert [r["container"] for r in f.refs if r["kind"] == "route_handler"] == [8, 9]


RUST = """use std::collections::{HashMap, hash_map::Entry as E};
use crate::server::{self, stop};
pub struct Server<T> { a: T }
pub trait Run { fn run(&self); }
const MAX: usize = 3;
static mut N: u8 = 1;
type Id = u32;
impl<T> Run for Server<T> where T: Clone { fn run(&self) { helper(1); self::local(); Server::new(); stop(); } }
impl<T> Server<T> { pub async fn new() -> Self { let c = 'x'; let s = "a{"; todo!() } }
#[get("/users")]
async fn list() -> String { parse::<u32>("1"); String::new() }
fn main() { let app = Router::new().route("/p", get(handlers::show).post(save)); x.mount("/", routes![list, api::one]); }
mod inner { fn deep() {} }
"""


def test_rust():
    f = facts("rust", RUST)
    got = nodes(f, "kind", "qname")
    assert [x for x in got if x[0] != "route"] == [
        ("struct", "Server"),
        ("trait", "Run"),
        ("method", "Run.run"),
        ("constant", "MAX"),
        ("variable", "N"),
        ("type_alias", "Id"),
        ("method", "Server.run"),
        ("method", "Server.new"),
        ("function", "list"),
        ("function", "main"),
        ("module", "inner"),
        ("function", "deep"),
    ]
    assert {q for k, q in got if k == "route"} == {"route:GET /users", "route:GET /p", "route:POST /p"}
    assert refs(f, "import_rust") == [("HashMap", "std::collections::HashMap"), ("Entry", "std::collections::hash_map::Entry"), ("server", "crate::server"), ("stop", "crate::server::stop")]
    assert refs(f, "implements") == [("Run", None)]
    calls = refs(f, "rust_call")
    assert ("helper", None) in calls and ("local", "self::local") in calls and ("new", "Server::new") in calls and ("parse", None) in calls
    assert [n for n, _ in refs(f, "route_handler")] == ["list", "show", "save", "list", "one"]


def test_blade():
    f = facts(
        "blade",
        "@extends('layouts.app')\n@section('title', 'Home')\n@section('content')\n{{-- @include('hidden') --}}\n@include('partials.nav', ['a' => 1])\n@includeWhen($c, 'v')\n<x-alert type=\"x\" />\n@component('card') hi @endcomponent\n@if($a) {{ $user->name }} @endif\n@yield('side') @stack('scripts')\n@push('scripts') <b></b> @endpush\n@endsection\n",
    )
    assert nodes(f, "kind", "name") == [
        ("blade_section", "title"),
        ("blade_section", "content"),
        ("blade_component_block", "card"),
        ("blade_directive_block", "if"),
        ("blade_yield", "side"),
        ("blade_stack", "scripts"),
        ("blade_push_block", "scripts"),
    ]
    assert all(n["qname"] == "" and n["parent"] is None for n in f.nodes)
    assert refs(f, "blade_extends", "blade_view", "blade_component", "blade_x_component") == [("layouts.app", None), ("partials.nav", None), ("alert", None), ("card", None)]
    assert refs(f, "blade_php_expression") == [("$user->name", None)]
    assert not f.diagnostics
    assert facts("blade", "@if($a)\n<p>\n").diagnostics


@pytest.mark.parametrize("language", sorted(X.LANGUAGES))
def test_odd_sources(language):
    for source in ("", " ", "{", "}", "(((", "'", '"', "`", "/*", "é\U0001f600", "<?php", "#!", "@", "\x00\x01", "<" * 50, "a" * 5000, "{" * 3000, "def f(:\n" * 50):
        facts(language, source)
    X.facts(b"\xff\xfe\x80 class", "a", language)


def test_failing_extractors_give_a_diagnostic():
    def broken(content, path):
        raise KeyError("x")

    assert X.facts(b"x", "a", "odd", {"odd": broken}).diagnostics[0]["message"].startswith("KeyError")


def test_table_of_files(spark):
    from pyspark.sql import functions as F

    rows = [("a.py", "python", b"1", PYTHON.encode()), ("b.php", "php", b"2", PHP.encode()), ("c.txt", None, b"3", b"x"), ("d.go", "go", b"4", None)]
    files = spark.createDataFrame(rows, "path string, language string, content_hash binary, content binary")
    out = X.extracted(files)
    assert out.count() == 3
    n = X.nodes(out)
    assert n.filter("path = 'a.py'").count() == 5
    assert n.select("node_id").first().node_id.split(":")[0] in ("31", "32")
    assert X.refs(out).filter("path = 'b.php' and kind = 'static_call'").count() == 3
    assert X.calls(out).filter(F.col("method") == "view").count() == 1


LONG = {
    "typescript": "const x = {\n" + "".join(f"  k{i}: {{ a: {i}, b: f{i}(1) }},\n" for i in range(8000)) + "};\n",
    "tsx": "".join(f"export function f{i}(a: number): T{i} {{ return g{i}(a) ? h.x(1) : y; }}\n" for i in range(4000)),
    "javascript": "a" + ".b(1)" * 20000 + ";" + "foo(" * 500 + ")" * 500,
    "php": "<?php class A {" + "".join(f" public int $p{i} = 1; public function m{i}(B $b) {{ $b->x()->y(); self::z(); }}" for i in range(3000)) + "} $q" + "->w(1)" * 5000 + ";",
    "python": "".join(f"@d{i}('x')\nclass C{i}(B{i}):\n    def m(self): return f{i}()\n" for i in range(3000)),
    "go": "package a\n" + "".join(f"func F{i}(a int) int {{ return b.G{i}(a) + h(1) }}\n" for i in range(8000)),
    "blade": "".join(f"@section('a{i}') {{{{ $x }}}} <x-b/> @endsection\n" for i in range(4000)),
}


@pytest.mark.parametrize("language", sorted(LONG))
def test_long_sources(language):
    import time

    began = time.monotonic()
    f = X.facts(LONG[language].encode(), "a", language)
    assert not f.diagnostics and len(f.refs) >= 4000
    assert time.monotonic() - began < 20
