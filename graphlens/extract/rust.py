"""Rust: items, methods of impl and trait blocks, uses, calls and routes."""

from __future__ import annotations

import re

from .base import Facts, Tokens, lex

_LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:[^\"\\]|\\.)*+\"?|b?'(?:[^'\\\n]|\\[^\n]{1,9}?)'|'[A-Za-z_]\w*)|(?P<id>(?:r#)?[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<num>\d[\w.]*?(?=\.\.|[^\w.]|\Z))|(?P<op>::|->|=>|\.\.=?|&&|\|\||\S)",
    re.S,
)
_KEYWORDS = frozenset("as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while yield".split())
# HTTP methods of attribute routes, and of router functions.
ATTRIBUTE_ROUTES = ("get", "post", "put", "patch", "delete", "head", "options")
ROUTER_FUNCTIONS = (*ATTRIBUTE_ROUTES, "trace")
_ITEMS = {"struct": "struct", "enum": "enum", "trait": "trait", "type": "type_alias", "const": "constant", "static": "variable", "mod": "module"}


def _string(text: str) -> str | None:
    m = re.match(r"b?r?(#*)\"(.*)\"\1\Z", text, re.S)
    return m[2] if m else None


def extract(content: bytes, path: str) -> Facts:
    f = Facts(content.decode("latin-1"))
    t = Tokens(lex(f.source, _LEX), f)
    named: set[int] = set()
    owners: list[tuple[int, int, str]] = []  # first and last token of a block, its type
    found: list[tuple] = []
    attributes: list[tuple[int, int, str, str]] = []

    def end(i: int) -> int:
        """Last token of the item at i: its block or semicolon."""
        j = i
        while j < len(t):
            x = t.text(j)
            if x == ";":
                return j
            if x == "{":
                return t.pair.get(j, len(t) - 1)
            j = t.after(j) if x in ("(", "[") else j + 1
        return len(t) - 1

    def first(i: int) -> int:
        while t.text(i - 1) in ("pub", "async", "unsafe", "const", "extern", "default") or t.text(i - 1) == ")" and t.text(t.pair.get(i - 1, i - 1) - 1) == "pub":
            i = t.pair[i - 1] - 1 if t.text(i - 1) == ")" else i - 1
        return i

    def type_name(a: int, b: int) -> str:
        """Last name of the type in [a, b), without its parameters."""
        name, depth = "", 0
        for k in range(a, b):
            x = t[k]
            if x.text == "<":
                depth += 1
            elif x.text == ">":
                depth -= 1
            elif not depth and x.kind == "id" and x.text not in ("dyn", "mut", "const", "where"):
                name = x.text
            elif x.text == "where":
                break
        return name

    for i, x in enumerate(t.all):
        if x.text == "impl" and x.kind == "id":
            brace = t.find(i + 1, "{", stop=(";",))
            if brace < 0:
                continue
            where = next((k for k in range(i, brace) if t.text(k) == "where"), brace)
            depth, split = 0, -1
            for k in range(i + 1, where):
                depth += (t.text(k) == "<") - (t.text(k) == ">")
                if t.text(k) == "for" and not depth:
                    split = k
            name = type_name(split + 1 if split >= 0 else i + 1, where)
            owners.append((brace, t.pair[brace], name))
            if split >= 0:
                found.append(("implements", type_name(i + 1, split), t[i].start, t[split].start, None, None, f"type:{name}"))
        elif x.text == "trait" and t.is_id(i + 1):
            brace = t.find(i + 2, "{", stop=(";",))
            if brace >= 0:
                owners.append((brace, t.pair[brace], t.text(i + 1)))
    owner_of = lambda i: next((n for a, b, n in sorted(owners, key=lambda o: o[1] - o[0]) if a < i < b), None)
    braces = {a for a, _, _ in owners}
    for i, x in enumerate(t.all):
        if x.kind != "id" or not t.is_id(i + 1):
            continue
        if x.text in _ITEMS and t.text(i - 1) not in (".", "::", "<", "*", "(", ",", "&", "="):
            if x.text == "const" and t.text(i + 1) in ("fn", "unsafe", "async"):
                continue
            name = i + 2 if x.text == "static" and t.text(i + 1) == "mut" else i + 1
            if t.text(name) == "_":
                continue
            named.add(name)
            start = first(i)
            inside = owner_of(i) if t.owner[i] in braces else None
            f.node(_ITEMS[x.text], t.text(name), f"{inside}.{t.text(name)}" if inside else None, t[start].start, t[end(name)].end)
        elif x.text == "fn":
            named.add(i + 1)
            start = first(i)
            inside = owner_of(i) if t.owner[i] in braces else None
            name = t.text(i + 1)
            f.node("method" if inside else "function", name, f"{inside}.{name}" if inside else None, t[start].start, t[end(i + 1)].end)
    handlers: list[tuple[str, str, int, int, str]] = []
    for i, x in enumerate(t.all):
        if x.text == "#" and t.text(i + 1) == "[" and t.text(i + 2) in ATTRIBUTE_ROUTES and t.text(i + 3) == "(":
            target = _string(t.text(i + 4))
            fn = next((k for k in range(t.after(i + 1), min(len(t), t.after(i + 1) + 40)) if t.text(k) == "fn"), -1)
            if target is not None and fn >= 0:
                handlers.append((t.text(i + 2).upper(), target, x.start, t[t.pair[i + 1]].end, t.text(fn + 1)))
        elif x.text == "route" and t.text(i - 1) == "." and t.text(i + 1) == "(":
            args = t.split(i + 1)
            target = _string(t.text(args[0][0])) if len(args) >= 2 else None
            if target is None:
                continue
            for k in range(*args[1]):
                if t.text(k) in ROUTER_FUNCTIONS and t.text(k + 1) == "(" and t.split(k + 1):
                    a, b = t.split(k + 1)[0]
                    ids = [j for j in range(a, b) if t.is_id(j)]
                    if ids:
                        handlers.append((t.text(k).upper(), target, t[k].start, t[t.pair[k + 1]].end, t.text(ids[-1])))
    for method, target, a, b, _ in handlers:
        f.node("route", f"{method} {target}", f"route:{method} {target}", a, b)
    f.nest()

    def use_tree(i: int, stop: int, prefix: str) -> None:
        parts: list[str] = [prefix] if prefix else []
        k = i
        while k < stop:
            if t.text(k) == "{":
                for a, b in t.split(k):
                    use_tree(a, b, "::".join(parts))
                return
            if t.is_id(k) and t.text(k) == "as":
                found.append(("import_rust", parts[-1].rsplit("::", 1)[-1], t[i].start, t[k + 1].end, "::".join(parts), t.text(k + 1), "none"))
                return
            if t.is_id(k) or t.text(k) == "*":
                parts.append(t.text(k))
            k += 1
        if parts:
            if parts[-1] == "self" and len(parts) > 1:
                parts.pop()
            name = parts[-1].rsplit("::", 1)[-1]
            found.append(("import_rust", name, t[i].start, t[stop - 1].end, "::".join(parts), None, "none"))

    for method, target, a, _b, handler in handlers:
        route = next(n["id"] for n in f.nodes if n["kind"] == "route" and n["span"]["start_byte"] == a and n["qname"] == f"route:{method} {target}")
        found.append(("route_handler", handler, a, a + 1, None, None, route))
    for i, x in enumerate(t.all):
        if x.text == "use" and x.kind == "id":
            stop = t.find(i + 1, ";")
            use_tree(i + 1, stop if stop >= 0 else len(t), "")
        elif x.text == "routes" and t.text(i + 1) == "!" and t.text(i + 2) in ("[", "("):
            for a, b in t.split(i + 2):
                found.append(("route_handler", t.text(b - 1), t[a].start, t[b - 1].end, None, None, None))
        elif x.kind == "id" and x.text not in _KEYWORDS and i not in named:
            paren = i + 1
            if t.text(paren) == "::" and t.text(paren + 1) == "<":
                depth, k = 0, paren + 1
                while k < len(t) and k < paren + 40:
                    depth += (t.text(k) == "<") - (t.text(k) == ">")
                    k += 1
                    if not depth:
                        break
                paren = k
            if t.text(paren) != "(" or t.owner[i] < 0 and t.text(i - 1) == "[":
                continue
            stop = t[t.pair.get(paren, paren)].end
            a = i
            while t.text(a - 1) == "::" and a >= 2 and (t.is_id(a - 2) or t.text(a - 2) == ">"):
                if t.text(a - 2) == ">":
                    break
                a -= 2
            if t.text(i - 1) == ".":
                found.append(("rust_call", x.text, x.start, stop, None, None, None))
            elif a < i:
                path_text = "::".join(t.text(k) for k in range(a, i + 1) if t.is_id(k))
                found.append(("rust_call", x.text, t[a].start, stop, path_text, None, None))
            elif t.text(i - 1) not in ("fn", "struct", "enum") and t.owner[i] >= 0 and not x.text[:1].isupper():
                found.append(("rust_call", x.text, x.start, stop, None, None, None))
    for kind, name, a, b, qname, alias, at in sorted(found, key=lambda r: (r[2], -r[3])):
        if at == "none":
            holder = None
        elif isinstance(at, str):
            holder = next((n["id"] for n in f.nodes if n["name"] == at[5:] and n["kind"] in ("struct", "enum", "trait", "type_alias")), None)
        else:
            holder = f.container(a, b) if at is None else at
        f.ref(kind, name, a, b, qname, alias, holder)
    return f
