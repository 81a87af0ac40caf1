"""Go: top-level types, functions, methods, values, imports, calls and routes."""

from __future__ import annotations

import re

from .base import Facts, Tokens, lex

_LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>`[^`]*`?|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?)|(?P<id>[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<num>\d[\w.]*)|(?P<op>:=|<-|&&|\|\||==|!=|<=|>=|\.\.\.|\S)",
    re.S,
)
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
# Methods of routers, and the HTTP method each stands for.
ROUTES = {m: m for m in ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")} | {m.title(): m for m in ("GET", "POST", "PUT", "PATCH", "DELETE")} | {"Handle": "ANY", "HandleFunc": "ANY"}


def _quoted(text: str) -> str | None:
    return text[1:-1] if len(text) >= 2 and text[0] in "\"`" else None


def extract(content: bytes, path: str) -> Facts:
    f = Facts(content.decode("latin-1"))
    t = Tokens(lex(f.source, _LEX), f)
    imports: list[tuple] = []
    named: set[int] = set()
    bodies: list[tuple[int, int]] = []

    def end_of_line(i: int) -> int:
        """Last token of the declaration at i."""
        j = i
        while j + 1 < len(t):
            if t.text(j) in ("(", "[", "{") and j in t.pair:
                j = t.pair[j]
            x = t[j + 1]
            if x.text in (")", ";", "}") or "\n" in f.source[t[j].end : x.start] and t.text(j) not in (",", "=", "|", "+", ".", "&&", "||"):
                return j
            j += 1
        return j

    def type_spec(i: int, first: int) -> int:
        k = i + 1
        if t.text(k) == "[" and t.is_id(k + 1) and t.text(k + 2) != "]":
            k = t.after(k)
        kind = {"struct": "struct", "interface": "interface"}.get(t.text(k), "type_alias")
        end = end_of_line(i)
        named.add(i)
        f.node(kind, t.text(i), None, t[first].start, t[end].end)
        return end

    def values(i: int, kind: str, first: int) -> int:
        end = end_of_line(i)
        j = i
        while j <= end:
            if t.is_id(j):
                if t.text(j) != "_":
                    named.add(j)
                    f.node(kind, t.text(j), None, t[first].start, t[end].end)
                j += 1
            if t.text(j) != ",":
                break
            j += 1
        return end

    def import_spec(i: int) -> int:
        alias = None
        if t.is_id(i) or t.text(i) in (".", "_"):
            alias, i = t.text(i), i + 1
        module = _quoted(t.text(i))
        if module is not None:
            local = alias or module.rsplit("/", 1)[-1].replace("-", "_")
            imports.append((module, t[i].start, t[i].end, local))
        return i

    i = 0
    while i < len(t):
        x = t[i]
        word = x.text if x.kind == "id" and t.owner[i] < 0 else ""
        if word in ("import", "type", "const", "var"):
            one = {"import": lambda j, _: import_spec(j), "type": type_spec, "const": lambda j, s: values(j, "constant", s), "var": lambda j, s: values(j, "variable", s)}[word]
            if t.text(i + 1) == "(":
                j, end = i + 2, t.pair.get(i + 1, len(t) - 1)
                while j < end:
                    j = max(one(j, j), j) + 1
                    while t.text(j) == ";":
                        j += 1
                i = end
            else:
                i = one(i + 1, i)
        elif word == "func":
            j, receiver = i + 1, None
            if t.text(j) == "(":
                names = [t.text(k) for k in range(j + 1, t.pair.get(j, j)) if t.is_id(k)]
                star = [k for k in range(j + 1, t.pair.get(j, j)) if t.text(k) == "["]
                if star:
                    names = [t.text(k) for k in range(j + 1, star[0]) if t.is_id(k)]
                receiver = names[-1] if names else None
                j = t.after(j)
            if t.is_id(j):
                named.add(j)
                brace = j + 1
                while brace < len(t) and t.text(brace) != "{":
                    if "\n" in f.source[t[brace - 1].end : t[brace].start] and t.text(brace - 1) not in (",", "("):
                        break
                    if t.text(brace) in ("interface", "struct") and t.text(brace + 1) == "{":
                        brace = t.after(brace + 1)
                        continue
                    brace = t.after(brace) if t.text(brace) in ("(", "[") else brace + 1
                end = t.pair.get(brace, brace) if t.text(brace) == "{" else brace - 1
                name = t.text(j)
                f.node("method" if receiver else "function", name, f"{receiver}.{name}" if receiver else None, x.start, t[end].end)
                bodies.append((j, end))
                i = end
        i += 1
    routes: dict[int, tuple[str, str, int]] = {}
    for i, x in enumerate(t.all):
        if x.kind == "id" and x.text in ROUTES and t.text(i - 1) == "." and t.text(i + 1) == "(":
            args = t.split(i + 1)
            target = _quoted(t.text(args[0][0])) if len(args) >= 2 else None
            if target and target.startswith("/"):
                a, b = args[-1] if x.text not in ("Handle", "HandleFunc") else args[1]
                last = b - 1
                if t.text(last) == ")":
                    last = t.pair.get(last, last) - 1
                if t.is_id(last):
                    routes[i] = (ROUTES[x.text], target, last)
    for i, (method, target, _) in routes.items():
        start, end = t[i].start, t[t.pair[i + 1]].end
        f.node("route", f"{method} {target}", f"route:{method} {target}", start, end)
    f.nest()
    found = [("import_go", m, s, e, None, a, "none") for m, s, e, a in imports]
    for i, (_, _, last) in routes.items():
        start, end = t[i].start, t[t.pair[i + 1]].end
        route = next(n["id"] for n in f.nodes if n["kind"] == "route" and n["span"]["start_byte"] == start)
        qname = f"{t.text(last - 2)}#{t.text(last)}" if t.text(last - 1) == "." and t.is_id(last - 2) else None
        found.append(("route_handler", t.text(last), t[last].start, t[last].end, qname, None, route))
    for i, x in enumerate(t.all):
        if x.kind != "id" or x.text in _KEYWORDS or i in named:
            continue
        if t.text(i + 1) == "(":
            end = t[t.pair.get(i + 1, i + 1)].end
            if t.text(i - 1) == ".":
                if t.is_id(i - 2) and t.text(i - 3) != ".":
                    found.append(("go_selector_call", x.text, t[i - 2].start, end, f"{t.text(i - 2)}#{x.text}", None, None))
                else:
                    found.append(("go_selector_call", x.text, x.start, end, None, None, None))
            elif t.text(i - 1) != "func" and t.owner[i] >= 0 and t.text(t.owner[i] - 1) not in ("interface", "struct"):
                found.append(("call", x.text, x.start, end, None, None, None))
        elif t.text(i + 1) == "{" and x.text[:1].isupper() and t.text(i - 1) not in ("struct", "interface", "type", "func", ")", "]") or t.text(i + 1) == "{" and t.text(i - 1) == "&":
            end = t[t.pair.get(i + 1, i + 1)].end
            if t.text(i - 1) == "." and t.is_id(i - 2):
                found.append(("instantiates", x.text, t[i - 2].start, end, f"{t.text(i - 2)}#{x.text}", None, None))
            elif t.owner[i] >= 0 or t.text(i - 1) in ("=", "&"):
                found.append(("instantiates", x.text, x.start, end, None, None, None))
    for kind, name, start, end, qname, alias, at in sorted(found, key=lambda r: (r[2], -r[3])):
        f.ref(kind, name, start, end, qname, alias, None if at == "none" else f.container(start, end) if at is None else at)
    return f
