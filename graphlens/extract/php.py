"""PHP: definitions, imports, type hints, calls, class relations, and calls with arguments."""

from __future__ import annotations

import re

from .base import END, Facts, Token, Tokens

_OPEN = re.compile(r"<\?(?:php\b|=)?", re.I)
_LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*?(?=\?>|\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\n|\Z)|/\*.*?(?:\*/|\Z))"
    r"|(?P<close>\?>\n?)"
    r"|(?P<heredoc><<<[ \t]*(['\"]?)(?P<tag>[A-Za-z_]\w*)\4\r?\n.*?^[ \t]*(?P=tag)\b)"
    r"|(?P<str>\"(?:[^\"\\]|\\.)*+\"?|'(?:[^'\\]|\\.)*+'?|`(?:[^`\\]|\\.)*+`?)"
    r"|(?P<var>\$+[A-Za-z_\x80-\xff][\w\x80-\xff]*)"
    r"|(?P<id>\\?[A-Za-z_\x80-\xff][\w\x80-\xff]*(?:\\[A-Za-z_\x80-\xff][\w\x80-\xff]*)*)"
    r"|(?P<num>\d[\w.]*)"
    r"|(?P<op>\?->|->|::|=>|\#\[|\.\.\.|&&|\|\||\?\?=?|===?|!==?|<=>|<=|>=|\S)",
    re.S | re.M,
)
# Types that are no classes.
BUILTIN_TYPES = frozenset("array bool boolean callable false float int integer iterable mixed never null object resource self static string true void".split())
_NOT_CALLED = frozenset("if elseif while for foreach switch catch function fn array list isset empty unset exit die echo print return include include_once require require_once match declare use and or xor not clone new static self parent".split())
_TYPES = {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}
_MODIFIERS = frozenset("public private protected static abstract final readonly var const async".split())


def _lex(source: str):
    at, n = 0, len(source)
    while at < n:
        m = _OPEN.search(source, at)
        if not m:
            return
        at = m.end()
        while at < n:
            m = _LEX.match(source, at)
            if not m:
                at += 1
                continue
            at = m.end()
            kind = next(k for k in ("skip", "close", "heredoc", "str", "var", "id", "num", "op") if m[k] is not None)
            if kind == "close":
                yield Token(("op", ";", m.start(), m.start()))
                break
            if kind != "skip":
                yield Token(("str" if kind == "heredoc" else kind, m[0], m.start(), m.end()))


class Reader:
    def __init__(self, content: bytes):
        self.f = Facts(content.decode("latin-1"))
        tokens = list(_lex(self.f.source))
        # An attribute opens like a list.
        self.t = Tokens((Token(("op", "[", x.start, x.end)) if x.text == "#[" else x for x in tokens), self.f)
        self.spaces: list[tuple[int, int, str]] = []  # token ranges of namespaces
        self.uses: dict[str, str] = {}
        self.defs: list[tuple[dict, int, int]] = []  # node, name token, last token
        self.body_of: dict[int, str] = {}  # brace of a class -> its kind
        self.found: list[tuple] = []
        self.starts: dict[int, int] = {}

    def space(self, i: int) -> str:
        best = [(b - a, n) for a, b, n in self.spaces if a <= i < b]
        return min(best)[1] if best else ""

    def full(self, name: str, i: int) -> str | None:
        """A class name as it stands at token i, from the root."""
        if name.startswith("\\"):
            return name[1:]
        if name.startswith("namespace\\"):
            name = name[10:]
        else:
            head, _, rest = name.partition("\\")
            if head.lower() in self.uses:
                return self.uses[head.lower()] + ("\\" + rest if rest else "")
        space = self.space(i)
        return f"{space}\\{name}" if space else name

    # Definitions -----------------------------------------------------------------------

    def define(self, kind: str, name: str, i: int, first: int, last: int) -> None:
        node = self.f.node(kind, name, "", self.t[first].start, self.t[last].end)
        self.defs.append((node, i, last))

    def first(self, i: int) -> int:
        while self.t.text(i - 1).lower() in _MODIFIERS:
            i -= 1
        return i

    def definitions(self) -> None:
        t, n = self.t, len(self.t)
        flat: list[tuple[int, str]] = []
        for i, x in enumerate(t.all):
            word = x.text.lower() if x.kind == "id" and t.text(i - 1) not in ("->", "?->", "::") else ""
            if word == "namespace" and (t.is_id(i + 1) or t.text(i + 1) == "{"):
                name = t.text(i + 1).strip("\\") if t.is_id(i + 1) else ""
                brace = i + 2 if t.is_id(i + 1) else i + 1
                if t.text(brace) == "{":
                    self.spaces.append((brace, t.pair.get(brace, n), name))
                    self.define("namespace", name, i + 1, i, t.pair.get(brace, n - 1)) if name else None
                elif name:
                    flat.append((i, name))
                    self.define("namespace", name, i + 1, i, brace if t.text(brace) == ";" else i + 1)
            elif word in _TYPES and t.is_id(i + 1) and t.text(i - 1) != "new" and not (word == "enum" and t.text(i + 1).lower() in ("extends", "implements")):
                brace = t.find(i + 2, "{", stop=(";",))
                if brace >= 0:
                    self.body_of[brace] = word
                    self.define(_TYPES[word], t.text(i + 1), i + 1, self.first(i), t.pair.get(brace, n - 1))
                    self.heads(i + 2, brace)
            elif word == "class" and t.text(i - 1).lower() == "new":
                brace = t.find(i + 1, "{", stop=(";",))
                if brace >= 0:
                    self.body_of[brace] = "anonymous"
                    self.heads(i + 1, brace)
            elif word == "use" and t.owner[i] < 0 or word == "use" and t.owner[i] in {a for a, _, _ in self.spaces}:
                if t.text(i + 1) != "(":
                    self.use(i)
        for k, (i, name) in enumerate(flat):
            # A namespace without braces reaches from the end of its declaration to the next.
            self.spaces.append((i + 2, flat[k + 1][0] if k + 1 < len(flat) else n, name))
        for i, x in enumerate(t.all):
            word = x.text.lower() if x.kind == "id" and t.text(i - 1) not in ("->", "?->", "::") else ""
            inside = self.body_of.get(t.owner[i]) if t.owner[i] >= 0 else None
            if word == "function":
                name = i + 2 if t.text(i + 1) == "&" else i + 1
                if t.is_id(name) and t.text(name + 1) == "(":
                    j = t.after(name + 1)
                    while j < n and t.text(j) not in ("{", ";"):
                        j += 1
                    last = t.pair.get(j, n - 1) if t.text(j) == "{" else j
                    self.define("method" if inside else "function", t.text(name), name, self.first(i), last)
            elif word == "const" and (inside or t.owner[i] < 0 or t.owner[i] in {a for a, _, _ in self.spaces}) and t.text(i - 1).lower() != "use":
                end = t.find(i, ";")
                j = i + 1
                while 0 <= j < (end if end >= 0 else n):
                    eq = t.find(j, "=", stop=(";", ","))
                    if eq < 0:
                        break
                    self.define("constant", t.text(eq - 1), eq - 1, self.first(i), end if end >= 0 else eq)
                    j = t.find(eq, ",", stop=(";",)) + 1
                    if not j:
                        break
            elif word == "case" and inside == "enum":
                end = t.find(i, ";")
                self.define("enum_case", t.text(i + 1), i + 1, i, end if end >= 0 else i + 1)
            elif word == "use" and inside:
                j = i + 1
                while t.is_id(j):
                    self.found.append(("trait_use", t.text(j).lstrip("\\"), t[j].start, t[j].end, t.text(j).lstrip("\\"), t.owner[i]))
                    j += 2 if t.text(j + 1) == "," else 1
                    if t.text(j - 1) != ",":
                        break
            elif x.kind == "var" and inside and t.owner[i] >= 0 and self.is_property(i):
                end = t.find(i, ";", ",")
                self.define("property", x.text[1:], i, self.first(self.type_start(i)), end if end >= 0 else i)

    def is_property(self, i: int) -> bool:
        j = self.type_start(i)
        return self.t.text(j - 1).lower() in _MODIFIERS and self.t.inside[i] == self.t.owner[i]

    def type_start(self, i: int) -> int:
        t = self.t
        j = i
        while t.is_id(j - 1) and t.text(j - 1).lower() not in _MODIFIERS or t.text(j - 1) in ("?", "|", "&"):
            j -= 1
        return j

    def heads(self, i: int, brace: int) -> None:
        kind = None
        for j in range(i, brace):
            word = self.t.text(j)
            if word.lower() in ("extends", "implements") and self.t.is_id(j):
                kind = word.lower()
            elif kind and self.t.is_id(j):
                name = word.lstrip("\\")
                self.found.append((kind, name, self.t[j].start, self.t[j].end, name, brace))

    def use(self, i: int) -> None:
        t = self.t
        end = t.find(i + 1, ";")
        end = len(t) if end < 0 else end
        j = i + 1
        if t.text(j).lower() in ("function", "const") and t.is_id(j + 1):
            j += 1
        brace = next((k for k in range(j, end) if t.text(k) == "{"), -1)
        prefix = ""
        ranges = []
        if brace >= 0:
            prefix = t.text(j).strip("\\")
            ranges = t.split(brace)
        else:
            start = j
            for k in range(j, end + 1):
                if k == end or t.text(k) == ",":
                    if k > start:
                        ranges.append((start, k))
                    start = k + 1
        for a, b in ranges:
            if t.text(a).lower() in ("function", "const") and b - a > 1:
                a += 1
            name = t.text(a).strip("\\")
            full = f"{prefix}\\{name}" if prefix else name
            local = t.text(a + 2) if t.text(a + 1).lower() == "as" else full.rsplit("\\", 1)[-1]
            self.uses[local.lower()] = full
            self.found.append(("import", local, t[a].start, t[b - 1].end, full, None))

    def names(self) -> None:
        """Qualified names, once all are nested."""
        spaces = {id(n): self.space(i) for n, i, _ in self.defs}
        self.f.nest()
        by_id = {n["id"]: n for n in self.f.nodes}
        for n in self.f.nodes:
            parent = by_id.get(n["parent"])
            if n["kind"] == "namespace":
                n["qname"] = n["name"]
                continue
            while parent is not None and parent["kind"] == "namespace":
                parent = by_id.get(parent["parent"])
            if parent is not None:
                n["qname"] = parent["qname"] + ("::" if n["kind"] in ("method", "property", "constant", "enum_case") else "\\") + n["name"]
            else:
                space = spaces[id(n)]
                n["qname"] = f"{space}\\{n['name']}" if space else n["name"]

    # Types -----------------------------------------------------------------------------

    def hint(self, a: int, b: int) -> str | None:
        """The class that the type in tokens [a, b) names, if just one."""
        names = [self.t.text(k) for k in range(a, b) if self.t.is_id(k)]
        names = [x for x in names if x.lower().lstrip("\\") not in BUILTIN_TYPES]
        return self.full(names[0], a) if len(names) == 1 else None

    def receivers(self) -> None:
        """Types of properties (class id, name) and of parameters (function id, name)."""
        t = self.t
        self.properties: dict[tuple[int, str], str] = {}
        self.variables: dict[tuple[int, str], str] = {}
        for node, i, _ in self.defs:
            if node["kind"] == "property":
                holder = self.class_at(node["span"]["start_byte"], node["span"]["end_byte"])
                owner = holder["id"] if holder else None
                name = self.hint(self.type_start(i), i)
                if owner is not None and name:
                    self.properties[owner, t.text(i)[1:]] = name
            elif node["kind"] in ("method", "function") and t.text(i + 1) == "(":
                holder = self.class_at(node["span"]["start_byte"], node["span"]["end_byte"])
                owner = holder["id"] if holder else None
                for a, b in t.split(i + 1):
                    var = next((k for k in range(a, b) if t[k].kind == "var"), None)
                    if var is None:
                        continue
                    start = self.type_start(var)
                    name = self.hint(start, var)
                    if not name:
                        continue
                    self.variables[node["id"], t.text(var)[1:]] = name
                    if node["name"] == "__construct" and owner is not None and any(t.text(k).lower() in ("public", "private", "protected", "readonly") for k in range(a, start)):
                        self.properties[owner, t.text(var)[1:]] = name

    def class_at(self, start: int, end: int) -> dict | None:
        at = self.f.container(start, end)
        while at is not None and self.f.nodes[at]["kind"] not in _TYPES.values():
            at = self.f.nodes[at]["parent"]
        return None if at is None else self.f.nodes[at]

    def receiver_type(self, i: int) -> str | None:
        """The class of the expression that ends at token i, before an arrow."""
        t, x = self.t, self.t[i]
        if x.kind == "var" and t.text(i - 1) not in ("->", "?->", "::"):
            if x.text == "$this":
                c = self.class_at(x.start, x.end)
                return c["qname"] if c else None
            holder = self.f.container(x.start, x.end)
            return self.variables.get((holder, x.text[1:])) if holder is not None else None
        if x.kind == "id" and t.text(i - 1) in ("->", "?->") and t.text(i - 2) == "$this" and t.text(i - 3) not in ("->", "?->", "::"):
            c = self.class_at(x.start, x.end)
            return self.properties.get((c["id"], x.text)) if c else None
        if x.text == ")" and i in t.pair:
            a = t.pair[i]
            if t.is_id(a - 1) and t.text(a - 2).lower() == "new":
                return self.full(t.text(a - 1), a)
            if t.text(a - 1) in ("(", "=", ",", "return", ";", "{", "}", "=>", "") or t[a - 1] is END or t.text(a - 1).lower() in ("return", "echo"):
                if t.text(a + 1).lower() == "new" and t.is_id(a + 2):
                    return self.full(t.text(a + 2), a)
                return self.receiver_type(i - 1) if i - 1 > a else None
        if x.kind == "id" and t.text(i - 1).lower() == "new":
            return self.full(x.text, i)
        return None

    # Calls -----------------------------------------------------------------------------

    def chain_start(self, i: int) -> int:
        """First token of the chain of members that ends at i; found once for each end."""
        t, way = self.t, []
        while i not in self.starts:
            way.append(i)
            first = t.pair[i] if t.text(i) in (")", "]") and i in t.pair else i
            if first != i and (t[first - 1].kind in ("id", "var") and t.text(first - 1).lower() not in ("return", "echo", "if", "while") or t.text(first - 1) in (")", "]")):
                i = first - 1
            elif t.text(first - 1) in ("->", "?->", "::") and first > 1:
                i = first - 2
            else:
                self.starts[i] = first - 1 if t.text(first - 1).lower() == "new" else first
        for x in way:
            self.starts[x] = self.starts[i]
        return self.starts[i]

    def references(self) -> None:
        t = self.t
        names = {i for _, i, _ in self.defs}
        for i, x in enumerate(t.all):
            if x.kind != "id" or t.text(i + 1) != "(" or i in names:
                continue
            before, end = t.text(i - 1), t[t.pair.get(i + 1, i + 1)].end
            if before in ("->", "?->"):
                first = self.chain_start(i)
                owner = self.receiver_type(i - 2)
                kind = "method_call" if before == "->" else "nullsafe_method_call"
                self.found.append((kind, x.text, t[first].start, end, f"{owner}::{x.text}" if owner else None, "here"))
            elif before == "::":
                scope = t[i - 2]
                owner = None
                if scope.kind == "id":
                    if scope.text.lower() in ("self", "static"):
                        c = self.class_at(scope.start, end)
                        owner = c["qname"] if c else None
                    elif scope.text.lower() != "parent":
                        owner = self.full(scope.text, i)
                self.found.append(("static_call", x.text, t[self.chain_start(i)].start, end, f"{owner}::{x.text}" if owner else None, "here"))
            elif before.lower() not in ("function", "new", "&") and x.text.lower() not in _NOT_CALLED:
                name = x.text.lstrip("\\")
                self.found.append(("call", x.text, x.start, end, name, "here"))

    def emit(self) -> Facts:
        for kind, name, start, end, qname, at in sorted(self.found, key=lambda r: (r[2], -r[3])):
            if at == "here":
                holder = self.f.container(start, end)
            elif at is None:
                holder = None
            else:
                brace = self.t[at]
                owner = self.class_at(brace.start, brace.end)
                holder = owner["id"] if owner else None
            self.f.ref(kind, name, start, end, qname, None, holder)
        return self.f

    # Calls with arguments, for the framework rules -------------------------------------

    def argument(self, a: int, b: int) -> dict:
        t = self.t
        if t.is_id(a) and t.text(a + 1) == ":" and b - a > 2:  # a named argument
            a += 2
        x = t[a]
        one = b - a == 1
        if one and x.kind == "str" and x.text[:1] in "'\"" and not (x.text[0] == '"' and "$" in x.text):
            return {"kind": "string", "value": re.sub(r"\\(['\"\\])", r"\1", x.text[1:-1]), "items": []}
        if x.kind == "id" and t.text(a + 1) == "::" and t.text(a + 2).lower() == "class" and b - a == 3:
            return {"kind": "class", "value": x.text.lstrip("\\"), "items": []}
        if x.text == "[" and t.pair.get(a) == b - 1 or x.text.lower() == "array" and t.text(a + 1) == "(" and t.pair.get(a + 1) == b - 1:
            items = [self.argument(*r) for r in t.split(a if x.text == "[" else a + 1)]
            return {"kind": "array", "value": None, "items": [f"{i['kind']}:{i['value'] or ''}" for i in items]}
        if x.text.lower() == "new" and t.is_id(a + 1) and (b - a == 2 or t.text(a + 2) == "(" and t.pair.get(a + 2) == b - 1):
            return {"kind": "new", "value": t.text(a + 1).lstrip("\\"), "items": []}
        return {"kind": "other", "value": None, "items": []}

    def scope(self, i: int, end: int) -> str:
        """Names of the definitions around the call that starts at token i, by backslashes."""
        parts, at = [], self.f.container(self.t[i].start, end)
        while at is not None:
            n = self.f.nodes[at]
            if n["kind"] in ("class", "interface", "trait", "enum", "method", "function"):
                parts.append(n["name"])
            at = n["parent"]
        space = self.space(i)
        return "\\".join(([space] if space else []) + parts[::-1])

    def arguments(self) -> None:
        t = self.t
        names = {i for _, i, _ in self.defs}
        for i, x in enumerate(t.all):
            if x.kind != "id" or t.text(i + 1) != "(" or i in names or x.text.lower() in _NOT_CALLED:
                continue
            before = t.text(i - 1)
            end = t[t.pair.get(i + 1, i + 1)].end
            if before == "::" and t.is_id(i - 2):
                kind, receiver, first = "static", t.text(i - 2).lstrip("\\"), i - 2
            elif before in ("->", "?->"):
                first = self.chain_start(i)
                if t.text(i - 2) == "$this":
                    kind, receiver = "this", None
                elif t.text(i - 2) == "app" and t.text(i - 4) == "$this" or t.text(i - 2) == ")" and t.text(t.pair.get(i - 2, i - 2) - 1) == "app":
                    kind, receiver = "container", None
                else:
                    kind, receiver = "other", None
            elif before.lower() in ("new", "function", "::"):
                continue
            else:
                kind, receiver, first = "none", None, i
            self.f.calls.append({"receiver_kind": kind, "receiver": receiver, "method": x.text.lstrip("\\"), "scope": self.scope(first, end), "start": t[first].start, "args": [self.argument(a, b) for a, b in t.split(i + 1)]})


def extract(content: bytes, path: str) -> Facts:
    r = Reader(content)
    r.definitions()
    r.names()
    r.receivers()
    r.references()
    r.arguments()
    return r.emit()
