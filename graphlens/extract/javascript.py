"""JavaScript, TypeScript and TSX: definitions, imports, exports, calls, members, JSX, types."""

from __future__ import annotations

import re

from .base import END, Facts, Token, Tokens

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)+", re.S)
_ID = re.compile(r"[A-Za-z_$#\x80-\xff][\w$\x80-\xff]*")
_NUM = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+n?|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?n?|\.\d+)")
_STR = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?", re.S)
_OP = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\*\*=?|===?|!==?|<<=?|>>>?=|[-+*/%&|^<>]=|\+\+|--|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_JSX_NAME = re.compile(r"[A-Za-z_$\x80-\xff][\w$.:\x80-\xff-]*")
_GENERIC = re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(?:,|extends\b)")

KEYWORDS = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static await async of enum".split())
#: Keywords after which an expression starts.
_BEFORE_EXPR = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
_NOT_METHOD = frozenset("if for while switch catch with function return new await typeof super import".split())
_MODIFIERS = frozenset("async static get set public private protected readonly override abstract declare accessor".split())
_TYPE_WORDS = frozenset("string number boolean any unknown never void object symbol bigint undefined null true false this keyof typeof infer readonly is asserts extends unique in out new abstract".split())


class Lexer:
    """Tokens of a source; JSX is read where an expression may start."""

    def __init__(self, source: str, jsx: bool):
        self.s, self.jsx, self.out = source, jsx, []
        self.elements: list[tuple[str, int, int]] = []  # name, start and end of the opening tag

    def expression_starts(self) -> bool:
        t = self.out[-1] if self.out else END
        if t.kind == "end":
            return True
        if t.kind in ("num", "str"):
            return False
        if t.kind == "id":
            return t.text in _BEFORE_EXPR
        return t.text not in (")", "]", "}")

    def run(self, at: int = 0, inner: bool = False) -> int:
        """Reads code to the end, or, if inner, behind the brace that closes it."""
        s, n, depth = self.s, len(self.s), 0
        while at < n:
            if m := _SPACE.match(s, at):
                at = m.end()
                continue
            c = s[at]
            if c == "`":
                at = self.template(at)
                continue
            if c in "\"'" and (m := _STR.match(s, at)):
                self.out.append(Token(("str", m[0], at, m.end())))
            elif m := _ID.match(s, at):
                self.out.append(Token(("id", m[0], at, m.end())))
            elif (c.isdigit() or c == ".") and (m := _NUM.match(s, at)):
                self.out.append(Token(("num", m[0], at, m.end())))
            elif c == "/" and (self.expression_starts() or self.statement_brace()) and (m := _REGEX.match(s, at)):
                self.out.append(Token(("str", m[0], at, m.end())))
            elif c == "<" and self.jsx and (self.expression_starts() or self.statement_brace()) and (s[at + 1 : at + 2] == ">" or _JSX_NAME.match(s, at + 1)) and not _GENERIC.match(s, at):
                start = at
                at = self.element(at)
                self.out.append(Token(("str", "", start, at)))
                continue
            elif m := _OP.match(s, at):
                if c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if inner and depth < 0:
                        return at
                self.out.append(Token(("op", m[0], at, m.end())))
            else:
                at += 1
                continue
            at = m.end()
        return at

    def statement_brace(self) -> bool:
        return bool(self.out) and self.out[-1].text == "}"

    def braced(self, at: int) -> int:
        """An expression in braces; at is the opening brace."""
        self.out.append(Token(("op", "{", at, at + 1)))
        at = self.run(at + 1, inner=True)
        self.out.append(Token(("op", "}", at, at + 1)))
        return at + 1

    def template(self, at: int) -> int:
        s, start, n = self.s, at, len(self.s)
        at += 1
        while at < n and s[at] != "`":
            if s[at] == "\\":
                at += 2
            elif s.startswith("${", at):
                at = self.braced(at + 1)
            else:
                at += 1
        self.out.append(Token(("str", "", start, at + 1)))
        return at + 1

    def element(self, at: int) -> int:
        """A JSX element, or a run of text and elements up to its closing tag."""
        s, n, start = self.s, len(self.s), at
        at += 1
        name = _JSX_NAME.match(s, at)
        if name:
            at = name.end()
        slot = len(self.elements)
        self.elements.append((name[0] if name else "", start, at))
        while at < n:  # attributes
            if m := _SPACE.match(s, at):
                at = m.end()
            elif s.startswith("/>", at):
                self.elements[slot] = (self.elements[slot][0], start, at + 2)
                return at + 2
            elif s[at] == ">":
                at += 1
                self.elements[slot] = (self.elements[slot][0], start, at)
                break
            elif s[at] == "{":
                at = self.braced(at)
            elif s[at] in "\"'":
                end = s.find(s[at], at + 1)
                at = n if end < 0 else end + 1
            elif s[at] == "<" and _JSX_NAME.match(s, at + 1):
                at = self.element(at)
            else:
                at += 1
        while at < n:  # children
            if s.startswith("</", at):
                end = s.find(">", at)
                return n if end < 0 else end + 1
            if s[at] == "<":
                at = self.element(at)
            elif s[at] == "{":
                at = self.braced(at)
            else:
                at += 1
        return at


class Reader:
    def __init__(self, content: bytes, language: str):
        self.f = Facts(content.decode("latin-1"))
        self.typed = language in ("typescript", "tsx")
        lexer = Lexer(self.f.source, language != "typescript")
        try:
            lexer.run()
        except RecursionError:
            self.f.error("nested too deeply", 0)
        self.elements = lexer.elements
        self.t = Tokens(sorted(lexer.out, key=lambda t: (t.start, t.end)), self.f)
        self.classes: set[int] = set()  # braces of class bodies
        self.shapes: set[int] = set()  # braces of interfaces, which hold no calls
        self.named: set[int] = set()  # name tokens of definitions, which call nothing
        self.bound: dict[str, tuple[str, str]] = {}
        self.spaces: dict[str, str] = {}
        self.found: list[tuple] = []
        self.starts: dict[int, int] = {}

    def read(self) -> Facts:
        self.definitions()
        self.f.nest()
        self.modules()
        self.expressions()
        if self.typed:
            self.types()
        order = sorted(self.found, key=lambda r: (r[2], -r[3]))
        for kind, name, start, end, qname, alias, free in order:
            self.f.ref(kind, name, start, end, qname, alias, None if free else self.f.container(start, end))
        return self.f

    def add(self, kind: str, name: str, start: int, end: int, qname: str | None = None, alias: str | None = None, free: bool = False) -> None:
        self.found.append((kind, name, start, end, qname, alias, free))

    # Definitions -----------------------------------------------------------------------

    def at_statement(self, i: int) -> bool:
        """Whether a declaration can start at i."""
        p = self.t[i - 1]
        if p.kind == "end" or p.text in (";", "{", "}", ")", "export", "default", "async", "declare", "abstract", ":"):
            return p.text != ":" or self.t.text(i - 2) in ("default",)
        return p.kind != "op" and "\n" in self.f.source[p.end : self.t[i].start] and p.text not in _BEFORE_EXPR

    def definitions(self) -> None:
        t = self.t
        objects = {i for i, x in enumerate(t.all) if x.text == "{" and x.kind == "op" and (t.text(i - 1) in ("=", "(", ",", ":", "[", "return", "?", "&&", "||", "??", "default", "..."))}
        for i, x in enumerate(t.all):
            if x.kind == "id" and x.text == "class" and t.text(i - 1) != ".":
                brace = t.find(i + 1, "{", stop=(";",))
                if brace < 0:
                    continue
                self.classes.add(brace)
                if t.is_id(i + 1) and t.text(i + 1) not in ("extends", "implements") and self.at_statement(i):
                    first = i - 1 if t.text(i - 1) == "abstract" else i
                    self.named.add(i + 1)
                    self.f.node("class", t.text(i + 1), None, t[first].start, t[t.pair[brace]].end)
        for i, x in enumerate(t.all):
            if x.kind != "id":
                continue
            if x.text == "function" and t.text(i - 1) != ".":
                name = i + 2 if t.text(i + 1) == "*" else i + 1
                if t.is_id(name):
                    self.named.add(name)
                    brace = self.body(t.find(name + 1, "(", stop=(";",)))
                    if brace >= 0 and self.at_statement(i):
                        first = i - 1 if t.text(i - 1) == "async" else i
                        self.f.node("function", t.text(name), None, t[first].start, t[t.pair[brace]].end)
            elif x.text in ("const", "let", "var") and t.text(i - 1) != ".":
                self.declarators(i)
            elif self.typed and x.text == "interface" and t.is_id(i + 1) and self.at_statement(i):
                brace = t.find(i + 2, "{", stop=(";",))
                if brace >= 0:
                    self.shapes.add(brace)
                    self.named.add(i + 1)
                    self.f.node("interface", t.text(i + 1), None, x.start, t[t.pair[brace]].end)
            elif self.typed and x.text == "type" and t.is_id(i + 1) and t.text(i + 2) in ("=", "<") and self.at_statement(i):
                end = self.statement_end(t.find(i + 2, "=") + 1)
                self.named.add(i + 1)
                self.f.node("type_alias", t.text(i + 1), None, x.start, t[end].end)
            elif t.text(i + 1) in ("(", "<") and x.text not in _NOT_METHOD and (t.owner[i] in self.classes or t.owner[i] in objects):
                before = t[i - 1]
                if before.text not in ("{", "}", ";", ",", "*", ")") and before.text not in _MODIFIERS and "\n" not in self.f.source[before.end : x.start]:
                    continue
                if before.text in (".", "?.", "=", "=>", ":", "?", "new"):
                    continue
                paren = i + 1 if t.text(i + 1) == "(" else t.find(i + 1, "(", stop=(";", "{"))
                brace = self.body(paren)
                if brace >= 0 and (t.owner[i] in self.classes or t.text(t.after(paren)) in ("{", ":")):
                    first = i
                    while t.text(first - 1) in _MODIFIERS or t.text(first - 1) == "*":
                        first -= 1
                    self.named.add(i)
                    self.f.node("method", x.text, None, t[first].start, t[t.pair[brace]].end)

    def body(self, paren: int) -> int:
        """The brace of the body behind a parameter list, past a return type; -1 if none."""
        if paren < 0:
            return -1
        i = self.t.after(paren)
        if self.t.text(i) == "{":
            return i
        if self.typed and self.t.text(i) == ":":
            j = i + 1
            while j < len(self.t):
                x = self.t.text(j)
                if x == "{":
                    # A brace behind a type operator is a type itself.
                    if self.t.text(j - 1) in (":", "|", "&", "<", ",", "=>", "("):
                        j = self.t.after(j)
                        continue
                    return j
                if x in (";", "}", ")") or x == "=" or x == ",":
                    return -1
                j = self.t.after(j) if x in ("(", "[") else j + 1
        return -1

    def statement_end(self, i: int) -> int:
        """Last token of the expression that starts at i."""
        t, last = self.t, i
        while i < len(t):
            x = t[i]
            if x.kind == "op" and x.text in (";", ",", ")", "]", "}"):
                break
            if i > last and x.kind != "op" and "\n" in self.f.source[t[last].end : x.start] and (t[last].kind != "op" or t[last].text in (")", "]", "}")) and t.text(last) not in _BEFORE_EXPR and x.text not in ("in", "instanceof", "as", "of"):
                break
            last = i
            if x.kind == "op" and x.text in ("(", "[", "{"):
                last = t.pair.get(i, len(t) - 1)
                # The body of a function ends its statement where a line ends.
            i = last + 1
        return last

    def declarators(self, i: int) -> None:
        t, j = self.t, i + 1
        while j < len(t):
            if t.text(j) in ("{", "["):
                j = t.after(j)
                name = -1
            elif t.is_id(j) and t.text(j) not in KEYWORDS - {"of", "async", "static", "let", "await"}:
                name = j
                j += 1
            else:
                return
            k = j
            if self.typed and t.text(k) in (":", "!"):
                while k < len(t) and t.text(k) not in ("=", ";", ",", ")", "}") and not (t[k].kind == "id" and t.text(k) in ("of", "in")):
                    if k > j + 1 and "\n" in self.f.source[t[k - 1].end : t[k].start] and t[k].kind == "id":
                        break
                    k = t.after(k) if t.text(k) in ("(", "[", "{") else k + 1
            if t.text(k) == "=":
                end = self.statement_end(k + 1)
                kind = self.kind_of(k + 1)
            else:
                end, kind = max(k - 1, j - 1), "variable"
            if name >= 0:
                self.named.add(name)
                self.f.node(kind, t.text(name), None, t[name].start, t[end].end)
            j = end + 1
            if t.text(j) != ",":
                return
            j += 1

    def kind_of(self, i: int) -> str:
        t = self.t
        if t.text(i) == "async":
            i += 1
        if t.text(i) == "function":
            return "function"
        if t.text(i) == "class":
            return "class"
        if t.is_id(i) and t.text(i + 1) == "=>":
            return "arrow_function"
        if self.typed and t.text(i) == "<":
            i = t.find(i, "(", stop=(";",))
        if i >= 0 and t.text(i) == "(":
            k = t.after(i)
            if t.text(k) == ":" and self.typed:
                k = t.find(k, "=>", stop=(";", "="))
            if k >= 0 and t.text(k) == "=>":
                return "arrow_function"
        return "variable"

    # Imports and exports ---------------------------------------------------------------

    def string(self, i: int) -> str | None:
        x = self.t[i]
        return x.text[1:-1] if x.kind == "str" and x.text[:1] in ("'", '"') else None

    def modules(self) -> None:
        t = self.t
        for i, x in enumerate(t.all):
            if x.kind != "id" or t.text(i - 1) in (".", "?."):
                continue
            if x.text == "import" and t.text(i + 1) not in ("(", "."):
                self.import_(i)
            elif x.text == "export":
                self.export(i)
            elif x.text == "require" and t.text(i + 1) == "(" and (module := self.string(i + 2)) is not None:
                self.add("import_cjs", module, x.start, t[t.pair.get(i + 1, i + 1)].end, free=True)
            elif x.text in ("module", "exports") and t.text(i + 1) == ".":
                eq = i + 3
                if t.text(eq) == "=" and (x.text == "exports" or t.text(i + 2) == "exports"):
                    self.add("export_cjs", f"{x.text}.{t.text(i + 2)}", x.start, t[self.statement_end(eq + 1)].end, free=True)

    def import_(self, i: int) -> None:
        t, j = self.t, i + 1
        if t.text(j) == "type" and t.text(j + 1) not in ("from", ","):
            j += 1
        if (module := self.string(j)) is not None:
            self.add("import_esm", module, t[i].start, t[j].end, free=True)
            return
        frm = t.find(j, "from", stop=(";",))
        module = self.string(frm + 1) if frm >= 0 else None
        if module is None:
            return
        self.add("import_esm", module, t[i].start, t[frm + 1].end, free=True)
        while j < frm:
            if t.text(j) == "*" and t.text(j + 1) == "as":
                local = t.text(j + 2)
                self.spaces[local] = module
                self.add("import_namespace", "*", t[j].start, t[j + 2].end, module, local, True)
                j += 3
            elif t.text(j) == "{":
                for a, b in t.split(j):
                    if t.text(a) == "type" and b - a > 1 and t.text(a + 1) != "as":
                        a += 1
                    symbol, local = t.text(a), t.text(b - 1)
                    self.bound[local] = (module, symbol)
                    self.add("import_named", symbol, t[a].start, t[b - 1].end, module, local, True)
                j = t.after(j)
            elif t.is_id(j):
                self.bound[t.text(j)] = (module, "default")
                self.add("import_default", "default", t[j].start, t[j].end, module, t.text(j), True)
                j += 1
            else:
                j += 1

    def export(self, i: int) -> None:
        t, j = self.t, i + 1
        default = t.text(j) == "default"
        j += default
        while t.text(j) in ("async", "abstract", "declare"):
            j += 1
        name, end = None, j
        word = t.text(j)
        if word in ("function", "class", "interface", "type", "enum", "const", "let", "var", "namespace") and t.text(j + 1) != "{":
            k = j + 2 if t.text(j + 1) == "*" else j + 1
            if word == "type" and t.text(k) in ("*", "{"):
                word = t.text(k)
                j = k
            elif t.is_id(k) and t.text(k) not in ("extends",):
                name = t.text(k)
        if word in ("function", "class", "interface", "enum", "namespace"):
            brace = self.body(t.find(j, "(", stop=(";", "{"))) if word == "function" else t.find(j, "{", stop=(";",))
            end = t.pair.get(brace, j) if brace >= 0 else j
        elif word in ("{", "*"):
            end = t.pair.get(j, j) if word == "{" else j + (2 if t.text(j + 1) == "as" else 0)
            if t.text(end + 1) == "from" and (module := self.string(end + 2)) is not None:
                name, end = module, end + 2
        else:
            end = self.statement_end(j)
        self.add("export_esm", name or ("default" if default else "export"), t[i].start, t[end].end, free=True)

    # Expressions -----------------------------------------------------------------------

    def chain_start(self, i: int) -> int:
        """First token of the member chain that ends at i; found once for each end."""
        t, way = self.t, []
        while i not in self.starts:
            way.append(i)
            first = t.pair[i] if t.text(i) in (")", "]", "}") and i in t.pair else i
            if first != i and (t.is_id(first - 1) and t.text(first - 1) not in KEYWORDS or t.text(first - 1) in (")", "]")):
                i = first - 1
            elif t.text(first - 1) in (".", "?.") and first > 1:
                i = first - 2
            else:
                self.starts[i] = first
        for x in way:
            self.starts[x] = self.starts[i]
        return self.starts[i]

    def bound_name(self, name: str) -> str | None:
        return "#".join(self.bound[name]) if name in self.bound else None

    def of_space(self, name: str, member: str) -> str | None:
        return f"{self.spaces[name]}#{member}" if name in self.spaces else None

    def call_paren(self, i: int) -> int:
        """The parenthesis of a call whose callee ends at i; -1 if it is none."""
        t = self.t
        j = i + 1
        if t.text(j) == "?." and t.text(j + 1) == "(":
            return j + 1
        if t.text(j) == "(":
            return j
        if self.typed and t.text(j) == "<":
            k, depth = j, 0
            while k < len(t) and k < j + 60:
                x = t.text(k)
                if x == "<":
                    depth += 1
                elif x == ">":
                    depth -= 1
                    if not depth:
                        return k + 1 if t.text(k + 1) == "(" else -1
                elif x in (";", "(", ")", "&&", "||", "=", "+", "-"):
                    return -1
                k = t.after(k) if x in ("{", "[") else k + 1
        return -1

    def expressions(self) -> None:
        t = self.t
        for i, x in enumerate(t.all):
            if x.kind != "id":
                continue
            member = t.text(i - 1) in (".", "?.") and t[i - 1].kind == "op"
            paren = self.call_paren(i)
            if member:
                if t.text(i - 2) in ("import", "new"):
                    continue
                first = self.chain_start(i)
                one = t.is_id(i - 2) and first == i - 2
                qname = self.of_space(t.text(i - 2), x.text) if one else None
                if paren >= 0 and t.text(first - 1) != "new":
                    self.add("member_call", x.text, t[first].start, t[t.pair.get(paren, paren)].end, qname)
                else:
                    self.add("member_access", x.text, t[first].start, x.end, qname)
            elif paren >= 0 and x.text not in KEYWORDS - {"async", "of", "static", "let"} and x.text != "require" and i not in self.named and t.owner[i] not in self.shapes and t.text(i - 1) not in ("new", "function"):
                self.add("call", x.text, x.start, t[t.pair.get(paren, paren)].end, self.bound_name(x.text))
        for name, start, end in self.elements:
            if not name:
                continue
            head, dot, rest = name.partition(".")
            kind = "jsx_component" if head[:1].isupper() and head[:1].isascii() or head[:1] in "_$" else "jsx_element"
            self.add(kind, name, start, end, self.of_space(head, rest) if dot else self.bound_name(name))

    # Types -----------------------------------------------------------------------------

    def types(self) -> None:
        t, seen = self.t, set()

        def take(i: int, stop: tuple[str, ...]) -> int:
            """The type that starts at i; index behind it."""
            depth = 0
            while i < len(t):
                x = t[i]
                if x.kind == "op":
                    if x.text == "<":
                        depth += 1
                    elif x.text in (">", ">>", ">>>"):
                        if depth < len(x.text):
                            return i
                        depth -= len(x.text)
                    elif not depth and x.text in stop or x.text in (")", "]", "}", ";"):
                        return i
                    elif x.text == "{" and not depth and t.text(i - 1) not in (":", "|", "&", "=>", "=", ",", "<", "(", "as", "extends"):
                        return i
                    elif x.text in ("(", "[", "{"):
                        # Names before a colon are parameters or members; types inside are
                        # found by their own colons.
                        if x.text in ("(", "["):
                            for a, b in t.split(i):
                                if t.find(a, ":", stop=(",",)) < 0:
                                    take(a, (",",)) if b > a else None
                        i = t.after(i)
                        continue
                elif x.kind == "id":
                    # A name that starts a line of its own is the next statement.
                    if i and t[i - 1].kind in ("id", "str", "num") and "\n" in self.f.source[t[i - 1].end : x.start] and t.text(i - 1) not in _TYPE_WORDS:
                        return i
                    if t.text(i - 1) == "." or t.text(i + 1) == ".":
                        if t.text(i + 1) != ".":
                            seen.add(i)
                    elif x.text not in _TYPE_WORDS:
                        seen.add(i)
                i += 1
            return i

        for i, x in enumerate(t.all):
            if x.kind == "id" and x.text in ("as", "satisfies") and t[i - 1].kind != "op" or x.text in ("as", "satisfies") and t.text(i - 1) in (")", "]", "}"):
                if t.text(i + 1) != "const" and not self.in_import(i):
                    take(i + 1, (",", "=", "?", "&&", "||", "+", "-", ":"))
            elif x.kind == "id" and x.text == "implements" or x.kind == "id" and x.text == "extends" and self.heads(i):
                take(i + 1, ("{",))
            elif x.kind == "id" and x.text == "type" and t.is_id(i + 1) and (i + 1) in self.named:
                eq = t.find(i + 2, "=")
                if eq >= 0:
                    take(eq + 1, ())
            elif x.kind == "op" and x.text == ":" and self.annotates(i):
                take(i + 1, (",", "=", "=>"))
            elif x.kind == "op" and x.text == "<" and t.is_id(i - 1) and (self.call_paren(i - 1) >= 0 or t.text(i - 2) in ("class", "interface", "type", "new", "extends")):
                j = i + 1
                while j < len(t) and t.text(j - 1) != ">" and j < i + 60:
                    if t.text(i - 2) in ("class", "interface", "type") and t.text(j) not in ("extends",) and t.is_id(j):
                        j += 1  # a type parameter's own name
                        if t.text(j) == "extends":
                            j = take(j + 1, (",", "="))
                    else:
                        j = take(j, (",",))
                    j += 1
        ends = {t[i].end for i in seen}
        self.found = [r for r in self.found if not (r[0] == "member_access" and r[3] in ends)]
        for i in sorted(seen):
            if i not in self.named:
                self.add("type_reference", t.text(i), t[i].start, t[i].end)

    def in_import(self, i: int) -> bool:
        j = i
        while j >= 0 and self.t.text(j) not in (";",) and i - j < 40:
            if self.t.text(j) in ("import", "export"):
                return True
            j -= 1
        return False

    def heads(self, i: int) -> bool:
        """Whether `extends` at i stands in the head of an interface or type parameters."""
        j = i - 1
        while j >= 0 and i - j < 40 and self.t.text(j) not in ("{", "}", ";", "class"):
            if self.t.text(j) == "interface":
                return True
            j -= 1
        return False

    def annotates(self, i: int) -> bool:
        """Whether the colon at i comes before a type, not a value or a case."""
        t = self.t
        before = t[i - 1]
        if before.text == "?" or before.text == ")":
            j = t.pair.get(i - 1, i - 1) if before.text == ")" else i - 2
            return not self.ternary(j)
        if before.text in ("}", "]"):  # a pattern with a type
            j = t.pair.get(i - 1, i - 1)
            return t.text(j - 1) in ("(", ",", "const", "let", "var") and not self.ternary(j)
        if before.kind != "id" or before.text in ("default", "case") or t.text(i - 2) == "case":
            return False
        if t.owner[i] >= 0 and t.owner[i] not in self.classes and self.in_object(i):
            return False
        return not self.ternary(i - 1)

    def in_object(self, i: int) -> bool:
        """Whether the innermost bracket around i is an object literal."""
        t, j = self.t, self.t.inside[i]
        if j < 0 or t.text(j) != "{" or t.text(j - 1) == "=" and t.text(j - 3) == "type":
            return False
        return t.text(j - 1) in ("=", "(", ",", ":", "[", "return", "?", "&&", "||", "??", "default")

    def ternary(self, i: int) -> bool:
        t, j = self.t, i - 1
        while j >= 0 and i - j < 60:
            x = t.text(j)
            if x in (")", "]", "}") and j in t.pair:
                j = t.pair[j] - 1
                continue
            if x in ("{", "(", "[", ";", ",", "=>", "const", "let", "var"):
                return False
            if x == "?" and t[j].kind == "op" and t.text(j + 1) != ":":
                return True
            j -= 1
        return False


def extract(content: bytes, path: str, language: str = "javascript") -> Facts:
    return Reader(content, language).read()
