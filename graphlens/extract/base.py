"""What extractors share: facts of a file, a lexer for brace languages, spans.

Sources are read as Latin-1, one sign per byte, so that places in the text are byte
offsets; names are turned back into UTF-8 when they are taken.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


def utf8(text: str) -> str:
    return text.encode("latin-1").decode("utf-8", "replace")


@dataclass
class Facts:
    """Definitions, references and diagnostics of one file, in source order."""

    source: str
    nodes: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._lines = [0, *(m.end() for m in re.finditer("\n", self.source))]

    def span(self, start: int, end: int) -> dict:
        a, b = bisect_right(self._lines, start) - 1, bisect_right(self._lines, end) - 1
        return {"start_byte": start, "end_byte": end, "start_row": a, "start_col": start - self._lines[a], "end_row": b, "end_col": end - self._lines[b]}

    def node(self, kind: str, name: str, qname: str | None, start: int, end: int, parent: int | None = None) -> dict:
        name = utf8(name)
        self.nodes.append({"id": len(self.nodes), "kind": kind, "name": name, "qname": name if qname is None else utf8(qname), "span": self.span(start, end), "parent": parent})
        return self.nodes[-1]

    def ref(self, kind: str, name: str, start: int, end: int, qname: str | None = None, alias: str | None = None, container: int | None = None) -> dict:
        up = lambda x: None if x is None else utf8(x)
        self.refs.append({"id": len(self.refs), "kind": kind, "name": utf8(name), "qname": up(qname), "alias": up(alias), "span": self.span(start, end), "container": container})
        return self.refs[-1]

    def error(self, message: str, start: int, end: int | None = None) -> None:
        self.diagnostics.append({"severity": "Error", "message": message, "span": self.span(start, start if end is None else end)})

    def enclosing(self, start: int, end: int, test: Callable[[dict], bool] = lambda n: True) -> int | None:
        """The smallest definition that strictly holds [start, end), of equals the first."""
        best, size = None, 0
        for n in self.nodes:
            a, b = n["span"]["start_byte"], n["span"]["end_byte"]
            if a <= start and b >= end and (a < start or b > end) and (best is None or b - a < size) and test(n):
                best, size = n["id"], b - a
        return best

    def nest(self) -> None:
        """Sorts definitions by place and gives each its parent; references must be added
        after this, as ids follow the order."""
        self.nodes.sort(key=lambda n: (n["span"]["start_byte"], -n["span"]["end_byte"]))
        open_: list[dict] = []
        for i, n in enumerate(self.nodes):
            n["id"] = i
            while open_ and (open_[-1]["span"]["end_byte"] < n["span"]["end_byte"] or open_[-1]["span"] == n["span"]):
                open_.pop()
            n["parent"] = open_[-1]["id"] if open_ else None
            open_.append(n)
        self._sorted = [n["span"]["start_byte"] for n in self.nodes]

    def container(self, start: int, end: int) -> int | None:
        """As enclosing(), for nested definitions: walks up from the last that starts before."""
        i = bisect_right(self._sorted, start) - 1
        at = i if i >= 0 else None
        while at is not None:
            s = self.nodes[at]["span"]
            if s["end_byte"] >= end and (s["start_byte"] < start or s["end_byte"] > end):
                return at
            at = self.nodes[at]["parent"]
        return None


class Token(tuple):
    """(kind, text, start, end); kind is id, num, str or op."""

    __slots__ = ()
    kind = property(lambda t: t[0])
    text = property(lambda t: t[1])
    start = property(lambda t: t[2])
    end = property(lambda t: t[3])


END = Token(("end", "", 0, 0))


class Tokens:
    """A token list with the partner of each bracket and the brackets each token stands in."""

    def __init__(self, tokens: Iterable[Token], facts: Facts):
        self.all = list(tokens)
        self.pair: dict[int, int] = {}
        self.owner: list[int] = []  # the innermost open brace
        self.inside: list[int] = []  # the innermost open bracket of any kind
        stack: list[int] = []
        braces: list[int] = []
        close = {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.all):
            if t.kind == "op" and t.text in close:
                # A bracket that does not fit closes nothing; one left open is reported.
                if any(self.all[j].text == close[t.text] for j in stack[-3:]):
                    while stack and self.all[stack[-1]].text != close[t.text]:
                        facts.error(f"unclosed {self.all[stack[-1]].text}", self.all[stack.pop()].start)
                    j = stack.pop()
                    self.pair[i], self.pair[j] = j, i
                    if t.text == "}" and braces and braces[-1] == j:
                        braces.pop()
                else:
                    facts.error(f"unexpected {t.text}", t.start, t.end)
            self.owner.append(braces[-1] if braces else -1)
            self.inside.append(stack[-1] if stack else -1)
            if t.kind == "op" and t.text in "([{" and t.text:
                stack.append(i)
                if t.text == "{":
                    braces.append(i)
        for j in stack:
            facts.error(f"unclosed {self.all[j].text}", self.all[j].start, self.all[j].end)
            self.pair.setdefault(j, len(self.all) - 1)

    def __getitem__(self, i: int) -> Token:
        return self.all[i] if 0 <= i < len(self.all) else END

    def __len__(self) -> int:
        return len(self.all)

    def text(self, i: int) -> str:
        return self[i].text

    def is_id(self, i: int) -> bool:
        return self[i].kind == "id"

    def after(self, i: int) -> int:
        """Index behind the bracket pair that opens at i."""
        return self.pair.get(i, len(self.all) - 1) + 1

    def find(self, i: int, *texts: str, stop: tuple[str, ...] = ()) -> int:
        """The next of the texts from i on, passing over bracket pairs; -1 if none."""
        while i < len(self.all):
            t = self.all[i]
            if t.kind == "op" or t.kind == "id":
                if t.text in texts:
                    return i
                if t.text in stop or t.text in (")", "]", "}"):
                    return -1
                if t.text in ("(", "[", "{"):
                    i = self.after(i)
                    continue
            i += 1
        return -1

    def split(self, i: int, separator: str = ",") -> list[tuple[int, int]]:
        """Index ranges between separators inside the bracket pair that opens at i."""
        out, start, j, end = [], i + 1, i + 1, self.pair.get(i, len(self.all) - 1)
        while j < end:
            t = self.all[j]
            if t.kind == "op" and t.text in ("(", "[", "{"):
                j = self.after(j)
                continue
            if t.text == separator and t.kind == "op":
                out.append((start, j))
                start = j + 1
            j += 1
        if start < end:
            out.append((start, end))
        return [r for r in out if r[0] < r[1]]


def lex(source: str, pattern: re.Pattern) -> Iterable[Token]:
    """Tokens by a pattern with groups skip, str, id, num and op."""
    for m in pattern.finditer(source):
        kind = m.lastgroup
        if kind and kind != "skip":
            yield Token((kind, m[0], m.start(), m.end()))
