"""Blade templates: sections, stacks, components, directives, tags and expressions."""

from __future__ import annotations

import re

from .base import Facts

_COMMENT = re.compile(r"\{\{--.*?(?:--\}\}|\Z)", re.S)
_DIRECTIVE = re.compile(r"(?<![\w@])@([A-Za-z]+)[ \t]*")
_LITERAL = re.compile(r"\(\s*(['\"])((?:[^\\]|\\.)*?)\1", re.S)
_TAG = re.compile(r"<x-([A-Za-z][\w.:-]*)")
_ECHO = re.compile(r"\{\{(?!--)\s*(.*?)\s*\}\}|\{!!\s*(.*?)\s*!!\}", re.S)
# What each directive means.
INCLUDES = ("include", "includeIf", "includeWhen", "includeUnless", "includeFirst", "each")
BLOCKS = {
    "section": ("blade_section", ("endsection", "show", "stop", "append", "overwrite")),
    "push": ("blade_push_block", ("endpush",)),
    "pushOnce": ("blade_push_block", ("endPushOnce",)),
    "pushIf": ("blade_push_block", ("endPushIf",)),
    "prepend": ("blade_prepend_block", ("endprepend",)),
    "prependOnce": ("blade_prepend_block", ("endPrependOnce",)),
    "component": ("blade_component_block", ("endcomponent",)),
    "php": ("blade_php_block", ("endphp",)),
}
PLACES = {"yield": "blade_yield", "stack": "blade_stack"}
CONTROL = ("if", "unless", "foreach", "forelse", "for", "while", "switch")
OTHER_BLOCKS = ("if", "unless", "isset", "empty", "auth", "guest", "foreach", "forelse", "for", "while", "switch", "once", "verbatim", "error", "can", "env", "production")


def _call_end(source: str, at: int) -> int:
    """Behind the parenthesis that closes the one at `at`."""
    depth, quote = 0, ""
    while at < len(source):
        c = source[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return len(source)


def extract(content: bytes, path: str) -> Facts:
    f = Facts(content.decode("latin-1"))
    source = _COMMENT.sub(lambda m: " " * len(m[0]), f.source)
    found: list[tuple] = []
    nodes: list[tuple[str, str, int, int]] = []
    open_: list[tuple[str, str, str, int]] = []  # directive, kind, name, start
    for m in _DIRECTIVE.finditer(source):
        word, start, end = m[1], m.start(), m.end()
        literal = None
        if source[end : end + 1] == "(":
            hit = _LITERAL.match(source, end)
            literal = re.sub(r"\\(.)", r"\1", hit[2]) if hit else None
            end = _call_end(source, end)
        else:
            end = start + 1 + len(word)
        for i in range(len(open_) - 1, -1, -1):
            closers = BLOCKS[open_[i][0]][1] if open_[i][0] in BLOCKS else (f"end{open_[i][0]}",)
            if word in closers:
                _, kind, name, at = open_[i]
                nodes.append((kind, name, at, end))
                for d in open_[i + 1 :]:
                    f.error(f"unclosed @{d[0]}", d[3])
                del open_[i:]
                break
        else:
            if word in PLACES:
                if literal is not None:
                    nodes.append((PLACES[word], literal, start, end))
                    found.append(("blade_section_ref" if word == "yield" else "blade_stack_ref", literal, start, end))
            elif word in BLOCKS:
                kind = BLOCKS[word][0]
                if word == "component" and literal is not None:
                    found.append(("blade_component", literal, start, end))
                if word == "section" and source[end - 1 : end] == ")" and re.search(r"\(\s*(['\"]).*?\1\s*,", source[m.end() : end], re.S):
                    nodes.append((kind, literal or "", start, end))  # a section given in one call
                elif word != "php" or source[m.end() : m.end() + 1] != "(":
                    open_.append((word, kind, literal if literal is not None else word, start))
            elif word in OTHER_BLOCKS and (word in CONTROL or f"@end{word}" in source):
                open_.append((word, "blade_directive_block", word, start))
            elif word == "extends" and literal is not None:
                found.append(("blade_extends", literal, start, end))
            elif word in INCLUDES and literal is not None:
                found.append(("blade_view", literal, start, end))
    for word, kind, name, at in open_:
        f.error(f"unclosed @{word}", at)
        if word in BLOCKS:
            nodes.append((kind, name, at, len(source)))
    for m in _TAG.finditer(source):
        found.append(("blade_x_component", m[1], m.start(), m.end()))
    for m in _ECHO.finditer(source):
        found.append(("blade_php_expression", m[1] if m[1] is not None else m[2], m.start(), m.end()))
    opened = source.count("{{") - source.count("}}")
    if opened > 0:
        f.error("unclosed {{", source.rfind("{{"))
    for kind, name, start, end in sorted(nodes, key=lambda n: (n[2], -n[3])):
        f.node(kind, name, "", start, end)
    for kind, name, start, end in sorted(found, key=lambda r: (r[2], -r[3])):
        f.ref(kind, name, start, end)
    return f
