"""Python: definitions, imports, constants, calls, bases and decorators."""

from __future__ import annotations

import ast
import re
import warnings

from .base import Facts

_CONSTANT = re.compile(r"[A-Z0-9_]*[A-Z][A-Z0-9_]*\Z")
#: Lines that may be blanked, one after another, to read the rest of a broken file.
REPAIRS = 200


def _tree(content: bytes, facts: Facts) -> tuple[ast.Module | None, bytes]:
    """The syntax tree; lines with errors are replaced by `pass` and reported."""
    text = content.decode("utf-8", "replace").replace("\x00", " ")
    lines = text.split("\n")
    for _ in range(REPAIRS):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return ast.parse("\n".join(lines)), "\n".join(lines).encode("utf-8", "replace")
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            while at > 0 and not lines[at].strip():
                at -= 1
            if not lines[at].strip():
                break
            facts.error(e.msg or "syntax error", min(sum(len(x.encode("utf-8", "replace")) + 1 for x in lines[:at]), len(facts.source)))
            body = lines[at].strip()
            indent = len(lines[at]) - len(lines[at].lstrip())
            # The same length, so that what follows keeps its place; a block stays a block.
            stand_in = "if 1:" if body.endswith(":") and body != "if 1:" else "pass" if body not in ("pass", "if 1:") else ""
            lines[at] = (lines[at][:indent] + stand_in).ljust(len(lines[at])) if len(body) >= len(stand_in) else " " * len(lines[at])
            if "indent" in (e.msg or "") and "expected an indented" not in (e.msg or ""):
                lines[at] = " " * len(lines[at])
        except (ValueError, RecursionError, MemoryError) as e:
            facts.error(str(e) or "unreadable", 0)
            return None, content
    return None, content


def _chain(node: ast.expr) -> str:
    """Dotted name of a callee, through calls; empty for other expressions."""
    parts = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Name):
            parts.append(node.id)
            break
        else:
            break
    return ".".join(reversed(parts))


def extract(content: bytes, path: str) -> Facts:
    facts = Facts(content.decode("latin-1"))
    tree, shown = _tree(content, facts)
    if tree is None:
        facts.nest()
        return facts
    starts = [0]
    for line in shown.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    at = lambda n: (starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset)
    latin = lambda s: s.encode("utf-8", "replace").decode("latin-1")
    defs: list[tuple[ast.AST, dict]] = []
    stack: list[tuple[ast.AST, tuple[str, ...], bool]] = [(n, (), False) for n in reversed(tree.body)]
    while stack:
        node, scope, in_class = stack.pop()
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if in_class else "function"
            inner = (*scope, node.name)
            defs.append((node, facts.node(kind, latin(node.name), latin(".".join(inner)), *at(node))))
            stack += [(n, inner, is_class) for n in reversed(node.body)]
            continue
        if not scope and isinstance(node, ast.Assign | ast.AnnAssign) and node in tree.body:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name) and _CONSTANT.match(target.id):
                    facts.node("constant", latin(target.id), None, *at(node))
        stack += [(n, scope, False) for n in reversed(list(ast.iter_child_nodes(node))) if isinstance(n, ast.stmt | ast.ExceptHandler | ast.match_case)]
    facts.nest()
    text = lambda n: shown[slice(*at(n))].decode("latin-1")
    found: list[tuple[int, tuple]] = []
    for node, made in defs:
        if isinstance(node, ast.ClassDef):
            for base in node.bases:
                found.append((at(base)[0], ("inheritance", text(base), *at(base), None, None, made["id"])))
            for k in node.keywords:
                found.append((at(k)[0], ("inheritance", text(k), *at(k), None, None, made["id"])))
        for d in node.decorator_list:
            found.append((at(d)[0], ("decorator", text(d), *at(d), None, None, made["id"])))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                found.append((at(a)[0], ("import", latin(a.name), *at(a), None, latin(a.asname) if a.asname else None, None)))
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for a in node.names:
                found.append((at(a)[0], ("import", latin(a.name), *at(a), latin(f"{module}.{a.name}"), latin(a.asname) if a.asname else None, None)))
        elif isinstance(node, ast.Call) and (name := _chain(node.func)):
            found.append((at(node)[0], ("call", latin(name), *at(node), None, None, facts.container(*at(node)))))
    for _, (kind, name, start, end, qname, alias, container) in sorted(found, key=lambda x: (x[0], -x[1][3])):
        facts.ref(kind, name, start, end, qname, alias, container)
    return facts
