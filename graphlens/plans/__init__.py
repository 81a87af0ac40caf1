"""The registered queries over the test tables, with their SQL equivalents."""

from __future__ import annotations

from . import code, code_files, graph, languages, relational


def queries() -> dict:
    return {k: q for m in (graph, relational, code, code_files, languages) for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in (graph, relational, code, code_files, languages) for k, (_, sql) in m.QUERIES.items() if sql}
