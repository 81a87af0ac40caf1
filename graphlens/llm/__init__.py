"""Training-data operators over documents and pages.  Nothing outside imports this."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module with a function of that name and, where SQL can say it, SQL.
_QUERIES = {
    "op1_imatch": "op1_imatch",
    "op2_mixing": "op2_mixing",
    "op3_pii": "op3_pii",
    "op4_quality": "op4_quality",
    "op5_tokens": "op5_tokens",
    "op6_suffix": "op6_suffix",
    "op7_merkle": "op7_merkle",
    "op8_neardup": "op8_neardup",
    "op9_decontam": "op9_decontam",
    "op10_html": "op10_html",
}


def _module(name: str):
    return import_module(f"{__name__}.{_QUERIES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).SQL for name in _QUERIES if hasattr(_module(name), "SQL")}
