"""Tools by name, one JSON request a line."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from .render import render
from .session import GraphSession

# Codes of errors.
PARSE, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL, APPLICATION = -32700, -32600, -32601, -32602, -32603, -32000


def _plain(value: object) -> object:
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return value


def handle(session: GraphSession, line: str) -> dict:
    """The reply to one request {"id", "method", "params"}; params.format "markdown" gives
    text instead of rows."""
    try:
        request = json.loads(line)
    except ValueError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": str(e)}}
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None, "error": {"code": INVALID_REQUEST, "message": "no method"}}
    reply: dict = {"jsonrpc": "2.0", "id": request.get("id")}
    params = request.get("params") or {}
    if request["method"] not in session.tools:
        return reply | {"error": {"code": NO_METHOD, "message": f"unknown method {request['method']}"}}
    if not isinstance(params, dict):
        return reply | {"error": {"code": INVALID_PARAMS, "message": "params must be an object"}}
    params = dict(params)
    as_text = params.pop("format", None) == "markdown"
    try:
        rows = session.call(request["method"], **params).collect()
    except (TypeError, ValueError) as e:
        return reply | {"error": {"code": INVALID_PARAMS, "message": str(e)}}
    except Exception as e:  # noqa: BLE001  a failed job must not end the loop
        return reply | {"error": {"code": APPLICATION, "message": f"{type(e).__name__}: {e}"[:2000]}}
    if as_text:
        return reply | {"result": render(request["method"], rows, **params)}
    return reply | {"result": [_plain(r.asDict(recursive=True)) for r in rows]}


def serve(session: GraphSession, lines: Iterable[str]) -> Iterator[str]:
    """A reply line for each request line that is not blank."""
    for line in lines:
        if line.strip():
            yield json.dumps(handle(session, line), default=str)
