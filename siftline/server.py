"""Requests as JSON-RPC 2.0, one a line: the collection's operations as tools, codebases as resources."""

from __future__ import annotations

import json
from typing import IO, Any

from siftline.collection import Collection
from siftline.errors import SiftlineError

# Error codes.
PARSE, UNKNOWN, BAD_PARAMETERS, FAILED, NO_RESOURCE = -32700, -32601, -32602, -32000, -32001

_TEXT, _FLAG, _NUMBER = {"type": "string"}, {"type": "boolean"}, {"type": "number"}


class _Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _index(c: Collection, a: dict) -> Any:
    return c.index(a["path"], a.get("name"), a.get("model"), a.get("tags"), bool(a.get("force")))


def _search(c: Collection, a: dict) -> Any:
    return c.search(a["query"], a.get("codebase"), int(a.get("limit", 10)))


def _status(c: Collection, _: dict) -> Any:
    return [r.asDict() for r in c.status().collect()]  # one row a codebase


def _delete(c: Collection, a: dict) -> Any:
    return {"removed": c.delete(a["path"])}


# name: (what it does, its work, its arguments, those it needs)
TOOLS = {
    "codebase_index": ("Index a tree of files.", _index, {"path": _TEXT, "name": _TEXT, "model": _TEXT, "tags": _TEXT, "force": _FLAG}, ["path"]),
    "codebase_search": ("Find the chunks that answer a query.", _search, {"query": _TEXT, "codebase": _TEXT, "limit": _NUMBER}, ["query"]),
    "codebase_status": ("Say what is indexed.", _status, {}, []),
    "codebase_delete": ("Remove a codebase.", _delete, {"path": _TEXT}, ["path"]),
}


def _call(c: Collection, params: dict) -> dict:
    name, arguments = params.get("name"), params.get("arguments") or {}
    if not isinstance(name, str):
        raise _Refused(BAD_PARAMETERS, "which tool?")
    if name not in TOOLS:
        raise _Refused(UNKNOWN, f"no tool {name}")
    _, work, _, needs = TOOLS[name]
    missing = [k for k in needs if not isinstance(arguments.get(k), str)]
    if missing:
        raise _Refused(BAD_PARAMETERS, f"missing: {', '.join(missing)}")
    return {"content": [{"type": "text", "text": json.dumps(work(c, arguments))}]}


def _resources(c: Collection) -> list[dict]:
    return [{"uri": f"codebase://{r['codebase_id']}", "name": r["name"], "description": f"{r['files']} files, {r['chunks']} chunks", "mimeType": "application/json"} for r in _status(c, {})]


def _read(c: Collection, params: dict) -> dict:
    uri = params.get("uri")
    found = [r for r in _status(c, {}) if f"codebase://{r['codebase_id']}" == uri]
    if not found:
        raise _Refused(NO_RESOURCE, f"no resource {uri}")
    return {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(found[0])}]}


METHODS = {
    "initialize": lambda c, p: {"protocolVersion": p.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "siftline", "version": "0.2"}},
    "ping": lambda c, p: {},
    "tools/list": lambda c, p: {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": given, "required": needs}} for n, (d, _, given, needs) in TOOLS.items()]},
    "tools/call": _call,
    "resources/list": lambda c, p: {"resources": _resources(c)},
    "resources/read": _read,
}


def answer(c: Collection, line: str) -> dict | None:
    """The response to one request; None for a notification."""
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": None}
    try:
        request = json.loads(line)
    except ValueError:
        return reply | {"error": {"code": PARSE, "message": "no JSON"}}
    if not isinstance(request, dict):
        return reply | {"error": {"code": BAD_PARAMETERS, "message": "no request"}}
    reply["id"] = request.get("id")
    try:
        method, params = METHODS.get(request.get("method")), request.get("params") or {}
        if method is None:
            raise _Refused(UNKNOWN, f"no method {request.get('method')}")
        if not isinstance(params, dict):
            raise _Refused(BAD_PARAMETERS, "parameters have names")
        result = method(c, params)
    except _Refused as e:
        result, reply["error"] = None, {"code": e.code, "message": str(e)}
    except (SiftlineError, ValueError) as e:
        result, reply["error"] = None, {"code": FAILED, "message": f"{type(e).__name__}: {e}"}
    if "id" not in request:
        return None
    return reply if "error" in reply else reply | {"result": result}


def serve(c: Collection, source: IO[str], out: IO[str]) -> None:
    for line in source:
        if line.strip() and (reply := answer(c, line)) is not None:
            print(json.dumps(reply), file=out, flush=True)
