"""Four tools over lines of JSON-RPC on standard input and output: search, record_source_use, record_outcome and
write_judgment. Arguments are checked strictly; errors carry the engine's codes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from .engine import OUTCOMES, STAGES, Engine, EngineError

TEXT = {"type": "string", "minLength": 1}
RELATION = {"type": "array", "items": TEXT, "minItems": 2, "maxItems": 2}
EVENT = {"type": "array", "prefixItems": [TEXT, {"enum": list(STAGES)}], "minItems": 2, "maxItems": 2}
#: name: argument: (required, schema); names and limits are fixed values.
TOOLS = {
    "search": {"query": (True, TEXT | {"maxLength": 8192}), "limit": (False, {"type": "integer", "minimum": 1, "maximum": 100})},
    "record_source_use": {"idempotency_key": (True, TEXT), "trace_id": (True, TEXT), "events": (True, {"type": "array", "items": EVENT, "minItems": 1, "maxItems": 100})},
    "record_outcome": {"idempotency_key": (True, TEXT), "trace_id": (True, TEXT), "used_node_ids": (True, {"type": "array", "items": TEXT, "minItems": 1, "maxItems": 100}), "status": (True, {"enum": list(OUTCOMES)}), "summary": (False, {"type": "string", "maxLength": 2000})},
    "write_judgment": {"judgment_id": (True, TEXT), "action": (True, {"enum": ["add", "update", "supersede", "archive", "restore", "delete"]}), "statement": (False, {"type": "string"}), "rationale": (False, {"type": "string"}), "expected_revision": (False, {"type": "integer", "minimum": 1}), "relations": (False, {"type": "array", "items": RELATION, "maxItems": 100}), "successor_id": (False, TEXT), "provenance": (False, {"type": "array", "items": RELATION, "minItems": 1, "maxItems": 100})},
}
KINDS = {"string": str, "integer": int, "array": list}


def schema(tool: str) -> dict:
    spec = TOOLS[tool]
    return {"type": "object", "properties": {k: s for k, (_, s) in spec.items()}, "required": [k for k, (r, _) in spec.items() if r], "additionalProperties": False}


def checked(value: object, rule: dict, name: str) -> None:
    def need(ok: bool) -> None:
        if not ok:
            raise EngineError("invalid_argument", name)

    if "enum" in rule:
        return need(value in rule["enum"])
    need(isinstance(value, KINDS[rule["type"]]) and not isinstance(value, bool))
    if rule["type"] == "integer":
        return need(rule.get("minimum", value) <= value <= rule.get("maximum", value))
    low, high = ("minLength", "maxLength") if rule["type"] == "string" else ("minItems", "maxItems")
    need(rule.get(low, 0) <= len(value) <= rule.get(high, len(value)))
    for i, x in enumerate(value if rule["type"] == "array" else ()):
        checked(x, rule["prefixItems"][i] if "prefixItems" in rule else rule["items"], f"{name}[{i}]")


def call(engine: Engine, tool: str, given: dict) -> dict:
    if tool not in TOOLS or not isinstance(given, dict) or set(given) - set(TOOLS[tool]):
        raise EngineError("invalid_argument", f"{tool}: unknown tool or argument")
    for name, (required, rule) in TOOLS[tool].items():
        if name in given:
            checked(given[name], rule, name)
        elif required:
            raise EngineError("invalid_argument", f"{name} is missing")
    if tool == "search":
        found = {"combined": engine.search(given["query"], given.get("limit", 10))} if engine.config.surface == "combined" else engine.search_channels(given["query"], given.get("limit", 10))
        return {lane: {"trace_id": t.trace_id, "hits": [{"node_id": h.node_id, "rank": h.rank, "score": h.score, "paths": [p.asDict(True) for p in h.paths or ()]} for h in t.hits]} for lane, t in found.items()}
    if tool == "record_source_use":
        return engine.record_source_use(given["idempotency_key"], given["trace_id"], [tuple(e) for e in given["events"]])
    if tool == "record_outcome":
        return engine.record_outcome(given["idempotency_key"], given["trace_id"], given["used_node_ids"], given["status"], given.get("summary", ""))
    row = engine.write_judgment(given["judgment_id"], given["action"], given.get("statement", ""), given.get("rationale", ""), given.get("expected_revision"), [tuple(r) for r in given.get("relations", ())], dict(map(tuple, given.get("provenance", ()))) or None, given.get("successor_id"))
    return {"judgment": None if row is None else row.asDict()}


def served(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """An answer for each request; notifications get none."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            method, name = request["method"], request.get("id")
        except (ValueError, KeyError, TypeError):
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no request"}})
            continue
        if name is None:
            continue
        answer: dict = {"jsonrpc": "2.0", "id": name}
        if method == "initialize":
            answer["result"] = {"protocolVersion": "2025-06-18", "capabilities": {"tools": {}}, "serverInfo": {"name": "arborix", "version": "1"}}
        elif method == "tools/list":
            answer["result"] = {"tools": [{"name": t, "inputSchema": schema(t)} for t in TOOLS]}
        elif method == "tools/call":
            params = request.get("params") or {}
            try:
                body, failed = call(engine, params.get("name", ""), params.get("arguments") or {}), False
            except EngineError as e:
                body, failed = {"code": e.code, "message": str(e)}, True
            except Exception:  # noqa: BLE001 - a caller sees a code, never a trace of the stack
                body, failed = {"code": "internal_error", "message": "the request failed"}, True
            answer["result"] = {"content": [{"type": "text", "text": json.dumps(body)}], "structuredContent": body, "isError": failed}
        else:
            answer["error"] = {"code": -32601, "message": "unknown method"}
        yield json.dumps(answer)
