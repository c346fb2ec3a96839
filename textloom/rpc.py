"""JSON-RPC requests to the tools of a corpus, as plain functions: what a server would put behind an address."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from . import __version__, tools
from .corpus import Corpus
from .functions import net
from .operators.state import Lifetime


@dataclass
class Endpoint:
    """token and mode: who may call; origins: pages that may. Sessions are ids that initialize gave out, with when it did and when they
    were last seen; they end as in operators.state (most_s 0: by inactivity alone)."""

    corpus: Corpus
    token: str = ""
    mode: str = "auto"
    origins: tuple[str, ...] = ()
    idle_s: float = 24 * 3600
    most_s: float = 0
    sessions: dict[str, Lifetime] = field(default_factory=dict)

    def handle(self, body: str, headers: Mapping[str, str]) -> tuple[int, dict | None, dict[str, str]]:
        """(status, answer, headers of the answer); a notification has no answer."""
        given = {k.lower(): v for k, v in headers.items()}
        if not given.get("content-type", "").lower().startswith("application/json"):
            return 415, failure(None, -32600, "Content-Type must be application/json", "INVALID_FIELD"), {}
        if not net.bearer_allowed(given.get("authorization"), self.token, self.mode):
            return 401, failure(None, -32000, "missing or invalid bearer token", "UNAUTHORIZED"), {}
        if not net.origin_allowed(given.get("origin", ""), self.origins):
            return 403, failure(None, -32000, "origin not allowed", "FORBIDDEN_ORIGIN"), {}
        try:
            request = json.loads(body)
        except ValueError:
            return 400, failure(None, -32600, "the body isn't JSON", "INVALID_FIELD"), {}
        ident = request.get("id") if isinstance(request, dict) else None
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or isinstance(ident, (bool, dict, list)):
            return 400, failure(None, -32600, "not a request of version 2.0", "INVALID_FIELD"), {}
        method, named = request.get("method"), "id" in request and ident is not None
        if not isinstance(method, str) or not method:
            return 400, failure(ident, -32600, "method is required", "MISSING_FIELD"), {}
        if method != "initialize" and given.get("mcp-session-id", "").strip() not in self.live_sessions():
            return 404, failure(ident, -32001, "session not found", "SESSION_NOT_FOUND"), {}
        now = time.time_ns() // 1000
        if method == "initialize":
            session = uuid.uuid4().hex
            self.sessions[session] = Lifetime(now, now)
            about = {"serverInfo": {"name": "textloom", "version": __version__}, "capabilities": {"tools": {}}}
            return 200, success(ident, about), {"MCP-Session-Id": session}
        self.sessions[given["mcp-session-id"].strip()].seen(now)
        if not named:
            return 202, None, {}
        if method == "notifications/initialized":
            return 200, success(ident, {}), {}
        if method == "tools/list":
            return 200, success(ident, {"tools": [{"name": n, "inputSchema": tools.schema(n)} for n in sorted(tools.TOOLS)]}), {}
        if method == "tools/call":
            return 200, self.called(ident, request.get("params")), {}
        return 200, failure(ident, -32601, "method not found", "METHOD_NOT_FOUND"), {}

    def live_sessions(self) -> dict[str, Lifetime]:
        """The sessions, without those that are over."""
        now, gap, life = time.time_ns() // 1000, int(self.idle_s * 1e6), int(self.most_s * 1e6)
        self.sessions = {k: s for k, s in self.sessions.items() if now <= s.over(gap, life)[0]}
        return self.sessions

    def called(self, ident: Any, params: Any) -> dict:
        name = params.get("name") if isinstance(params, dict) else None
        arguments = (params.get("arguments") or {}) if isinstance(params, dict) else None
        if not isinstance(name, str) or not isinstance(arguments, dict):
            return failure(ident, -32602, "name and arguments are required", "INVALID_FIELD")
        out = tools.call(self.corpus, name, arguments)
        shown = json.dumps(out, default=str)
        return success(ident, {"content": [{"type": "text", "text": shown}], "structuredContent": out, "isError": "error" in out})


def success(ident: Any, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def failure(ident: Any, number: int, message: str, code: str, retryable: bool = False) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "error": {"code": number, "message": message, "data": {"code": code, "retryable": retryable}}}
