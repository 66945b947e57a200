"""The engine over HTTP and as tools: a thin layer, all work is the engine's.

HTTP: POST /recall, POST /events, GET /health, and pages to browse and review. Pages that change
something answer 403 unless PALIMPSEST_WRITES is 1. Tools: JSON-RPC lines over standard input.
"""

from __future__ import annotations

import html
import json
import os
import sys
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import history, recall, sessions, stats
from .service import Engine

#: A page shows at most so many rows.
PAGE = 200
TOOLS = {
    "search_memory": ({"query": "string", "project": "string", "limit": "integer"}, ["query"]),
    "get_project_context": ({"project": "string"}, []),
    "record_event": ({"client": "string", "payload": "object"}, ["payload"]),
    "propose_memory": ({"path": "string", "content": "string"}, ["path", "content"]),
}


def _rows(df: DataFrame, most: int = PAGE) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


class Api:
    def __init__(self, engine: Engine):
        self.engine, self.lock = engine, threading.Lock()  # the store has one writer

    # --- requests ---

    def recall(self, body: dict) -> dict:
        with self.lock:
            hits = self.engine.recall(str(body.get("prompt") or body.get("query") or ""), body.get("project"), int(body.get("limit") or recall.HITS))
        return {"text": recall.render_prompt(hits)[0], "memories": [{"path": h["path"], "score": h["score"]} for h in hits]}

    def record(self, body: dict) -> dict:
        with self.lock:
            return self.engine.record(body.get("payload", body), str(body.get("client") or "unknown"))

    def health(self) -> dict:
        m = self.engine.store.read("memory")
        return {"ok": True, "active": m.where(recall.live()).count(), "events": self.engine.store.read("event").count()}

    def call(self, tool: str, args: dict) -> object:
        missing = [k for k in TOOLS[tool][1] if k not in args]
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")
        if tool == "search_memory":
            return self.recall(args)
        if tool == "get_project_context":
            return {"text": self.engine.project_context(args.get("project"))[0]}
        if tool == "record_event":
            return self.record(args)
        with self.lock:
            return self.engine.propose(args["path"], args["content"])

    # --- pages ---

    def pages(self) -> dict[str, Callable[[str, dict], object]]:
        read = self.engine.store.read
        memory = lambda: read("memory").select("path", "project", "status", "archived", "updated_at")
        return {
            "": lambda _, q: _rows(stats.everything(read("memory"), read("session"), read("event"))),
            "memories": lambda _, q: _rows(memory().orderBy(F.desc_nulls_last("updated_at"), "path")),
            "memory": lambda path, q: _rows(read("memory").where(F.col("path") == path).drop("embedding").join(read("memory_session").groupBy("path").agg(F.sort_array(F.collect_set("session_key")).alias("sessions")), "path", "left")),
            "history": lambda path, q: _rows(self.engine.versions().where(F.col("path") == path)),
            "diff": lambda path, q: _rows(history.diffs(self.engine.versions().where(F.col("path") == path))),
            "sessions": lambda _, q: _rows(sessions.with_counts(read("session"), read("event")).orderBy(F.desc_nulls_last("created_at"), "session_key")),
            "session": lambda key, q: _rows(sessions.walk(read("event"), key)),
            "search": lambda _, q: self.recall({"query": q.get("q", "")})["memories"],
            "review": lambda _, q: _rows(history.pending(read("memory")).select("path", "created_by", "updated_at")),
            "stats": lambda _, q: _rows(stats.by_kind(read("memory"))) + _rows(stats.by_client(read("event"))),
        }

    def writes(self) -> dict[str, Callable[[str, dict], object]]:
        e = self.engine
        return {
            "edit": lambda path, b: e.edit(path, b["content"]),
            "delete": lambda path, b: e.delete(path),
            "archive": lambda path, b: e.set_archived([path], str(b.get("on", "1")) == "1"),
            "approve": lambda path, b: e.transition("approve", path),
            "reject": lambda path, b: e.transition("reject", path),
            "supersede": lambda path, b: e.supersede(path, b["loser"]),
        }

    def get(self, url: str) -> tuple[int, str, str]:
        """(status, type, body) of a GET."""
        at = urlsplit(url)
        name, _, rest = unquote(at.path.strip("/")).partition("/")
        if name == "health":
            return 200, "application/json", json.dumps(self.health())
        if name not in self.pages():
            return 404, "text/plain", "not found"
        rows = self.pages()[name](rest, {k: v[0] for k, v in parse_qs(at.query).items()})
        if name in ("memory", "session") and not rows:
            return 404, "text/plain", "not found"
        return 200, "text/html; charset=utf-8", page(name or "overview", rows)

    def post(self, url: str, body: dict) -> tuple[int, str, str]:
        name, _, rest = unquote(urlsplit(url).path.strip("/")).partition("/")
        try:
            if name == "recall":
                return 200, "application/json", json.dumps(self.recall(body), default=str)
            if name == "events":
                return 200, "application/json", json.dumps(self.record(body))
            if name in self.writes():
                if os.environ.get("PALIMPSEST_WRITES") != "1":
                    return 403, "text/plain", "read-only"
                with self.lock:
                    return 200, "application/json", json.dumps({"result": self.writes()[name](rest, body)})
        except (KeyError, ValueError, TypeError) as e:
            return 400, "application/json", json.dumps({"error": str(e)})
        return 404, "text/plain", "not found"

    # --- JSON-RPC ---

    def answer(self, request: dict) -> dict | None:
        """The reply to a JSON-RPC request; None for a notification."""
        if "id" not in request:
            return None
        reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "palimpsest", "version": "1"}}}
        if method == "tools/list":
            listed = [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in fields.items()}, "required": needed}} for n, (fields, needed) in TOOLS.items()]
            return reply | {"result": {"tools": listed}}
        if method == "tools/call" and params.get("name") in TOOLS:
            try:
                out, bad = self.call(params["name"], params.get("arguments") or {}), False
            except ValueError as e:
                out, bad = {"error": str(e)}, True
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(out, default=str, ensure_ascii=False)}], "isError": bad}}
        return reply | {"error": {"code": -32601, "message": f"unknown: {method}"}}


def page(title: str, rows: list[dict]) -> str:
    columns = list(dict.fromkeys(k for r in rows for k in r))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td><pre>{html.escape(str('' if r.get(c) is None else r[c]))}</pre></td>" for c in columns) + "</tr>" for r in rows)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def server(api: Api, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, not started yet; by default for this machine only."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            self._send(*api.get(self.path))

        def do_POST(self):  # noqa: N802
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw or b"{}")
            except ValueError:
                body = None
            self._send(*(api.post(self.path, body) if isinstance(body, dict) else (400, "application/json", '{"error": "not a JSON object"}')))

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve_tools(api: Api, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            try:
                reply = api.answer(json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()
