"""HTTP: the query engine behind a few JSON routes, by the standard library's server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .engine import QueryEngine

VERSION = "0.1"
#: Route -> (engine method, required fields, optional fields).
ROUTES = {
    "/v1/query/dsl": ("query_dsl", ("query",), ()),
    "/v1/query/semantic": ("query_semantic", ("query",), ("top_k",)),
    "/v1/query/hybrid": ("query_hybrid", ("query",), ("top_k",)),
    "/v1/query/nl": ("query_nl", ("question",), ()),
    "/v1/query/impact": ("query_impact", ("target",), ("depth",)),
    "/v1/query/path": ("query_path", ("src", "dst"), ("max_depth",)),
}


def answer(engine: QueryEngine, method: str, path: str, body: dict) -> tuple[int, dict]:
    """(status, JSON) of one request."""
    if method == "GET" and path == "/health":
        return 200, {"status": "ok", "version": VERSION}
    if method == "GET" and path == "/v1/info":
        return 200, {"version": VERSION, "repo_path": engine.config.repo_path, "node_count": engine.store.node_count(), "edge_count": engine.store.edge_count()}
    if method != "POST" or path not in ROUTES:
        return 404, {"detail": "not found"}
    name, required, optional = ROUTES[path]
    if missing := [f for f in required if f not in body]:
        return 422, {"detail": f"missing: {', '.join(missing)}"}
    result = getattr(engine, name)(*(body[f] for f in required), **{f: body[f] for f in optional if body.get(f) is not None})
    if result.error:
        return 422, {"detail": result.error}
    return 200, result.as_dict() | ({"context": result.context} if body.get("context", True) else {})


def serve(engine: QueryEngine, host: str = "127.0.0.1", port: int = 8000) -> None:
    make_server(engine, host, port).serve_forever()


def make_server(engine: QueryEngine, host: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                body = json.loads(raw) if raw else {}
                status, data = answer(engine, method, self.path, body)
            except (ValueError, TypeError) as e:
                status, data = 422, {"detail": str(e)}
            out = json.dumps(data).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
