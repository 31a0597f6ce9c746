"""The service over HTTP (S24): JSON routes and a stream of events, on the standard library's server.

GET /api/health, /api/stats; POST /api/retrieve, /api/chat, /api/chat/stream. A request out of bounds gets 422, an unknown
route 404, a failure 500 with its detail.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quern.plans.service import Service

#: Fields of a request for an answer, and the arguments that they are.
_ANSWER = {"mode": "mode", "use_self_correct": "self_correct", "max_iterations": "most_turns"}


def _chat(service: Service, body: dict) -> dict:
    return service.answer(body.get("query", ""), **{own: body[name] for name, own in _ANSWER.items() if name in body})


def _retrieve(service: Service, body: dict) -> dict:
    query = body.get("query", "")
    return {"query": query, "query_type": "retrieve", "chunks": service.retrieve(query, int(body.get("top_k", 20)))}


def event(name: str, data: dict) -> bytes:
    return f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False, default=str)}\n\n".encode()


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    """A request handler class for that service."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, data: object) -> None:
            body = json.dumps(data, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _run(self, work: Callable[[], object]) -> None:
            try:
                status, data = 200, work()
            except (ValueError, TypeError) as e:
                status, data = 422, {"detail": str(e)}
            except Exception as e:  # the server goes on
                status, data = 500, {"detail": str(e)[:500]}
            self._send(status, data)

        def _stream(self, body: dict) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream; charset=utf-8")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            self.wfile.write(event("stage", {"name": "starting"}))
            self.wfile.flush()
            try:
                last = event("done", _chat(service, body))
            except Exception as e:  # told to the client, who has got a status already
                last = event("error", {"detail": str(e)[:500]})
            self.wfile.write(last)

        def do_GET(self) -> None:
            routes = {"/api/health": service.health, "/api/stats": service.stats}
            if self.path in routes:
                self._run(routes[self.path])
            else:
                self._send(404, {"detail": "not found"})

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError as e:
                body = str(e)
            if not isinstance(body, dict):
                self._send(422, {"detail": "the body is no JSON object"})
            elif self.path == "/api/retrieve":
                self._run(lambda: _retrieve(service, body))
            elif self.path == "/api/chat":
                self._run(lambda: _chat(service, body))
            elif self.path == "/api/chat/stream":
                self._stream(body)
            else:
                self._send(404, {"detail": "not found"})

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound to the port; ``serve_forever`` runs it."""
    return ThreadingHTTPServer((host, port), handler(service))
