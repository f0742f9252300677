"""The HTTP verbs: an envelope of success, data and error, and a status; as plain calls and over a socket."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote, urlsplit

from ..sources.store import Database
from ..types import CollectionExists, CollectionNotFound, MemError, NotFound


class Service:
    """``handle(method, path, body)`` -> (status, envelope)."""

    def __init__(self, database: Database):
        self.db = database

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict[str, Any]]:
        try:
            status, data = self._route(method.upper(), [unquote(x) for x in urlsplit(path).path.strip("/").split("/") if x], body or {})
            return status, {"success": True, "data": data, "error": None}
        except (CollectionNotFound, NotFound) as e:
            return 404, self._failed(e)
        except CollectionExists as e:
            return 409, self._failed(e)
        except (MemError, ValueError, TypeError, KeyError) as e:
            return 400, self._failed(e)
        except Exception as e:  # the envelope's last resort
            return 500, self._failed(e)

    @staticmethod
    def _failed(e: Exception) -> dict[str, Any]:
        return {"success": False, "data": None, "error": f"{type(e).__name__}: {e}"}

    def _route(self, method: str, parts: list[str], body: dict) -> tuple[int, Any]:
        match method, parts:
            case "GET", ["health"]:
                return 200, {"status": "ok"}
            case "GET", ["collections"]:
                return 200, [r.asDict() for r in self.db.listing().collect()]
            case "POST", ["collections"]:
                c = self.db.collection(body["name"], body["dimensions"], body.get("metric", "cosine"))
                return 201, {"name": c.name, "dimensions": c.dimensions, "metric": c.metric.value}
            case "GET", ["collections", name] | ["collections", name, "stats"]:
                return 200, self.db.get_collection(name).stats().first().asDict()
            case "DELETE", ["collections", name]:
                if not self.db.drop_collection(name):
                    raise CollectionNotFound(name)
                return 200, {"dropped": name}
            case "POST", ["collections", name, "records"] | ["collections", name, "add"]:
                return 201, {"id": self.db.get_collection(name).add_sync(body["vector"], body.get("metadata"), body.get("id"), body.get("ttl"))}
            case "POST", ["collections", name, "upsert"]:
                c = self.db.get_collection(name)
                c.upsert(body["id"], body["vector"], body.get("metadata"), body.get("ttl"))
                c.flush()
                return 200, {"id": body["id"]}
            case "POST", ["collections", name, "add_batch"] if "vectors" in body:
                ids = self.db.get_collection(name).add_batch(body["vectors"], body.get("metadatas"), body.get("ids"), body.get("ttls"))
                return 201, {"ids": ids}
            case "POST", ["collections", name, "batch" | "add_batch"]:
                r = body["records"]
                return 201, {"ids": self.db.get_collection(name).add_batch([x["vector"] for x in r], [x.get("metadata") for x in r], [x.get("id") for x in r], [x.get("ttl") for x in r])}
            case "PUT", ["collections", name, "records", i]:
                c = self.db.get_collection(name)
                c.upsert(i, body["vector"], body.get("metadata"), body.get("ttl"))
                c.flush()
                return 200, {"id": i}
            case "GET", ["collections", name, "records", i]:
                rows = self.db.get_collection(name).get_with_vector(i).collect()
                if not rows:
                    raise NotFound(i)
                return 200, rows[0].asDict()
            case "DELETE", ["collections", name, "records", i]:
                if not self.db.get_collection(name).delete(i):
                    raise NotFound(i)
                return 200, {"deleted": i}
            case "POST", ["collections", name, "search"]:
                return 200, [r.asDict() for r in self.db.get_collection(name).search(body["vector"], body.get("k", 10), body.get("filter")).collect()]
            case "POST", ["collections", name, "compact"]:
                return 200, self.db.get_collection(name).compact()
        raise NotFound("/".join(parts))


def server(database: Database, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server of the verbs at ``server_address``; ``serve_forever`` and ``shutdown`` start and stop it."""
    service = Service(database)

    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, envelope = service.handle(self.command, self.path, json.loads(raw) if raw else None)
            except json.JSONDecodeError as e:
                status, envelope = 400, Service._failed(e)
            out = json.dumps(envelope, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_PUT = do_DELETE = _run

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
