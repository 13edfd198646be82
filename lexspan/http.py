"""The engine over HTTP, for programs on the same machine."""

from __future__ import annotations

import json
import threading
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine
from .functions.snippets import highlight
from .sources.render import render

LOOPBACK = ("127.0.0.1", "localhost", "[::1]", "::1")
READS = ("/status", "/progress", "/log", "/search", "/doc", "/tree", "/session", "/settings", "/preview")
WRITES = ("/sync", "/resync", "/cancel", "/session", "/settings")
MAX_BODY = 1 << 20


class Failure(Exception):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


def answer(engine: Engine, path: str, q: dict[str, str]) -> object:
    """The answer to a GET."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if path == "/status":
        return engine.status()
    if path == "/progress":
        return engine.progress
    if path == "/log":
        return rows(engine.log(int(q.get("limit", 50))))
    if path == "/search":
        if not q.get("q", "").strip():
            raise Failure(400, "q is missing")
        days = float(q["days"]) if q.get("days") else None
        return rows(engine.search(q["q"], int(q.get("limit", 10)), dir=q.get("dir"), ext=q.get("ext"), days=days))
    if path == "/doc":
        found = rows(engine.read(q.get("key", ""), int(q.get("offset", 0)), int(q.get("limit", 20_000))))
        if not found:
            raise Failure(404, "no such document")
        return found[0]
    if path == "/tree":
        folders, files = engine.list(q.get("dir", ""), int(q.get("depth", 1)), q.get("filter", ""))
        return {"dirs": rows(folders), "files": rows(files.select("rel", "name", "ext", "size", "chars", "status", "error", "kind", "text_source"))}
    if path == "/session":
        return {"enabled": engine.session(q.get("id", ""))}
    if path == "/preview":
        if not engine.inside_roots(q.get("path", "")):
            raise Failure(403, "not an indexed file under a root")
        row = engine.spark.read.format("binaryFile").load(q["path"]).select("content").first()
        terms = [t for t in q.get("q", "").split() if t]
        return {"html": render(bytes(row["content"]), "." + q["path"].rpartition(".")[2], terms), "title": highlight(q["path"].rpartition("/")[2], terms)}
    return {k: v for k, v in asdict(engine.settings).items() if k != "extra"}


def change(engine: Engine, path: str, body: dict) -> object:
    """The answer to a POST."""
    if path == "/session":
        return {"enabled": engine.session(str(body.get("id", "")), bool(body.get("enabled")))}
    if path == "/settings":
        engine.settings = engine.settings.updated(body)
        return answer(engine, "/settings", {})
    if path == "/cancel":
        engine.cancel()
        return engine.progress
    only = [str(x) for x in body.get("only", [])][:200] if path == "/resync" else None
    if engine.progress.get("phase") in ("scan", "extract"):
        raise Failure(409, "a sync is running")
    threading.Thread(target=engine.sync, args=(bool(body.get("full")), only), daemon=True).start()
    return {"started": True}


def serve(engine: Engine, port: int = 0) -> ThreadingHTTPServer:
    """A server on a loopback port (any free one for 0); serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _reply(self, code: int, data: object) -> None:
            raw = json.dumps(data, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _handle(self, known: tuple[str, ...], other: tuple[str, ...], make) -> None:
            url = urlsplit(self.path)
            try:
                if self.headers.get("Host", "").rsplit(":", 1)[0] not in LOOPBACK:
                    raise Failure(403, "only for this machine")
                if url.path not in known:
                    raise Failure(405 if url.path in other else 404, url.path)
                self._reply(200, make(url))
            except Failure as e:
                self._reply(e.code, {"error": str(e)})
            except (ValueError, KeyError) as e:
                self._reply(400, {"error": str(e)})

        def do_GET(self):
            self._handle(READS, WRITES, lambda url: answer(engine, url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}))

        def do_POST(self):
            def make(url):
                if self.headers.get("Content-Type", "").split(";")[0].strip() != "application/json":
                    raise Failure(415, "JSON is wanted")
                size = int(self.headers.get("Content-Length", 0))
                if size > MAX_BODY:
                    raise Failure(413, "too long")
                body = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(body, dict):
                    raise Failure(400, "an object is wanted")
                return change(engine, url.path, body)

            self._handle(WRITES, READS, make)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
