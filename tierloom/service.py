"""A small HTTP service: POST /audit, GET /search, GET /replay/{trace_id}, in JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from tierloom.errors import TierError
from tierloom.plans.audit import run_audit
from tierloom.plans.store import Store


class Refused(Exception):
    def __init__(self, code: int, why: str):
        super().__init__(why)
        self.code = code


def answer(spark: SparkSession, store: str, root: str, method: str, url: str, body: bytes = b"") -> dict:
    """What a request gets. ``root``: the folder below which corpora may be audited."""
    parts = urlsplit(url)
    asked = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    if (method, parts.path) == ("POST", "/audit"):
        try:
            path = json.loads(body)["path"]
            at = (Path(root) / path).resolve()
        except (ValueError, KeyError, TypeError) as e:
            raise Refused(400, "the body must be an object with a path") from e
        if not at.is_relative_to(Path(root).resolve()):
            raise Refused(400, "the path leaves the folder of corpora")
        if not at.exists():
            raise Refused(404, "no such corpus")
        return run_audit(spark, str(at), store + "-audit").to_dict()
    if (method, parts.path) == ("GET", "/search"):
        try:
            k, query = int(asked.get("k", 10)), asked["q"]
        except (KeyError, ValueError) as e:
            raise Refused(400, "q, and k as a whole number, are needed") from e
        with Store(spark, store, create=False) as s:
            return {"found": [r.asDict() for r in s.search_cli(query, k, asked.get("tier")).orderBy("query", "rank").collect()]}
    if method == "GET" and parts.path.startswith("/replay/"):
        with Store(spark, store, create=False) as s:
            lines = s.replay_raw(unquote(parts.path.removeprefix("/replay/")))
        return {"lines": [x.decode("utf-8", "replace") for x in lines]}
    raise Refused(404, "no such resource")


def serve(spark: SparkSession, store: str, root: str, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """The server, which the caller runs by ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            try:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                code, out = 200, answer(spark, store, root, self.command, self.path, body)
            except Refused as e:
                code, out = e.code, {"error": str(e)}
            except TierError as e:
                code, out = (404 if "unknown trace" in str(e) or "no store" in str(e) else 400), {"error": str(e)}
            except Exception as e:  # noqa: BLE001 - the server goes on
                code, out = 500, {"error": type(e).__name__}
            data = json.dumps(out, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
