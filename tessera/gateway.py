"""HTTP and MCP (JSON-RPC) gateways over one QueryService, with the standard library only."""

from __future__ import annotations

import json
import logging
import os
import re
import tempfile
import threading
import uuid
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from tessera.errors import BudgetExceeded, BudgetKind, ErrorCode, QueryError
from tessera.session import Answer, Busy, QueryService

log = logging.getLogger(__name__)
NAME = re.compile(r"[A-Za-z0-9_]{1,64}")
SAMPLE_DEFAULT, SAMPLE_MOST = 10, 1000
CEILING_BYTES = 50 << 20
JSON_BYTES = 1 << 20
MCP_PRINCIPAL = "mcp"
PROTOCOL = "2025-03-26"


@dataclass(frozen=True)
class UploadSettings:
    enabled: bool = False
    max_bytes: int = 10 << 20
    max_tables: int = 100


class Failure(Exception):
    def __init__(self, status: int, code: str, message: str, headers: dict[str, str] | None = None):
        super().__init__(message)
        self.status, self.code, self.headers = status, code, headers or {}


def failure_of(ex: Exception) -> Failure:
    """Every failure as a status, a code and a message; internals are logged under an id and kept out of it."""
    if isinstance(ex, Failure):
        return ex
    if isinstance(ex, Busy):
        return Failure(429, "CONCURRENCY_LIMIT", str(ex), {"Retry-After": "1"})
    if isinstance(ex, BudgetExceeded):
        return Failure(504, ex.code.value, str(ex)) if ex.kind is BudgetKind.TIME else Failure(429, ex.code.value, str(ex), {"Retry-After": "1"})
    if isinstance(ex, QueryError) and ex.code is ErrorCode.PARSE_ERROR:
        return Failure(400, ex.code.value, str(ex))
    if isinstance(ex, QueryError) and ex.code not in (ErrorCode.DATA_ERROR, ErrorCode.INTERNAL):
        return Failure(422, ex.code.value, str(ex))
    if isinstance(ex, ValueError):
        return Failure(400, "BAD_REQUEST", str(ex))
    error_id = str(uuid.uuid4())
    log.error("errorId=%s", error_id, exc_info=ex)
    out = Failure(500, ex.code.value if isinstance(ex, QueryError) else "INTERNAL", "Internal server error.")
    out.error_id = error_id
    return out


def check_name(name: str) -> str:
    if not NAME.fullmatch(name or ""):
        raise ValueError("Table name must match [A-Za-z0-9_]{1,64}.")
    return name


def plain(value):
    return value if value is None or isinstance(value, (int, float, str, bool)) else str(value)


def answer_json(a: Answer) -> dict:
    if a.explain is not None:
        return {"explain": a.explain}
    r = a.result
    columns = [{k: v for k, v in (("name", c.name), ("qualifiedName", c.qualified_name), ("type", c.type)) if v is not None} for c in r.columns]
    out = {"columns": columns, "rows": [[plain(v) for v in row] for row in r.rows], "rowCount": len(r.rows), "truncated": r.truncated}
    return out | ({"hint": r.hint} if r.hint else {})


class Chunked:
    """A body in chunked transfer coding, as a stream; one that breaks off is an error, not an end."""

    def __init__(self, raw):
        self.raw, self.left, self.over = raw, 0, False

    def read(self, n: int) -> bytes:
        if not self.left and not self.over:
            try:
                self.left = int(self.raw.readline(1 << 10).split(b";")[0].strip(), 16)
            except ValueError as ex:
                raise Failure(400, "BAD_REQUEST", "Malformed chunked body.") from ex
            if not self.left:
                self.over = True
                while self.raw.readline(1 << 10).strip():  # trailers
                    pass
        if self.over:
            return b""
        data = self.raw.read(min(n, self.left))
        if not data:
            raise Failure(400, "BAD_REQUEST", "The chunked body broke off.")
        self.left -= len(data)
        if not self.left:
            self.raw.readline(8)
        return data


class Gateway:
    """The operations both surfaces share."""

    def __init__(self, service: QueryService, uploads: UploadSettings = UploadSettings(), work_dir: str | None = None):
        self.service, self.uploads = service, uploads
        self.catalog = service.engine.catalog
        self.work_dir = work_dir or tempfile.mkdtemp(prefix="tessera-uploads-")
        self._upload = threading.Lock()

    def schema(self, name: str) -> dict:
        t = self.catalog.get(name)
        return {"name": name, "columns": [{"name": c, "type": k} for c, k in zip(t.columns, t.types, strict=True)]}

    def upload(self, name: str, body, length: int | None) -> dict:
        """``body`` is read to its end, or to ``length`` bytes where that is known; a shorter one is refused."""
        if not self.uploads.enabled:
            raise Failure(404, "NOT_FOUND", "Uploads are disabled.")
        check_name(name)
        cap = min(self.uploads.max_bytes, CEILING_BYTES)
        if length is not None and length > cap:
            raise Failure(413, "PAYLOAD_TOO_LARGE", f"Upload exceeds {cap} bytes.")
        with self._upload:
            if len(self.catalog) >= self.uploads.max_tables:
                raise Failure(507, "TABLE_LIMIT", f"The limit of {self.uploads.max_tables} tables is reached.")
            if name in self.catalog:
                raise Failure(409, "TABLE_EXISTS", f"Table '{name}' already exists.")
            path = os.path.join(self.work_dir, f"{name}-{uuid.uuid4().hex}.csv")
            done = False
            try:
                size = 0
                with open(path, "wb") as f:
                    while data := body.read(1 << 16 if length is None else min(length - size, 1 << 16)):
                        size += len(data)
                        if size > cap:
                            raise Failure(413, "PAYLOAD_TOO_LARGE", f"Upload exceeds {cap} bytes.")
                        f.write(data)
                if length is not None and size < length:
                    raise Failure(400, "BAD_REQUEST", f"The body ended after {size} of {length} bytes.")
                try:
                    done = self.catalog.register_csv(name, path)
                except QueryError as ex:
                    raise Failure(400, "DATA_ERROR", str(ex)) from ex
                if not done:
                    raise Failure(409, "TABLE_EXISTS", f"Table '{name}' already exists.")
            finally:
                if not done and os.path.exists(path):
                    os.unlink(path)
        return self.schema(name) | {"rowCount": self.catalog.get(name).row_count}

    def sample(self, name: str, limit: int | None) -> Answer:
        check_name(name)  # the name is the only part of the text that a caller supplies
        n = min(max(1, SAMPLE_DEFAULT if limit is None else int(limit)), SAMPLE_MOST)
        return self.service.execute(f"SELECT * FROM {name} LIMIT {n}", principal=MCP_PRINCIPAL)


# --- MCP -------------------------------------------------------------------------------------------------------------

_STR, _INT = {"type": "string"}, {"type": "integer"}
TOOLS = {
    "list_tables": ("List all tables that can be queried, sorted by name.", {}, []),
    "describe_table": ("Columns and types of one table.", {"name": _STR}, ["name"]),
    "sample_rows": ("Preview up to limit rows (1-1000, default 10) of a table.", {"name": _STR, "limit": _INT}, ["name"]),
    "explain_query": ("The plan of a read-only SELECT, without running it.", {"sql": _STR}, ["sql"]),
    "query": ("Run a read-only SELECT under a row and time budget.", {"sql": _STR, "maxTuples": _INT, "timeoutMs": _INT}, ["sql"]),
}


def _text(args: dict, name: str) -> str:
    if not isinstance(value := args.get(name, ""), str):
        raise ValueError(f"{name} must be a string.")
    return value


def call_tool(g: Gateway, name: str, args: dict) -> dict:
    """A tool's result, or its error as text: CODE: message."""
    try:
        if name == "list_tables":
            out = g.catalog.names()
        elif name == "describe_table":
            out = g.schema(check_name(args.get("name", "")))
        elif name == "sample_rows":
            out = answer_json(g.sample(args.get("name", ""), args.get("limit")))
        elif name == "explain_query":
            out = answer_json(g.service.execute(f"EXPLAIN {_text(args, 'sql')}", principal=MCP_PRINCIPAL))
        elif name == "query":
            out = answer_json(g.service.execute(_text(args, "sql"), args.get("maxTuples"), args.get("timeoutMs"), MCP_PRINCIPAL))
        else:
            raise ValueError(f"Unknown tool '{name}'.")
        return {"content": [{"type": "text", "text": json.dumps(out)}], "isError": False}
    except Exception as ex:
        f = failure_of(ex)
        code = f"{f.code} (timeout)" if f.status == 504 else f.code
        return {"content": [{"type": "text", "text": f"{code}: {f}"}], "isError": True}


def rpc(g: Gateway, message: dict) -> dict | None:
    method, params, id_ = message.get("method"), message.get("params") or {}, message.get("id")
    if id_ is None:
        return None  # a notification
    reply = lambda **x: {"jsonrpc": "2.0", "id": id_, **x}
    if method == "initialize":
        return reply(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1.0"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]})
    if method == "tools/call":
        return reply(result=call_tool(g, params.get("name", ""), params.get("arguments") or {}))
    return reply(error={"code": -32601, "message": "Method not found"})


# --- HTTP ------------------------------------------------------------------------------------------------------------


def make_server(g: Gateway, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            log.debug(*args)

        def _send(self, status: int, body: object, headers: dict[str, str] | None = None) -> None:
            data = json.dumps(body).encode() if body is not None else b""
            self.send_response(status)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(data)), **(headers or {})}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def _json(self) -> dict:
            if "json" not in (self.headers.get("Content-Type") or ""):
                raise Failure(415, "UNSUPPORTED_MEDIA_TYPE", "Send application/json.")
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > JSON_BYTES:
                    raise Failure(413, "PAYLOAD_TOO_LARGE", f"Request body exceeds {JSON_BYTES} bytes.")
                out = json.loads(self.rfile.read(size))
            except ValueError as ex:
                raise Failure(400, "BAD_REQUEST", "Malformed or missing request body.") from ex
            if not isinstance(out, dict):
                raise Failure(400, "BAD_REQUEST", "Malformed or missing request body.")
            return out

        def _run(self, work) -> None:
            try:
                self._send(*work())
            except Exception as ex:
                f = failure_of(ex)
                body = {"errorCode": f.code, "message": str(f)} | ({"errorId": f.error_id} if hasattr(f, "error_id") else {})
                self.close_connection = True
                self._send(f.status, body, f.headers)

        def _path(self) -> list[str]:
            return [unquote(x) for x in urlsplit(self.path).path.strip("/").split("/")]

        def do_GET(self) -> None:
            def work():
                match self._path():
                    case ["tables"]:
                        return 200, g.catalog.names()
                    case ["tables", name]:
                        if name not in g.catalog:
                            raise Failure(404, "UNKNOWN_TABLE", f"Table '{name}' not found.")
                        return 200, g.schema(name)
                raise Failure(404, "NOT_FOUND", "No such resource.")

            self._run(work)

        def do_POST(self) -> None:
            def work():
                match self._path():
                    case ["queries"]:
                        b = self._json()
                        if not isinstance(b.get("sql"), str | None):
                            raise Failure(400, "BAD_REQUEST", "sql must be a string.")
                        a = g.service.execute(b.get("sql"), b.get("maxTuples"), b.get("timeoutMs"), self.headers.get("X-Api-Key") or "anonymous")
                        return 200, answer_json(a)
                    case ["tables", name]:
                        if not g.uploads.enabled:
                            raise Failure(404, "NOT_FOUND", "Uploads are disabled.")
                        if "text/csv" not in (self.headers.get("Content-Type") or ""):
                            raise Failure(415, "UNSUPPORTED_MEDIA_TYPE", "Send text/csv.")
                        n = self.headers.get("Content-Length")
                        if "chunked" in (self.headers.get("Transfer-Encoding") or "").lower():
                            return 201, g.upload(name, Chunked(self.rfile), None)
                        if n is None:
                            raise Failure(411, "LENGTH_REQUIRED", "Send Content-Length or a chunked body.")
                        return 201, g.upload(name, self.rfile, int(n))
                    case ["mcp"]:
                        out = rpc(g, self._json())
                        return (202, None) if out is None else (200, out)
                raise Failure(404, "NOT_FOUND", "No such resource.")

            self._run(work)

    return ThreadingHTTPServer((host, port), Handler)


