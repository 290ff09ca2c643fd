import json
import threading
import urllib.error
import urllib.request

import pytest

from tessera.budget import BudgetPolicy
from tessera.gateway import Gateway, UploadSettings, make_server
from tessera.session import Engine, QueryService
from tessera.sources.catalog import Catalog


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("db")
    (top / "data").mkdir()
    (top / "data" / "People.csv").write_text("id,name\n1,alice\n2,bob\n3,carol\n")
    engine = Engine(spark, Catalog.from_directory(spark, str(top)))
    g = Gateway(QueryService(engine, BudgetPolicy(default_tuples=50, default_timeout_ms=30_000)), UploadSettings(True, 200, 3), str(tmp_path_factory.mktemp("up")))
    s = make_server(g, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", g
    s.shutdown()


def call(base, path, body=None, kind="application/json", method=None):
    data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
    r = urllib.request.Request(base + path, data, {"Content-Type": kind}, method=method)
    try:
        with urllib.request.urlopen(r) as x:
            return x.status, json.loads(x.read() or b"null"), dict(x.headers)
    except urllib.error.HTTPError as x:
        return x.code, json.loads(x.read()), dict(x.headers)


def tool(base, name_, **args):
    _, out, _ = call(base, "/mcp", {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name_, "arguments": args}})
    return out["result"]["isError"], out["result"]["content"][0]["text"]


def test_queries(server):
    base, _ = server
    status, out, _ = call(base, "/queries", {"sql": "SELECT * FROM People LIMIT 2"})
    assert status == 200 and out["rowCount"] == 2 and out["truncated"] and "hint" in out
    assert out["columns"] == [{"name": "id", "type": "INT"}, {"name": "name", "type": "STRING"}]
    assert "explain" in call(base, "/queries", {"sql": "EXPLAIN SELECT * FROM People"})[1]


@pytest.mark.parametrize("body,status,code", [
    ({"sql": "SELEKT"}, 400, "PARSE_ERROR"), ({"sql": "SELECT People.x FROM People"}, 422, "UNKNOWN_COLUMN"), ({"sql": "SELECT * FROM Nope"}, 422, "UNKNOWN_TABLE"),
    ({"sql": "SELECT * FROM People WHERE People.id = 'a'"}, 422, "TYPE_MISMATCH"), ({"sql": "SELECT COUNT(*) FROM People", "maxTuples": 1}, 429, "BUDGET_EXCEEDED"),
    ({"sql": "SELECT * FROM People", "maxTuples": 0}, 400, "BAD_REQUEST"), ({}, 400, "PARSE_ERROR"), (b"{", 400, "BAD_REQUEST"),
    ({"sql": 5}, 400, "BAD_REQUEST"), ({"sql": "SELECT * FROM People", "maxTuples": "9"}, 400, "BAD_REQUEST"), ({"sql": "SELECT * FROM People", "timeoutMs": 1.5}, 400, "BAD_REQUEST"),
])
def test_failures(server, body, status, code):
    got, out, headers = call(server[0], "/queries", body)
    assert (got, out["errorCode"]) == (status, code)
    assert (headers.get("Retry-After") == "1") == (status == 429)


def test_tables_and_media_type(server):
    base, _ = server
    assert "People" in call(base, "/tables")[1]
    assert call(base, "/tables/People")[1]["columns"][0] == {"name": "id", "type": "INT"}
    assert call(base, "/tables/Nope")[0] == 404
    assert call(base, "/queries", b"x", "text/plain")[0] == 415
    assert call(base, "/other")[0] == 404


def test_uploads(server):
    base, g = server
    up = lambda name, text: call(base, f"/tables/{name}", text.encode(), "text/csv")
    status, out, _ = up("Widgets", "sku,qty\na1,3\n")
    assert status == 201 and out["rowCount"] == 1
    assert call(base, "/queries", {"sql": "SELECT Widgets.qty FROM Widgets"})[1]["rows"] == [[3]]
    assert up("Widgets", "a\n1\n")[0] == 409
    assert up("bad-name", "a\n1\n")[0] == 400
    assert up("Ragged", "a,b\n1\n")[1]["errorCode"] == "DATA_ERROR"
    assert up("Large", "a\n" + "1\n" * 200)[0] == 413
    assert up("Third", "a\n1\n")[0] == 201
    assert up("Fourth", "a\n1\n")[0] == 507
    g2 = Gateway(g.service)
    with pytest.raises(Exception) as e:
        g2.upload("X", None, 1)
    assert e.value.status == 404


def test_mcp(server):
    base, _ = server
    rpc = lambda m, **p: call(base, "/mcp", {"jsonrpc": "2.0", "id": 1, "method": m, "params": p})[1]
    assert "tools" in rpc("initialize")["result"]["capabilities"]
    assert [t["name"] for t in rpc("tools/list")["result"]["tools"]] == ["list_tables", "describe_table", "sample_rows", "explain_query", "query"]
    assert rpc("nope")["error"]["code"] == -32601
    assert call(base, "/mcp", {"jsonrpc": "2.0", "method": "notifications/initialized"})[0] == 202
    assert "People" in json.loads(tool(base, "list_tables")[1])
    assert json.loads(tool(base, "describe_table", name="People")[1])["name"] == "People"
    assert json.loads(tool(base, "sample_rows", name="People", limit=0)[1])["rowCount"] == 1
    assert json.loads(tool(base, "sample_rows", name="People")[1])["rowCount"] == 3
    assert "Scan[People]" in json.loads(tool(base, "explain_query", sql="SELECT * FROM People")[1])["explain"]
    assert json.loads(tool(base, "query", sql="SELECT COUNT(*) FROM People")[1])["rows"] == [[3]]
    assert tool(base, "query", sql="SELECT * FROM Nope")[1].startswith("UNKNOWN_TABLE: ")
    assert tool(base, "sample_rows", name="People; DROP")[0]


def test_quoted_identifiers_through_both_surfaces(server):
    sql = 'SELECT "People"."name" FROM People WHERE "People"."id" = 2'
    assert call(server[0], "/queries", {"sql": sql})[1]["rows"] == [["bob"]]
    error, text = tool(server[0], "query", sql=sql)
    assert not error and json.loads(text)["rows"] == [["bob"]]


def raw_post(base, head, body):
    import socket

    host, port = base.removeprefix("http://").split(":")
    with socket.create_connection((host, int(port)), 30) as s:
        s.sendall(head.encode() + b"\r\n\r\n" + body)
        s.shutdown(socket.SHUT_WR)
        out = b""
        while data := s.recv(1 << 16):
            out += data
    return int(out.split(b" ")[1])


def test_bodies_that_break_off_make_no_table(server):
    g = Gateway(server[1].service, UploadSettings(True, 200, 50), server[1].work_dir)
    own = make_server(g, port=0)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{own.server_port}"
    head = "POST /tables/Short HTTP/1.1\r\nHost: x\r\nContent-Type: text/csv\r\nConnection: close\r\n"
    assert raw_post(base, head + "Content-Length: 50", b"a,b\n1,2\n") == 400
    assert raw_post(base, head + "Transfer-Encoding: chunked", b"8\r\na,b\n1,2\n\r\n") == 400
    assert raw_post(base, head.rstrip(), b"") == 411
    assert raw_post(base, head + "Transfer-Encoding: chunked", b"ff\r\n" + b"x" * 255 + b"\r\n0\r\n\r\n") == 413
    assert "Short" not in g.catalog
    assert raw_post(base, head.replace("Short", "Streamed") + "Transfer-Encoding: chunked", b"4\r\na,b\n\r\n4\r\n1,2\n\r\n0\r\n\r\n") == 201
    assert g.catalog.get("Streamed").row_count == 1
    own.shutdown()
