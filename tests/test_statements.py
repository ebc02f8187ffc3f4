"""Statements over HTTP against a server on this machine: pages, ranges, caps, other origins, failures and cancelling."""

import json
import re
import threading
import time
from datetime import date, datetime
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tallyforge.sources import connectors, statements

ROWS = [[str(i), f"name {i}", i / 2, i % 2 == 0, "2024-01-0%d" % (i % 9 + 1), f"{i}.25", None if i % 7 == 0 else "2024-01-01 10:00:0%d" % (i % 10)] for i in range(50)]
META = [("id", "Int64"), ("name", "Nullable(String)"), ("half", "double"), ("even", "boolean"), ("day", "date"), ("price", "decimal(10,2)"), ("at", "timestamp(3)")]


class Handler(BaseHTTPRequestHandler):
    seen: list = []
    polls: dict = {}

    def log_message(self, *_):
        pass

    def _send(self, x, status=200):
        raw = x if isinstance(x, bytes) else json.dumps(x).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def _rows(self, sql):
        rows = ROWS
        if m := re.search(r"id >= (\d+)", sql):
            rows = [r for r in rows if int(r[0]) >= int(m[1])]
        if m := re.search(r"id < (\d+)", sql):
            rows = [r for r in rows if int(r[0]) < int(m[1])]
        return [] if "LIMIT 0" in sql else rows

    def do_DELETE(self):
        Handler.seen.append(("DELETE", self.path, ""))
        self._send({})

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
        Handler.seen.append(("POST", self.path, body))
        here = f"http://127.0.0.1:{self.server.server_port}"
        meta = [{"name": n, "type": t} for n, t in META]
        if self.path.endswith("/cancel"):
            return self._send({})
        if "from broken" in body and "LIMIT 0" not in body:
            return self._send({"error": {"message": "no such table"}, "exception": "no such table"})
        if self.path.startswith("/api/v2/statements"):
            sql = json.loads(body)["statement"]
            kind = "schema" if "LIMIT 0" in sql else "never" if "from never" in sql else "large" if "from large" in sql else "good"
            Handler.polls[kind] = 0
            return self._send({"statementHandle": f"h-{kind}"}, 202)
        if self.path.startswith("/v1/statement"):
            if "LIMIT 0" in body:
                return self._send({"columns": meta, "data": []})
            place = "http://127.0.0.2:1/v1/statement/x/1" if "from elsewhere" in body else f"{here}/other/1" if "from sideways" in body else None
            if place:
                return self._send({"nextUri": place, "columns": meta, "data": ROWS[:1]})
            Handler.polls["paged"] = self._rows(body)
            return self._send({"nextUri": f"{here}/v1/statement/{'failing' if 'from failing' in body else 'large' if 'from large' in body else 'q'}/{re.sub(r'[^0-9]+', '-', body)}/0"})
        if "from large" in body and "LIMIT 0" not in body:
            return self._send(b'{"meta": [' + b" " * 300_000 + b"]}")
        if "from text" in body:
            return self._send(b"no json")
        return self._send({"meta": meta, "data": self._rows(body)})

    def do_GET(self):
        Handler.seen.append(("GET", self.path, ""))
        here = f"http://127.0.0.1:{self.server.server_port}"
        if m := re.fullmatch(r"/v1/statement/(\w+)/([\d-]+)/(\d+)", self.path):
            n = int(m[3])
            if m[1] == "failing" and n == 1:
                return self._send({"error": "down"}, 500)
            if m[1] == "large" and n == 1:
                return self._send(b" " * 300_000)
            page = {"columns": [{"name": a, "type": b} for a, b in META], "data": ROWS[10 * n : 10 * n + 10]}
            return self._send(page | ({"nextUri": f"{here}/v1/statement/{m[1]}/{m[2]}/{n + 1}"} if n < 4 else {}))
        m = re.fullmatch(r"/api/v2/statements/h-(\w+)(?:\?partition=(\d+))?", self.path)
        if m[2]:
            return self._send(b" " * 300_000 if m[1] == "large" else {"data": ROWS[25 * int(m[2]) :][:25]})
        Handler.polls[m[1]] = Handler.polls.get(m[1], 0) + 1
        if m[1] == "never" or Handler.polls[m[1]] < 3:
            return self._send({"statementHandle": f"h-{m[1]}"}, 202)
        row_type = [{"name": n, "type": "fixed" if n == "id" else t, "scale": 0} for n, t in META]
        self._send({"resultSetMetaData": {"rowType": row_type, "partitionInfo": [{"rowCount": 25}] * 2}, "data": []})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def want(i):
    return (i, f"name {i}", i / 2, i % 2 == 0, date(2024, 1, i % 9 + 1), Decimal(f"{i}.25"), None if i % 7 == 0 else datetime(2024, 1, 1, 10, 0, i % 10))


@pytest.mark.parametrize("kind", ["clickhouse", "trino", "snowflake"])
def test_all_rows_come_with_their_types(spark, url, kind):
    df = statements.statement(spark, kind, "select * from t;", url=url, database="shop.public", user="u", password="p")
    assert sorted(map(tuple, df.collect())) == [want(i) for i in range(50)]
    assert df.rdd.getNumPartitions() == (2 if kind == "snowflake" else 1)
    assert df.where("even").groupBy().count().first()[0] == 25


def test_ranges_are_read_side_by_side(spark, url):
    df = statements.statement(spark, "clickhouse", "select * from t", url=url, partitionColumn="id", lowerBound=0, upperBound=50, numPartitions=4)
    assert df.rdd.getNumPartitions() == 4 and sorted(r.id for r in df.collect()) == list(range(50))


@pytest.mark.parametrize(("kind", "sql", "says"), [
    ("clickhouse", "select * from large", "more than 200000 bytes"), ("trino", "select * from large", "more than 200000 bytes"), ("snowflake", "select * from large", "more than 200000 bytes"),
    ("trino", "select * from elsewhere", "outside of its statement"), ("trino", "select * from sideways", "outside of its statement"), ("trino", "select * from failing", "status 500"),
    ("clickhouse", "select * from broken", "no such table"), ("trino", "select * from broken", "no such table"), ("clickhouse", "select * from text", "no JSON"),
])
def test_bad_answers_fail_and_are_cancelled(spark, url, kind, sql, says):
    Handler.seen.clear()
    with pytest.raises(Exception, match=says):
        statements.statement(spark, kind, sql, url=url, mostBytes=200_000).collect()
    asked = [m for m, p, _ in Handler.seen if m == "DELETE" or p.endswith("/cancel")]
    if (kind, sql.split()[-1]) in {("trino", "large"), ("trino", "failing"), ("snowflake", "large")}:
        assert asked


def test_a_statement_that_never_ends_is_cancelled(spark, url):
    Handler.seen.clear()
    began = time.time()
    client = statements.Client(url, seconds=1.0)
    with pytest.raises(TimeoutError):
        statements.submit(client, "select * from never")
    assert time.time() - began < 5 and ("POST", "/api/v2/statements/h-never/cancel", "{}") in Handler.seen


def test_a_reader_that_stops_early_cancels(url):
    Handler.seen.clear()
    pages = statements.paged(statements.Client(url), "select * from t")
    assert len(next(pages)[1]) == 10
    pages.close()
    assert Handler.seen[-1][0] == "DELETE"


@pytest.mark.parametrize("sql", ["select 1; select 2", "drop table t", "select 1 settings max_threads = 1", "select 1 format CSV", "insert into t select 1", "with a as (select 1) insert into t select * from a", ""])
def test_only_one_reading_statement_goes_out(sql):
    with pytest.raises(ValueError):
        statements.read_only(sql)


def test_words_in_quotes_are_no_clauses():
    assert statements.read_only("select 'a; format', format(x) -- drop\nfrom t;") == "select 'a; format', format(x) -- drop\nfrom t"


def test_passwords_stay_on_safe_ways():
    with pytest.raises(ValueError):
        statements.Client("http://example.org", "u", "p")
    with pytest.raises(ValueError):
        statements.Client("ftp://127.0.0.1")
    assert statements.Client("https://example.org", "u", "p").origin == ("https", "example.org", 443)


def test_connections_ask_statements(spark, url):
    held = connectors.Connections(spark)
    held.create("c", "clickhouse", url=url, database="shop")
    assert held.statement("c", "select * from t").count() == 50
    with pytest.raises(NotImplementedError):
        held.create("d", "duckdb", database="x") or held.statement("d", "select 1")
