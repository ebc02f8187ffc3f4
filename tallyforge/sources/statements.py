"""Statements run by a database's HTTP interface, as a Spark data source in Python.

Three protocols are known: ``whole`` answers a statement with one JSON document of columns and
rows, ``paged`` with a chain of pages, each naming the next, ``submitted`` takes a statement,
is asked until it is done and then serves numbered pages. Numbered pages are partitions of
their own; the other two are read side by side by ranges of a column, as by JDBC.

Every response is read up to a cap and no further. A page that names a place on another origin
is refused. A statement that is given up, by an error or because Spark stops reading, is
cancelled at its server. Passwords are only sent encrypted or to this machine itself.
"""

from __future__ import annotations

import base64
import contextlib
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The most bytes of a response, and the local hosts to which plain HTTP with a password may go.
MOST_BYTES = 8 * 1024 * 1024
LOCAL = ("127.0.0.1", "::1", "localhost")
#: The protocol of each kind of source.
PROTOCOLS = {"clickhouse": "whole", "trino": "paged", "snowflake": "submitted"}


class StatementError(RuntimeError):
    """The server refused or failed a statement, or its answer is not what the protocol says."""


class ResponseTooLarge(StatementError):
    """A response is over the cap."""


_QUIET = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)


def read_only(sql: str) -> str:
    """The text without a final semicolon, if it is one SELECT that leaves settings and formats to the source."""
    plain = _QUIET.sub(" ", sql).strip().rstrip(";").strip()
    if ";" in plain or not re.match(r"(?i)(select|with)\b", plain):
        raise ValueError("one SELECT statement is asked for")
    if found := re.search(r"(?i)\b(settings|format|insert|update|delete|merge|create|drop|alter|into\s+outfile)\b(?!\s*\()", plain):
        raise ValueError(f"{found[1].upper()} is not left to a statement")
    return sql.strip().rstrip(";").strip()


def spark_type(name: str, scale: int | None = None) -> T.DataType:
    """The Spark type of a column type as the databases write it; text where there is none."""
    low = name.lower().strip()
    if m := re.fullmatch(r"(?:nullable|lowcardinality)\((.*)\)", low):
        return spark_type(m[1])
    if m := re.fullmatch(r"(?:decimal|numeric)\((\d+),\s*(\d+)\)", low):
        return T.DecimalType(int(m[1]), int(m[2]))
    if low == "fixed":
        return T.DecimalType(38, scale) if scale else T.LongType()
    for kind, pattern in (
        (T.BooleanType(), r"bool(ean)?"), (T.LongType(), r"u?int(8|16|32|64)|tinyint|smallint|integer|bigint|int"), (T.DoubleType(), r"float(32|64)?|double|real"),
        (T.DateType(), r"date(32)?"), (T.TimestampNTZType(), r"(datetime|timestamp)(64)?(_ntz)?(\(.*\))?"),
    ):
        if re.fullmatch(pattern, low):
            return kind
    return T.StringType()


def spark_value(x: object, kind: T.DataType) -> object:
    """A JSON value as one of a Spark type; numbers may come as text."""
    if x is None:
        return None
    if isinstance(kind, T.BooleanType):
        return x if isinstance(x, bool) else str(x).lower() in ("true", "1")
    if isinstance(kind, T.LongType):
        return int(x)
    if isinstance(kind, T.DoubleType):
        return float(x)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(x)).quantize(Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, T.DateType):
        return date.fromisoformat(str(x))
    if isinstance(kind, T.TimestampNTZType):
        return datetime.fromisoformat(str(x).replace(" ", "T", 1))
    return x if isinstance(x, str) else json.dumps(x)


class _Elsewhere(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:
        raise StatementError("the server sends requests elsewhere")


@dataclass
class Client:
    """Requests to one origin."""

    url: str
    user: str = ""
    password: str = ""
    database: str = ""
    seconds: float = 30.0
    most_bytes: int = MOST_BYTES

    def __post_init__(self) -> None:
        self.url = self.url.rstrip("/")
        self.origin = self._origin(self.url)
        if self.origin[0] not in ("http", "https") or (self.origin[0] == "http" and self.password and self.origin[1] not in LOCAL):
            raise ValueError("passwords go by HTTPS, or to this machine")
        self.opener = urllib.request.build_opener(urllib.request.ProxyHandler({}), _Elsewhere)
        self.until = time.monotonic() + self.seconds

    @staticmethod
    def _origin(url: str) -> tuple[str, str | None, int | None]:
        p = urllib.parse.urlsplit(url)
        return p.scheme, p.hostname, p.port or {"http": 80, "https": 443}.get(p.scheme)

    def same_origin(self, url: object, path: str) -> str:
        """``url`` if it is a plain address under ``path`` at this origin."""
        p = urllib.parse.urlsplit(url) if isinstance(url, str) else None
        if p is None or self._origin(url) != self.origin or p.username or p.password or p.fragment or not p.path.startswith(path) or ".." in p.path:
            raise StatementError("a page names a place outside of its statement")
        return url

    def ask(self, method: str, url: str, body: str | None = None, **headers: str) -> tuple[int, dict]:
        """(status, JSON object) of a response within the cap and the deadline."""
        left = self.until - time.monotonic()
        if left <= 0:
            raise TimeoutError(f"stopped after {self.seconds} s")
        request = urllib.request.Request(url, None if body is None else body.encode(), method=method)
        for k, v in {"Accept-Encoding": "identity", "Accept": "application/json"}.items() | headers.items():
            request.add_header(k.replace("_", "-"), v)
        if self.password:
            request.add_header("Authorization", "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode())
        try:
            with self.opener.open(request, timeout=left) as response:
                raw = response.read(self.most_bytes + 1)
                status = response.status
        except urllib.error.HTTPError as e:
            raise StatementError(f"status {e.code}: {e.read(300).decode(errors='replace')}") from None
        except (urllib.error.URLError, ConnectionError) as e:
            raise StatementError(f"no answer: {e}") from None
        if len(raw) > self.most_bytes:
            raise ResponseTooLarge(f"a response of more than {self.most_bytes} bytes")
        try:
            found = json.loads(raw) if raw else {}
        except (ValueError, RecursionError):
            found = None
        if not isinstance(found, dict):
            raise StatementError("the answer is no JSON object")
        return status, found

    def quietly(self, method: str, url: str, body: str | None = None) -> None:
        """A last request, whose failure changes nothing."""
        self.until = time.monotonic() + 2
        with contextlib.suppress(Exception):
            self.ask(method, url, body)


Columns = list[tuple[str, T.DataType]]


def _rows(data: object, width: int) -> list[list]:
    if not isinstance(data, list) or any(not isinstance(r, list) or len(r) != width for r in data):
        raise StatementError("rows do not fit the columns")
    return data


def _columns(found: object, kind: str = "type") -> Columns:
    try:
        return [(str(c["name"]), spark_type(str(c[kind]), c.get("scale"))) for c in found]
    except (TypeError, KeyError):
        raise StatementError("the answer has no columns") from None


def whole(client: Client, sql: str) -> Iterator[tuple[Columns, list[list]]]:
    """One answer; the server ends the statement when the connection goes."""
    url = f"{client.url}/?{urllib.parse.urlencode({'database': client.database, 'cancel_http_readonly_queries_on_client_close': 1})}"
    _, found = client.ask("POST", url, f"{sql}\nFORMAT JSONCompact", **({"X_ClickHouse_User": client.user} if client.user and not client.password else {}))
    if "exception" in found:
        raise StatementError(str(found["exception"])[:300])
    columns = _columns(found.get("meta"))
    yield columns, _rows(found.get("data"), len(columns))


def paged(client: Client, sql: str) -> Iterator[tuple[Columns, list[list]]]:
    """Pages that name the next one; what is left unread is cancelled."""
    catalog, _, schema = client.database.partition(".")
    path = f"{urllib.parse.urlsplit(client.url).path}/v1/statement"
    names = {"X_Trino_User": client.user or "reader", "X_Trino_Catalog": catalog, "X_Trino_Schema": schema}
    here, columns = None, []
    try:
        _, page = client.ask("POST", f"{client.url}/v1/statement", sql, **names)
        while True:
            here = client.same_origin(page["nextUri"], path) if page.get("nextUri") is not None else None
            if "error" in page:
                raise StatementError(str(page["error"])[:300])
            columns = _columns(page["columns"]) if page.get("columns") else columns
            if rows := _rows(page.get("data") or [], len(columns)):
                yield columns, rows
            elif columns and here is None:
                yield columns, []
            if here is None:
                return
            _, page = client.ask("GET", here)
    finally:
        if here is not None:
            client.quietly("DELETE", here)


def submit(client: Client, sql: str, pause: float = 0.2) -> tuple[str, Columns, int]:
    """(handle, columns, number of pages) of a statement, once it is done."""
    catalog, _, schema = client.database.partition(".")
    status, found = client.ask("POST", f"{client.url}/api/v2/statements?async=true", json.dumps({"statement": sql, "database": catalog, "schema": schema}), Content_Type="application/json")
    handle = str(found.get("statementHandle", ""))
    if not re.fullmatch(r"[\w-]+", handle):
        raise StatementError("the answer names no statement")
    try:
        while status == 202:
            time.sleep(pause)
            status, found = client.ask("GET", f"{client.url}/api/v2/statements/{handle}")
        about = found.get("resultSetMetaData")
        if not isinstance(about, dict):
            raise StatementError(str(found.get("message", "the answer has no result"))[:300])
        return handle, _columns(about.get("rowType")), len(about.get("partitionInfo") or [0])
    except BaseException:
        cancel(client, handle)
        raise


def cancel(client: Client, handle: str) -> None:
    client.quietly("POST", f"{client.url}/api/v2/statements/{handle}/cancel", "{}")


@dataclass
class Share(InputPartition):
    """A part of a statement's result: a text of its own, or a page."""

    sql: str = ""
    handle: str = ""
    page: int = 0


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Share]:
        o = self.options
        sql, column, n = read_only(o["sql"]), o.get("partitioncolumn"), int(o.get("numpartitions", 1))
        if o["protocol"] == "submitted":
            handle, _, pages = submit(_client(o), sql)
            return [Share(handle=handle, page=i) for i in range(pages)]
        if not column or n < 2:
            return [Share(sql=sql)]
        if not re.fullmatch(r"\w+", column):
            raise ValueError(f"no plain column: {column}")
        low, high = int(o["lowerbound"]), int(o["upperbound"])
        edges = [low + (high - low) * i // n for i in range(1, n)]
        conditions = [f"{column} < {edges[0]} OR {column} IS NULL", *(f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:], strict=False)), f"{column} >= {edges[-1]}"]
        return [Share(sql=f"SELECT * FROM ({sql}) AS part_of WHERE {c}") for c in conditions]

    def read(self, partition: Share) -> Iterator[tuple]:
        o, kinds = self.options, [f.dataType for f in self.schema.fields]
        client = _client(o)
        if partition.handle:
            try:
                _, found = client.ask("GET", f"{client.url}/api/v2/statements/{partition.handle}?partition={partition.page}")
                pages: Iterator = iter([(self.schema.names, _rows(found.get("data"), len(kinds)))])
            except BaseException:
                cancel(client, partition.handle)
                raise
        else:
            pages = (whole if o["protocol"] == "whole" else paged)(client, partition.sql)
        for columns, rows in pages:
            if len(columns) != len(kinds):
                raise StatementError("the columns are not those of the schema")
            for row in rows:
                yield tuple(map(spark_value, row, kinds))


def _client(o: dict[str, str]) -> Client:
    return Client(o["url"], o.get("user", ""), o.get("password", ""), o.get("database", ""), float(o.get("seconds", 30)), int(o.get("mostbytes", MOST_BYTES)))


class StatementSource(DataSource):
    """``spark.read.format("statement")`` with options url, protocol, sql, database, user, password, seconds, mostBytes and, for reading
    in ranges, partitionColumn, lowerBound, upperBound and numPartitions."""

    @classmethod
    def name(cls) -> str:
        return "statement"

    def _options(self) -> dict[str, str]:
        o = {k.lower(): v for k, v in dict(self.options).items()}
        if o.get("protocol") not in set(PROTOCOLS.values()):
            raise ValueError(f"unknown protocol: {o.get('protocol')}")
        return o

    def schema(self) -> T.StructType:
        """Of a result without rows."""
        o = self._options()
        probe, client = f"SELECT * FROM ({read_only(o['sql'])}) AS columns_of LIMIT 0", _client(o)
        if o["protocol"] == "submitted":
            columns = submit(client, probe)[1]
        else:
            columns = next(iter((whole if o["protocol"] == "whole" else paged)(client, probe)))[0]
        return T.StructType([T.StructField(n, k) for n, k in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self._options())


def statement(spark: SparkSession, kind: str, sql: str, **options: object) -> DataFrame:
    """The result of a statement at a source of ``kind``."""
    spark.dataSource.register(StatementSource)
    return spark.read.format("statement").options(protocol=PROTOCOLS[kind], sql=sql, **options).load()
