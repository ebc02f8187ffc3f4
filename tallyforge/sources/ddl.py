"""Declared schemas: CREATE TABLE texts as types and foreign keys; nothing is executed."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

_TABLE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\((.*)\)\s*$", re.I | re.S)
_KEY = re.compile(r"foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.\"`]+)\s*\(([^)]*)\)", re.I)
_INLINE = re.compile(r"references\s+([\w.\"`]+)\s*\(\s*(\w+)\s*\)", re.I)
#: Type names of other databases and Spark's types for them.
TYPES = {
    "int": "int", "integer": "int", "int4": "int", "serial": "int", "bigint": "bigint", "int8": "bigint", "smallint": "smallint", "tinyint": "tinyint",
    "float": "float", "real": "double", "double": "double", "float8": "double", "decimal": "decimal", "numeric": "decimal", "money": "decimal",
    "varchar": "string", "char": "string", "text": "string", "nvarchar": "string", "clob": "string", "string": "string", "uuid": "string", "enum": "string",
    "date": "date", "time": "string", "timestamp": "timestamp", "datetime": "timestamp", "timestamptz": "timestamp", "boolean": "boolean", "bool": "boolean",
    "blob": "binary", "bytea": "binary", "binary": "binary", "varbinary": "binary", "json": "string", "jsonb": "string",
}


@dataclass(frozen=True)
class Declared:
    """One declared table."""

    name: str
    schema: T.StructType
    keys: tuple[tuple[str, str, str], ...]  # (column, other table, other column)


def _items(body: str) -> list[str]:
    """Parts between commas outside of parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
    return [x.strip() for x in (*out, body[start:])]


def declared(text: str) -> dict[str, Declared]:
    """Tables of a text of CREATE TABLE statements; anything else is refused."""
    out: dict[str, Declared] = {}
    for statement in filter(None, map(str.strip, re.sub(r"--[^\n]*", "", text).split(";"))):
        m = _TABLE.match(statement)
        if not m:
            raise ValueError("only CREATE TABLE declarations")
        fields, keys, name = [], [], m[1].strip('"`')
        for item in _items(m[2]):
            if k := _KEY.search(item):
                keys += list(zip(map(str.strip, k[1].split(",")), [k[2].strip('"`')] * 99, map(str.strip, k[3].split(",")), strict=False))
            elif not re.match(r"(primary\s+key|unique|check|constraint|index|key)\b", item, re.I):
                column, kind = (item.split(None, 1) + ["string"])[:2]
                base = TYPES.get(re.match(r"\w+", kind)[0].lower(), "string")
                size = re.match(r"\w+\s*(\(\s*\d+\s*,\s*\d+\s*\))", kind)
                kind_ = T._parse_datatype_string(base + (size[1] if base == "decimal" and size else "(38,6)" if base == "decimal" else ""))
                nullable = not re.search(r"not\s+null|primary\s+key", kind, re.I)
                fields.append(T.StructField(column.strip('"`'), kind_, nullable))
                if r := _INLINE.search(kind):
                    keys.append((column.strip('"`'), r[1].strip('"`'), r[2]))
        if not fields or name in out:
            raise ValueError("a table has columns and a name of its own")
        out[name] = Declared(name, T.StructType(fields), tuple(keys))
    return out
