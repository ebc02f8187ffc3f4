"""SQL texts laid out: one clause a line, keywords in capitals, strings and comments untouched."""

from __future__ import annotations

import re

_KEYWORDS = (
    "select distinct from where group by order by having limit offset union all intersect except inner left right full outer cross join on using and or not in is null "
    "like between exists case when then else end as with recursive asc desc over partition"
).split()
_CLAUSE = re.compile(r"(?i)\s+(from|where|group by|order by|having|limit|union all|union|intersect|except|(?:inner |left |right |full |cross )?(?:outer )?join)\b")
_TOKEN = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/)", re.S)
_WORD = re.compile(rf"(?i)\b({'|'.join(_KEYWORDS)})\b")


def laid_out(sql: str) -> str:
    """The same query, spaced and broken into clauses; laying it out again changes nothing."""
    parts = _TOKEN.split(sql.strip().rstrip(";"))
    held = parts[1::2]
    plain = "\0".join(parts[::2])
    plain = re.sub(r"\s+", " ", plain)
    plain = _WORD.sub(lambda m: m[0].upper(), plain)
    plain = _CLAUSE.sub(lambda m: "\n" + m[1].upper(), plain)
    out = plain.split("\0")
    return "".join(x for pair in zip(out, [*held, ""], strict=True) for x in pair)
