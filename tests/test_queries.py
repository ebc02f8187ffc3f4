"""Each registered query against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tallyforge.queries import QUERIES, SQL
from tallyforge.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    d = duckdb.connect()
    for t in TABLES:
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return d


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == _rows(want.columns, want.fetchall())
