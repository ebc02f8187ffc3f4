"""Conditions and metrics in the words of other databases, run by databases that are at hand."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import types as T

from tallyforge.plans import metrics, policy
from tallyforge.queries import CATALOG, _facts
from tallyforge.session import table
from tallyforge.sources import dialects

#: DuckDB takes PostgreSQL's words, SQLite those of the standard.
DUCK, LITE = "jdbc:postgresql://x/y", "jdbc:sqlite:x"
ALL = [f"jdbc:{k}" for k in ("mysql://x", "postgresql://x", "oracle:thin:@x", "sqlserver://x", "db2://x", "h2:x", "snowflake://x", "teradata://x", "sqlite:x", "duckdb:x", "trino://x")]
CONDITIONS = (
    "o_totalprice > 100000 AND o_orderstatus <> 'F'", "o_orderstatus IN ('F', 'P') OR o_custkey < 20", "o_orderpriority LIKE '1%' AND o_orderkey BETWEEN 50 AND 900",
    "CASE WHEN o_custkey > 50 THEN 'a' ELSE o_orderstatus END = 'a'", "o_orderkey % 7 = 3", "NOT (o_custkey > 30) OR o_orderstatus IS NULL", "o_orderpriority LIKE '%HIGH' OR o_orderpriority LIKE '%URG%'",
    "o_orderpriority <> 'it''s' AND o_totalprice * 2 > 150000.5",
)


@pytest.fixture(scope="module")
def lite(spark, sf):
    d = sqlite3.connect(":memory:")
    d.execute("CREATE TABLE orders (o_orderkey INTEGER, o_custkey INTEGER, o_orderstatus TEXT, o_totalprice REAL, o_orderpriority TEXT)")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").collect()
    d.executemany("INSERT INTO orders VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in rows])
    return d


@pytest.fixture(scope="module")
def duck(sf):
    d = duckdb.connect()
    d.sql(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    return d


@pytest.mark.parametrize("text", CONDITIONS)
def test_conditions_hold_for_the_same_rows(spark, sf, duck, lite, text):
    x = table(spark, sf, "orders")
    want = sorted(r.o_orderkey for r in x.where(text).collect())
    assert want
    for there, url in ((duck, DUCK), (lite, LITE)):
        said = dialects.condition(x, text, url)
        assert sorted(r[0] for r in there.execute(f"SELECT o_orderkey FROM orders WHERE {said}").fetchall()) == want, said


def test_each_has_its_own_words(spark, sf):
    x = table(spark, sf, "orders")
    said = {u.split(":")[1]: dialects.condition(x, "o_orderkey > 7", u) for u in ALL}
    assert "`o_orderkey` > 7" in said["mysql"] and '"o_orderkey" > 7' in said["oracle"] and len(said) == len(ALL)


@pytest.mark.parametrize("text", ["o_orderpriority RLIKE '1'", "md5(o_orderstatus) = 'x'", "o_orderstatus = (SELECT 1)", "true", r"o_orderstatus = r'a\\b'"])
def test_what_has_no_words_is_refused(spark, sf, text):
    with pytest.raises((dialects.Untranslatable, policy.PolicyViolation)):
        dialects.condition(table(spark, sf, "orders"), text, DUCK)


@pytest.mark.parametrize(
    "wanted",
    [
        metrics.Selection(("order_total", "order_count"), ("o_orderstatus",)),
        metrics.Selection(("order_count",), ("o_orderpriority", "o_orderstatus"), filters=(("o_orderstatus", "F"),)),
        metrics.Selection(("order_total",)),
    ],
)
def test_metrics_give_the_same_rows(spark, sf, duck, lite, wanted):
    facts = _facts(spark, sf)
    rounded = lambda rows: [tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in rows]
    want = rounded(metrics.compile_selection(CATALOG, wanted, facts).collect())
    for there, url in ((duck, DUCK), (lite, LITE)):
        assert rounded(there.execute(dialects.selection(CATALOG, wanted, facts, url)).fetchall()) == want


def test_selections_are_checked(spark, sf):
    facts = _facts(spark, sf)
    for wanted in (metrics.Selection(("order_count",), grain="month"), metrics.Selection(("order_count",), ("segment",))):
        with pytest.raises(dialects.Untranslatable):
            dialects.selection(CATALOG, wanted, facts, DUCK)
    with pytest.raises(dialects.Untranslatable):
        dialects.selection(CATALOG, metrics.Selection(("order_total",)), {"orders": facts["orders"].drop("o_totalprice")}, DUCK)
    with pytest.raises(metrics.CatalogError):
        dialects.selection(CATALOG, metrics.Selection(("gone",)), facts, DUCK)


def test_types_and_abilities(spark):
    assert [dialects.column_type(spark, u, T.StringType()) for u in ALL[:2]] == ["LONGTEXT", "TEXT"]
    assert dialects.column_type(spark, ALL[1], T.DecimalType(10, 2)) == "NUMERIC(10,2)" and dialects.column_type(spark, ALL[0], T.LongType())
    with pytest.raises(dialects.Untranslatable):
        dialects.column_type(spark, ALL[0], T.MapType(T.StringType(), T.StringType()))
    assert dialects.abilities(spark, ALL[0])["limit"] and "SUM" in dialects.abilities(spark, ALL[0])["functions"] and "SQRT" in dialects.abilities(spark, ALL[5])["functions"]
    with pytest.raises(ValueError):
        dialects.abilities(spark, "http://x")
