"""Texts and metrics over an attached database, written once, against the same over Parquet."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.plans import metrics, policy
from tallyforge.queries import CATALOG, QUERIES, SQL, _facts
from tallyforge.session import table
from tallyforge.sources import databases
from tallyforge.sources.connectors import Connections

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"  # comes with Spark
NAMES = ("region", "nation", "customer", "supplier", "orders")
TEXTS = (
    "sql_select sql_where sql_in sql_between sql_like sql_case sql_coalesce sql_join_inner sql_join_left_zero sql_semi_exists sql_semi_in sql_anti_not_exists "
    "sql_cross_theta sql_scalar_sub sql_derived sql_cte sql_distinct sql_having sql_count_distinct sql_topk sql_rank sql_row_number sql_lag sql_union "
    "sql_union_all sql_intersect sql_except sql_abs sql_round"
).split()


@pytest.fixture(scope="module")
def url(spark, sf):
    at = f"jdbc:derby:memory:shop{uuid.uuid4().hex};create=true"
    for name in NAMES:
        x = table(spark, sf, name)
        x = x.withColumn("o_orderdate", F.col("o_orderdate").cast("date")) if name == "orders" else x
        kinds = ", ".join(f"{f.name} VARCHAR(200)" for f in x.schema.fields if isinstance(f.dataType, T.StringType))
        x.coalesce(1).write.format("jdbc").options(url=at, driver=DRIVER, dbtable=f'"{name}"', createTableColumnTypes=kinds).save()
    return at


@pytest.fixture(scope="module")
def shop(spark, url):
    s = spark.newSession()
    databases.attach(s, "shop", url, driver=DRIVER)
    s.sql("USE shop.APP")
    return s


@pytest.mark.parametrize("name", TEXTS)
def test_a_text_means_the_same_everywhere(spark, sf, shop, name):
    rows = shop.sql(policy.require_read_query(shop, SQL[name])).collect()
    assert Counter(map(str, rows)) == Counter(map(str, QUERIES[name](spark, sf).collect()))


def test_what_a_database_can_do_is_left_to_it(shop):
    x = shop.sql("SELECT o_orderstatus, sum(o_totalprice) AS s, count(*) AS n FROM orders WHERE o_custkey > 10 AND o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
    (scan,) = databases.asked(x)
    assert "SUM" in scan.pushed["PushedAggregates"] and "o_orderstatus" in scan.pushed["PushedGroupByExpressions"] and "o_custkey" in scan.pushed["PushedFilters"]
    assert not databases.spark_after(x)
    assert len(x.collect()) == 2


def test_limits_that_a_dialect_would_lose_stay_in_spark(shop, spark):
    top = shop.sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3")
    assert databases.spark_after(top) == {"TakeOrderedAndProjectExec"} and top.count() == 3 and len(shop.sql("SELECT o_orderkey FROM orders LIMIT 7").collect()) == 7
    s = spark.newSession()
    databases.attach(s, "my", "jdbc:mysql://db:3306/x")
    assert s.conf.get("spark.sql.catalog.my.pushDownLimit") == "true" and shop.conf.get("spark.sql.catalog.shop.pushDownLimit") == "false"


def test_what_it_cannot_do_stays_in_spark(shop, spark, sf):
    text = "SELECT o_orderkey FROM orders WHERE o_orderpriority RLIKE '^[12]' AND o_custkey > 5"
    x = shop.sql(text)
    assert "o_custkey" in databases.asked(x)[0].pushed["PushedFilters"] and "RLIKE" not in str(databases.asked(x)) and databases.spark_after(x) == {"FilterExec"}
    orders = table(spark, sf, "orders").where("o_orderpriority RLIKE '^[12]' AND o_custkey > 5")
    assert sorted(r[0] for r in x.collect()) == sorted(r.o_orderkey for r in orders.collect())


@pytest.mark.parametrize(
    "wanted",
    [
        metrics.Selection(("order_count", "order_total"), ("o_orderstatus",)),
        metrics.Selection(("order_count",), ("o_orderpriority",), filters=(("o_orderstatus", "F"),)),
    ],
)
def test_metrics_over_a_database(spark, sf, shop, wanted):
    there = metrics.compile_selection(CATALOG, wanted, databases.tables(shop, "shop", "APP"))
    here = metrics.compile_selection(CATALOG, wanted, _facts(spark, sf))
    assert "PushedAggregates" in databases.asked(there)[0].pushed
    rounded = lambda rows: [tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows]
    assert rounded(there.collect()) == rounded(here.collect())


def test_reading_in_ranges(shop, spark, sf):
    x = databases.in_ranges(shop, "shop.APP.orders", "o_orderkey", 4)
    assert x.rdd.getNumPartitions() == 4 and x.count() == table(spark, sf, "orders").count()
    sums = {r[0]: r[1] for r in x.groupBy("o_orderstatus").count().collect()}
    assert sums == {r[0]: r[1] for r in table(spark, sf, "orders").groupBy("o_orderstatus").count().collect()}
    with pytest.raises(ValueError):
        databases.in_ranges(shop, "shop.APP.orders", "o_orderstatus", 4)


def test_ranges_of_an_empty_table(shop, url, spark):
    spark.createDataFrame([], "id long").write.format("jdbc").options(url=url, driver=DRIVER, dbtable='"nothing"').save()
    assert databases.in_ranges(shop, "shop.APP.nothing", "id", 3).count() == 0


def test_the_gate_holds_over_databases(shop):
    assert policy.run_query(shop, "SELECT count(*) AS n FROM shop.APP.nation").rows == [(25,)]
    for text in ("DROP TABLE shop.APP.nation", "INSERT INTO shop.APP.nation SELECT * FROM shop.APP.nation", "SELECT * FROM gone.APP.nation"):
        with pytest.raises(policy.PolicyViolation):
            policy.run_query(shop, text)
    with pytest.raises(policy.PolicyViolation):
        policy.run_query(shop, "SELECT * FROM shop.APP.nation", tables={"shop.APP.region"})


def test_names_and_addresses(spark, url):
    s = spark.newSession()
    databases.attach(s, "pg", "jdbc:postgresql://db:5432/x", user="u")
    assert s.conf.get("spark.sql.catalog.pg.sessionInitStatement") == databases.READ_ONLY["postgresql"]
    for name, at in (("pg", url), ("spark_catalog", url), ("a.b", url), ("x", "file:///x")):
        with pytest.raises(databases.AttachError):
            databases.attach(s, name, at)


def test_a_connection_becomes_a_catalog(spark, url):
    s = spark.newSession()
    held = Connections(s)
    held.create("files", "parquet", path="/x")
    held.create("sf", "snowflake", host="h", database="d", user="u")
    with pytest.raises(NotImplementedError):
        held.attach("files")
    held.attach("sf")
    assert s.conf.get("spark.sql.catalog.sf.url") == "jdbc:snowflake://h/?db=d" and s.conf.get("spark.sql.catalog.sf.user") == "u"
