"""Metric selections, the read-only gate, bounded runs and validation."""

import json
import time

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tallyforge.operators import catalog, evaluation, evidence, learning
from tallyforge.plans import formulas, metrics, policy, validate
from tallyforge.queries import CATALOG, _facts
from tallyforge.session import register, require_revision, schema_revision, SchemaChanged, table
from tallyforge.sources.connectors import Connections, keep_newest, without
from tallyforge.streaming import ingest

REFUSED = [
    "DELETE FROM orders", "DROP TABLE orders", "SET spark.x = 1", "SELECT 1; SELECT 2", "SELECT java_method('a', 'b')", "SELECT reflect('a', 'b')",
    "SELECT * FROM range(3)", "SELECT * FROM parquet.`/tmp/x`", "SELECT /*+ BROADCAST(a) */ 1", "SELECT 'a\\n'", "SELECT 1 --x",
    "INSERT INTO orders SELECT * FROM orders", "SELECT TRANSFORM(a) USING 'cat' FROM orders", "CREATE TABLE t AS SELECT 1", "SHOW TABLES",
    "SELECT * FROM orders WHERE o_orderkey IN (SELECT id FROM range(3))", "SELECT no_such_function(1)", "FROM orders INSERT INTO orders SELECT *",
]
ALLOWED = [
    "SELECT 1", "EXPLAIN SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "SELECT count(*) FROM orders GROUP BY o_orderstatus HAVING count(*) > 1",
    "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders)", "SELECT 1 -- a note",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_gate_refuses(spark, sf, sql):
    register(spark, sf, ("orders",))
    with pytest.raises(policy.PolicyViolation):
        policy.run_query(spark, sql)


@pytest.mark.parametrize("form", ["parquet.`{}/region.parquet`", "`parquet`.`{}/region.parquet`", "json.`{}`", "`{}/region.parquet`", "text.`/etc/hostname`", "`file.csv`", "no_database.region", "no_catalog.a.region"])
def test_no_file_is_read(spark, sf, form):
    with pytest.raises(policy.PolicyViolation):
        policy.run_query(spark, f"SELECT count(*) FROM {form.format(sf)}")


def test_gate_keeps_to_its_tables(spark, sf):
    register(spark, sf, ("region", "nation"))
    assert policy.run_query(spark, "SELECT r_name FROM Region ORDER BY 1", tables={"region"}).rows[0] == ("AFRICA",)
    assert policy.run_query(spark, "WITH x AS (SELECT r_name FROM region) SELECT count(*) FROM x", tables={"region"}).rows == [(5,)]
    for sql in (
        "SELECT * FROM nation", "SELECT * FROM region JOIN nation ON r_regionkey = n_regionkey", "SELECT (SELECT max(n_name) FROM nation) FROM region",
        "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)", "SELECT * FROM nation, (WITH nation AS (SELECT 1) SELECT * FROM nation) x",
        "WITH a AS (SELECT * FROM nation) SELECT * FROM a", "SELECT * FROM default.region",
    ):
        with pytest.raises(policy.PolicyViolation):
            policy.run_query(spark, sql, tables={"region"})


def test_runs_are_validated_and_tied_to_schemas(spark, sf):
    register(spark, sf, ("region",))
    for sql in ("SELECT nothing FROM region", "SELECT sum(r_name) FROM region"):
        with pytest.raises(policy.PolicyViolation):
            policy.run_query(spark, sql)
    seen = schema_revision(spark.table("region"))
    assert policy.run_query(spark, "SELECT count(*) FROM region", revisions={"region": seen}).rows == [(5,)]
    with pytest.raises(SchemaChanged):
        policy.run_query(spark, "SELECT count(*) FROM region", revisions={"region": "another"})
    with pytest.raises(ArithmeticException):
        policy.run_query(spark, "SELECT abs(cast('-9223372036854775808' AS BIGINT)) AS x")


@pytest.mark.parametrize("text", ["`approx_percentile`(x, 0.5)", "reflect('a', 'b')", "(SELECT max(x) FROM t)", "x IN (SELECT 1)", "sum(x) -- y", "sum(", "sys.sum(x)", "exists(SELECT 1)"])
def test_expressions_off_the_list(spark, text):
    x = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(policy.PolicyViolation):
        formulas.query_metrics(x, [formulas.FormulaMetric("m", text)])


def test_lookup_keys_do_not_repeat(spark):
    look = metrics.Lookup("k", "dim", "id", (("name", "name"),))
    held = metrics.Catalog("1", (metrics.Metric("total", "fact", "v", "sum", (), None, look),))
    tables = {"fact": spark.createDataFrame([(1, 10)], "k int, v int"), "dim": spark.createDataFrame([(1, "a"), (1, "a")], "id int, name string")}
    asked = metrics.Selection(("total",), ("name",))
    with pytest.raises(Exception, match="lookup key repeats"):
        metrics.compile_selection(held, asked, tables).collect()
    tables["dim"] = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "id int, name string")
    assert [tuple(r) for r in metrics.compile_selection(held, asked, tables).collect()] == [("a", 10)]
    with pytest.raises(metrics.CatalogError):
        metrics.compile_selection(held, asked, tables | {"dim": spark.createDataFrame([("1", "a")], "id string, name string")})


def test_validation_reads_plans_not_words(spark, sf):
    register(spark, sf, ("orders", "customer"))
    warned = lambda sql: validate.validate(spark, sql).warnings
    assert "no WHERE" in warned("SELECT o_orderkey AS where_x FROM (SELECT * FROM orders WHERE o_orderkey > 1) t LIMIT 5")
    assert "no WHERE" not in warned("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'no limit' LIMIT 5")
    assert "no LIMIT" in warned("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'no limit'")
    assert "LIKE with a leading wildcard" in warned("SELECT o_orderkey FROM orders WHERE o_orderstatus LIKE '%F' LIMIT 1")
    assert "a join without a condition" in warned("SELECT o_orderkey FROM orders, customer WHERE o_orderkey = 1 LIMIT 1")
    assert not validate.validate(spark, "SELECT o_orderkey FROM orders LIMIT 1", {"require_time_range": ""}).valid
    assert validate.validate(spark, "SELECT o_orderkey FROM orders WHERE o_orderdate > DATE '1995-01-01' LIMIT 1", {"require_time_range": ""}).valid
    assert not validate.validate(spark, "SELECT round(o_totalprice, 5) FROM orders", {"precision": "2"}).valid
    assert validate.validate(spark, "SELECT sum(cast(o_orderstatus AS double)) FROM orders").valid


def test_plan_facts_come_from_nodes(spark, sf):
    register(spark, sf, ("orders", "customer"))
    whole, part = (policy.plan_facts(spark.sql(f"SELECT * FROM orders {x}")) for x in ("", "WHERE year(o_orderdate) = 1995 AND o_orderstatus = 'F'"))
    assert whole.full_scans == ["Parquet"] and whole.estimated_bytes > 0 and part.pushed and not part.full_scans
    assert "a filter over a function of o_orderdate is not pushed" in part.warnings
    both = policy.merged_facts([whole, part, whole])
    assert both.scans == ["Parquet"] * 3 and both.estimated_bytes == 2 * whole.estimated_bytes + part.estimated_bytes and len(both.warnings) == 2


def test_evidence(spark, sf):
    register(spark, sf, ("orders", "customer", "nation"))
    keys = spark.createDataFrame([("k", "orders", "o_custkey", "customer", "c_custkey")], "key_name string, from_table string, from_column string, to_table string, to_column string")
    sql = "-- ASSUMPTION: net of tax\nSELECT count(*) FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey\n-- CLARIFICATION: which year?"
    got = evidence.evidence(spark, sql, keys, executed=True)
    assert dict((n, s) for n, s, _ in got.checks) == {
        "syntax": "passed", "tables and columns": "passed", "types": "passed", "rules": "unverified", "execution": "passed", "joins": "passed", "meaning": "unverified",
    }
    assert got.assumptions == ["net of tax"] and got.clarifications == ["which year?"]
    more = evidence.evidence(spark, "SELECT 1 FROM orders JOIN customer ON o_orderkey = c_custkey JOIN nation ON n_nationkey = c_nationkey AND n_name = 'x'", keys)
    assert ("joins", "unverified", "0 of 2 backed by a key") in more.checks and len(more.assumptions) == 2
    assert ("tables and columns", "failed") in [c[:2] for c in evidence.evidence(spark, "SELECT x FROM orders").checks]


@pytest.mark.parametrize("sql", ALLOWED)
def test_gate_allows(spark, sql):
    assert policy.require_read_query(spark, sql) == sql


def test_bounded_run_is_cut_and_stopped(spark, sf):
    register(spark, sf, ("orders",))
    assert policy.run_query(spark, "SELECT o_orderkey FROM orders", most=5).truncated
    assert not policy.run_query(spark, "SELECT count(*) FROM orders", most=5).truncated
    began = time.time()
    with pytest.raises(TimeoutError):
        policy.bounded(spark.range(4_000_000).alias("a").crossJoin(spark.range(4_000_000).alias("b")).agg(F.sum(F.xxhash64("a.id", "b.id") % 7)), seconds=1.0)
    assert time.time() - began < 60


@pytest.mark.parametrize(
    "selection",
    [
        metrics.Selection(()), metrics.Selection(("none",)), metrics.Selection(("revenue", "revenue")), metrics.Selection(("revenue", "order_total")),
        metrics.Selection(("revenue",), ("none",)), metrics.Selection(("revenue",), grain="hour"), metrics.Selection(("revenue",), filters=(("x", 1),)),
    ],
)
def test_selection_is_refused(spark, sf, selection):
    with pytest.raises(metrics.CatalogError):
        metrics.compile_selection(CATALOG, selection, _facts(spark, sf))


def test_lookup_is_joined_only_if_used(spark, sf):
    facts = _facts(spark, sf)
    plain = metrics.compile_selection(CATALOG, metrics.Selection(("order_count",), ("o_orderstatus",)), facts)
    used = metrics.compile_selection(CATALOG, metrics.Selection(("order_count",), ("segment",)), facts)
    assert not policy.plan_facts(plain).joins and policy.plan_facts(used).joins


def test_catalog_reads_json_once(spark):
    with pytest.raises(metrics.CatalogError):
        metrics.load_catalog('{"version": "1", "version": "2", "metrics": []}')
    with pytest.raises(metrics.CatalogError):
        metrics.load_catalog(json.dumps({"version": "1", "metrics": [{"name": "a", "table": "t", "column": "c", "aggregation": "median"}]}))
    assert CATALOG.fingerprint() == CATALOG.fingerprint()
    result = spark.createDataFrame([(1, "a")], "n int, s string")
    assert metrics.accept(result, ["n", "s"], [(1, "a")]) and not metrics.accept(result, ["n", "s"], [(2, "a")])


def test_formulas(spark):
    own = [formulas.FormulaMetric("Sales", "sum(x)", aliases=("turnover",), domain="shop"), formulas.FormulaMetric("sales", "count(*)")]
    assert formulas.resolve(own, "TURNOVER", "shop") is own[0] and formulas.resolve(own, "sales") is own[1] and formulas.resolve(own, "x") is None
    x = spark.createDataFrame([(1, "a"), (2, "b'")], "x int, s string")
    assert x.agg(formulas.fill_template("sum(CASE WHEN {filters} THEN x ELSE 0 END)", {}).alias("v")).first()[0] == 3
    assert x.agg(formulas.fill_template("sum(CASE WHEN {filters} THEN x ELSE 0 END)", {"s": "a"}).alias("v")).first()[0] == 1
    with pytest.raises(policy.PolicyViolation):
        formulas.query_metrics(x, [formulas.FormulaMetric("m", "sum(x); drop table t")])


def test_validation(spark, sf):
    register(spark, sf, ("orders",))
    good = validate.validate(spark, "SELECT o_orderkey FROM orders WHERE o_orderkey > 1 LIMIT 5")
    assert good.valid and good.score == 1.0
    assert not validate.validate(spark, "SELECT nothing FROM orders").valid
    assert not validate.validate(spark, "SELECT sum(o_orderstatus) FROM orders").valid
    assert "SELECT *" in validate.validate(spark, "SELECT * FROM orders").warnings
    assert not validate.validate(spark, "SELECT o_orderkey FROM orders", {"require_limit": ""}).valid


def test_filters_reach_the_scan(spark, sf):
    facts = policy.plan_facts(metrics.compile_selection(CATALOG, metrics.Selection(("order_count",), filters=(("o_orderstatus", "F"),)), _facts(spark, sf)))
    assert facts.pushed and facts.exchanges == 1


def test_sources(spark, sf):
    held = Connections(spark)
    held.create("local", "parquet", path=sf)
    held.create("pg", "postgresql", host="db", port="5432", database="x")
    assert held.read("local", "region").count() == 5 and held.address("pg") == "jdbc:postgresql://db:5432/x"
    with pytest.raises(NotImplementedError):
        held.create("o", "oracle")
    held.close("pg")
    assert held.list() == ["local"]
    x = spark.range(10)
    assert [r.id for r in keep_newest(x, 2, "id").collect()] == [9, 8] and without(x, spark.range(4), "id").count() == 6
    seen = schema_revision(x)
    assert require_revision(x, seen) is x
    with pytest.raises(SchemaChanged):
        require_revision(x.withColumn("y", F.lit(1)), seen)


def test_small_operators(spark):
    x = spark.createDataFrame([("SELECT  1 ;",), (None,)], "s string").select(learning.normal_sql(F.col("s")).alias("n"))
    assert [r.n for r in x.collect()] == ["select 1", None]
    said = ["a JOIN b", "and t.X >= 3", "Where y=1", "order by z", "ORDER  BY z", "having 1", "sum (x)", "x", " ", None]
    kinds = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", learning.fragment_kind(F.col("s")).alias("k"), learning.compared_column(F.col("s")).alias("c"))
    got = sorted(kinds.collect())
    assert [r.k for r in got] == ["JOIN", "AND", "WHERE", "ORDER_BY", "ORDER_BY", "HAVING", "AGGREGATE", "OTHER", None, None]
    assert [r.c and tuple(r.c) for r in got] == [None, ("t", "x"), (None, "y")] + [None] * 7
    low, high = evaluation.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low.alias("a"), high.alias("b")).first()) == (None, None)
    empty = spark.createDataFrame([], "table_name string")
    assert catalog.neighbours(empty, spark.createDataFrame([], "from_table string, to_table string")).count() == 0


def test_stream_equals_batch(spark, sf, tmp_path):
    schema = table(spark, sf, "events").schema
    folder = tmp_path / "in"
    table(spark, sf, "events").write.parquet(str(folder))
    out = str(tmp_path / "out")
    ingest.ingest(ingest.windowed(ingest.stream_of(spark, str(folder), schema), "1 hour"), out, str(tmp_path / "c")).awaitTermination()
    closed = {(r.start, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    x = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    whole = {(r.window.start, r.event_type): r.n for r in x.collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def test_catalog_reads_yaml_without_tricks(spark):
    text = "version: '1'\nmetrics:\n- {name: a, table: t, column: c, aggregation: sum, dimensions: [d]}\n"
    assert metrics.load_catalog(text).metric("a").dimensions == ("d",)
    for bad in (
        "version: '1'\nversion: '2'\nmetrics: []", "version: &v '1'\nmetrics: []\nother: *v", "version: '1'", "- 1", "version: !!python/object/apply:os.getcwd []\nmetrics: []", "a: [", "x" * (1 << 20) + "yy",
    ):
        with pytest.raises(metrics.CatalogError):
            metrics.load_catalog(bad)


def test_metadata_scans_are_whole_or_refused(spark):
    rows = spark.createDataFrame([("t", f"c{i}", "BIGINT", i + 1) for i in range(5)], "a string, b string, c string, d int")
    assert [tuple(r) for r in catalog.scanned_columns(lambda q: rows, "public").collect()][0] == ("t", "c0", "bigint", 0)
    for schema, most in (("public", 4), ("x' OR 1=1", 9)):
        with pytest.raises(ValueError):
            catalog.scanned_columns(lambda q: rows, schema, most)


def test_structure(spark):
    got = policy.structure(spark, "WITH a AS (SELECT * FROM t) SELECT k, count(*) FROM a JOIN u USING (k) WHERE k IN (SELECT k FROM w) GROUP BY k ORDER BY 2")
    assert got == {"tables": ["t", "u", "w"], "joins": 1, "where": True, "order": True, "aggregate": True, "subquery": True, "cte": True}
    assert policy.structure(spark, "SELECT x FROM t") == {"tables": ["t"], "joins": 0, "where": False, "order": False, "aggregate": False, "subquery": False, "cte": False}


def test_load_levels_stop(spark):
    levels = evaluation.load_levels(lambda: spark.range(10).count(), (1, 2), 2)
    assert [x["callers"] for x in levels] == [1, 2] and not levels[0]["errors"]
    levels = evaluation.load_levels(lambda: 1 / 0, (1, 2), 2)
    assert len(levels) == 1 and levels[0]["stopped"] and levels[0]["errors"] == 2


def test_unions_are_no_subqueries(spark):
    nested = lambda sql: policy.structure(spark, sql)["subquery"]
    assert not nested("select r_name from region union select n_name from nation") and not nested("select a.x from t a join u as b on a.x = b.x")
    assert nested("select x from (select x from t) s") and nested("select (select max(x) from t)") and nested("select x from t where exists (select 1 from u)")


def test_results_are_bounded_by_bytes(spark):
    x = spark.range(50).select("id", F.repeat(F.lit("é"), F.col("id").cast("int") * 100).alias("id"), F.array(F.lit("a"), F.lit(None)).alias("list"))
    whole = policy.bounded(x)
    assert len(whole.rows) == 50 and not whole.truncated and whole.rows[3] == (3, "é" * 300, ["a", None]) and whole.columns == ["id", "id", "list"]
    cut = policy.bounded(x, most_bytes=20_000)
    held = sum(8 + 200 * i + len("[a, null]") for i in range(len(cut.rows)))
    assert cut.truncated and held <= 20_000 < held + 8 + 200 * len(cut.rows) + 9 and cut.rows == whole.rows[: len(cut.rows)]
    one = policy.bounded(spark.range(1).select(F.repeat(F.lit("x"), 100).alias("a")), most_bytes=50)
    assert one.rows == [] and one.truncated
    assert policy.bounded(spark.range(5).orderBy(F.col("id").desc()), most=3).rows == [(4,), (3,), (2,)]


@pytest.mark.parametrize("sql", [
    "select repeat('x', 1000000000)", "explain select repeat('x', 1000000000)", "select length(repeat('x', 1000000000))", "select * from (select lpad('x', 900000000, 'y') as a) where a > 'b'",
    "select repeat(repeat('x', 10000), 10000)", "select replace(repeat('a', 100000), 'a', repeat('b', 100000))", "select 1 where exists (select repeat('x', 1000000000))", "select repeat('x', cast(rand() * 10 as int))",
])
def test_texts_that_blow_up_are_refused(spark, sql):
    with pytest.raises(policy.PolicyViolation):
        policy.run_query(spark, sql)


def test_short_constants_pass(spark):
    assert policy.run_query(spark, "select repeat('ab', 3) as a, lpad('7', 4, '0') as b").rows == [("ababab", "0007")]


def test_recursion_gives_all_rows(spark, sf):
    from tallyforge.queries import QUERIES

    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "10")  # as tables of more rows meet the usual limit
    try:
        high = table(spark, sf, "orders").where("o_totalprice > 300000").count()
        assert high > 10 and QUERIES["sql_recursive"](spark, sf).count() == 4 * high
    finally:
        spark.conf.unset(limit)
