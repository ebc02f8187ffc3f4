"""Queries of catalog metadata over all tables of a folder, with SQL twins that read the same columns in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import catalog, evaluation, evidence, knowledge, routing
from tallyforge.plans import policy, validate
from tallyforge.queries import CATALOG
from tallyforge.registry import query
from tallyforge.session import TABLES, register, table


def columns(spark: SparkSession, d: str) -> DataFrame:
    """All columns of all tables."""
    return catalog.columns_of(spark, {t: table(spark, d, t) for t in TABLES})


#: The same in DuckDB: c(table_name, column_name, data_type, position).
_C = "WITH c AS (SELECT table_name, column_name, {} AS data_type, position FROM ({}))".format(
    "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type, row_number() OVER () - 1 AS position FROM (DESCRIBE SELECT * FROM {t})" for t in TABLES),
)


@query("schema_docs", f"{_C} SELECT table_name, table_name || ': ' || string_agg(column_name || ' ' || data_type, ', ' ORDER BY position) AS text FROM c GROUP BY table_name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return catalog.schema_documents(columns(spark, d))


@query("column_docs", f"{_C} SELECT table_name || '.' || column_name AS id, replace(table_name || ' ' || column_name, '_', ' ') || ' ' || data_type AS text FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return catalog.column_documents(columns(spark, d)).select("id", "text")


@query("table_rows", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def _(spark: SparkSession, d: str) -> DataFrame:
    each = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


#: Ends of names with what they hold, so that columns of the tables carry personal names.
_ENDS = ("email", "phone", "phone_no_2", "cert_no", "full_name", "ADDRESS", "dob", "status", "pan", "customer_phone", "身份证", "shenfenzheng", "created_at")
_KINDS = "CASE lower(e) WHEN 'email' THEN 'email' WHEN 'phone' THEN 'phone' WHEN 'phone_no_2' THEN 'phone' WHEN 'cert_no' THEN 'id_card' WHEN 'full_name' THEN 'name' WHEN 'address' THEN 'address' WHEN 'dob' THEN 'dob' WHEN 'pan' THEN 'bank_card' WHEN '身份证' THEN 'id_card' WHEN 'shenfenzheng' THEN 'id_card' ELSE '' END"
_E = "[{}]".format(", ".join(f"'{x}'" for x in _ENDS))
_N = f"n AS (SELECT c.table_name, e AS column_name, c.data_type, c.position, {_KINDS} AS kind FROM (SELECT *, {_E}[position % {len(_ENDS)} + 1] AS e FROM c) c)"


def _personal(spark: SparkSession, d: str) -> DataFrame:
    """Each column of the tables under a name from the list, by its place."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), F.col("position") % len(_ENDS) + 1)
    return columns(spark, d).withColumn("column_name", end)


@query("pii_columns", f"{_C}, {_N} SELECT table_name, column_name, kind FROM n")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("table_name", "column_name", catalog.personal_kind(F.col("column_name")).alias("kind"))


@query("pii_summary", f"{_C}, {_N} SELECT kind, count(*) AS n FROM n WHERE kind <> '' GROUP BY kind")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = _personal(spark, d).select(catalog.personal_kind(F.col("column_name")).alias("kind"))
    return x.where("kind <> ''").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "schema_masked",
    f"{_C}, {_N} SELECT table_name, string_agg(CASE WHEN kind <> '' THEN '<pii:' || kind || '>' ELSE column_name END || ': ' || data_type, chr(10) ORDER BY position) AS text FROM n GROUP BY table_name",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return catalog.schema_text(_personal(spark, d))


@query("ambiguous_columns", f"{_C} SELECT column_name, count(DISTINCT table_name) AS n_tables FROM c GROUP BY column_name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return columns(spark, d).groupBy("column_name").agg(F.count_distinct("table_name").alias("n_tables"))


@query("keyword_scan", f"{_C} SELECT column_name, string_agg(DISTINCT table_name, '|' ORDER BY table_name) AS tables FROM c WHERE contains(column_name, 'nation') OR contains(column_name, 'key') GROUP BY column_name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keyword_scan(columns(spark, d), ["NATION", "key", "x"]).select("column_name", F.array_join("tables", "|").alias("tables"))


@query(
    "schema_search",
    f"{_C} SELECT table_name, contains(table_name, 'doc') AS table_match, coalesce(string_agg(column_name, '|' ORDER BY column_name) FILTER (WHERE contains(column_name, 'doc')), '') AS matched "
    "FROM c GROUP BY table_name HAVING contains(table_name, 'doc') OR count(*) FILTER (WHERE contains(column_name, 'doc')) > 0",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(columns(spark, d), " Doc ").withColumn("matched", F.array_join("matched", "|"))


@query(
    "schema_filtered",
    f"{_C} SELECT table_name, CASE WHEN table_name IN ('nation', 'labels') THEN string_agg(column_name, '|' ORDER BY position) ELSE '' END AS columns FROM c GROUP BY table_name",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    held = columns(spark, d)
    hits = catalog.live_hits(spark.createDataFrame([("nation",), ("gone",), ("labels",)], "table_name string"), held)
    return catalog.filtered(held, hits).withColumn("columns", F.array_join("columns", "|"))


@query(
    "shared_parts",
    f"{_C} SELECT DISTINCT table_name FROM (SELECT DISTINCT table_name, unnest(string_split(table_name, '_')) AS part FROM c) "
    "WHERE (length(part) >= 4 AND contains('orders and lineitems by region', part)) OR (length(part) >= 3 AND (contains('embedding', part) OR contains('event', part) OR contains('by', part))) "
    "OR contains(part, 'embedding') OR contains(part, 'event')",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return catalog.sharing_parts(columns(spark, d).select("table_name").distinct(), "Orders and lineitems by region", ["embedding", "event", "by"])


@query(
    "schema_diff",
    f"{_C}, o AS (SELECT column_name, data_type FROM c WHERE table_name = 'customer'), n AS (SELECT replace(column_name, 's_', 'c_') AS column_name, data_type FROM c WHERE table_name = 'supplier') "
    "SELECT column_name, data_type, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT column_name, data_type, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    old = columns(spark, d).where("table_name = 'customer'").select("column_name", "data_type")
    new = columns(spark, d).where("table_name = 'supplier'").select(F.replace("column_name", F.lit("s_"), F.lit("c_")).alias("column_name"), "data_type")
    return catalog.schema_changes(old, new)


#: Foreign keys by name: a column of one table that ends like the key of another.
_KEYS = f"""{_C}, k AS (SELECT a.table_name AS from_table, a.column_name AS from_column, b.table_name AS to_table, b.column_name AS to_column FROM c a JOIN c b
ON substring(a.column_name, 3) = substring(b.column_name, 3) AND a.column_name LIKE '_\\_%key' ESCAPE '\\' AND b.column_name LIKE '_\\_%key' ESCAPE '\\' AND b.position = 0 AND a.table_name <> b.table_name
AND contains(b.column_name, b.table_name[1:3]))"""


def _keys(spark: SparkSession, d: str) -> DataFrame:
    c = columns(spark, d).where(r"column_name like '_\\_%key'")
    a = c.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), F.substring("column_name", 3, 99).alias("end"))
    own = F.contains("column_name", F.substring("table_name", 1, 3)) & (F.col("position") == 0)
    b = c.where(own).select(F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"), F.substring("column_name", 3, 99).alias("end"))
    return a.join(b, "end").where("from_table <> to_table").drop("end")


@query(
    "fk_expand",
    f"{_KEYS} SELECT table_name, bool_or(is_seed) AS is_seed FROM (SELECT 'orders' AS table_name, true AS is_seed UNION ALL SELECT to_table, false FROM k WHERE from_table = 'orders' "
    "UNION ALL SELECT from_table, false FROM k WHERE to_table = 'orders') GROUP BY table_name",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return catalog.neighbours(spark.createDataFrame([("orders",)], "table_name string"), _keys(spark, d))


_JOINED = (
    "SELECT count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey "
    "JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey = s.s_nationkey"
)


@query(
    "join_evidence",
    f"{_KEYS} SELECT left_table, left_column, right_table, right_column, EXISTS (SELECT 1 FROM k WHERE (from_table, from_column, to_table, to_column) = (left_table, left_column, right_table, right_column) "
    "OR (to_table, to_column, from_table, from_column) = (left_table, left_column, right_table, right_column)) AS backed FROM (VALUES ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), "
    "('customer', 'c_custkey', 'orders', 'o_custkey'), ('supplier', 's_suppkey', 'lineitem', 'l_suppkey'), (NULL, NULL, NULL, NULL)) AS t(left_table, left_column, right_table, right_column)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("lineitem", "orders", "customer", "supplier", "nation"))
    keys = _keys(spark, d).withColumn("key_name", F.concat_ws(".", "from_table", "from_column", "to_table"))
    return catalog.join_evidence(evidence.joins_of(spark, policy.require_read_query(spark, _JOINED)), keys)


@query(
    "linked_schema",
    f"{_KEYS}, f AS (SELECT 'orders' AS table_name, 0.9 AS score UNION ALL SELECT 'nation', 0.65 UNION ALL SELECT 'orders', 0.7), g AS (SELECT table_name, max(score)::DOUBLE AS score FROM f GROUP BY 1), "
    "w AS (SELECT table_name, bool_or(s) AS is_seed FROM (SELECT table_name, true AS s FROM g UNION ALL SELECT to_table, false FROM k JOIN g ON from_table = g.table_name "
    "UNION ALL SELECT from_table, false FROM k JOIN g ON to_table = g.table_name) GROUP BY 1) "
    "SELECT w.table_name, g.score, w.is_seed, (SELECT string_agg(column_name, '|' ORDER BY position) FROM c WHERE c.table_name = w.table_name) AS columns FROM w LEFT JOIN g USING (table_name)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    scored = lambda *rows: spark.createDataFrame(rows, "table_name string, score double")
    out = routing.linked_schema(scored(("orders", 0.9), ("gone", 1.0)), scored(("nation", 0.65)), scored(("orders", 0.7)), columns(spark, d), _keys(spark, d))
    return out.withColumn("columns", F.array_join("columns", "|"))


@query("metric_listing", f"{_C} SELECT m.metric, m.fact, m.aggregation, count(c.column_name) AS columns FROM (VALUES ('revenue', 'lineitem', 'sum'), ('line_count', 'lineitem', 'count'), ('mean_quantity', 'lineitem', 'avg'), ('least_discount', 'lineitem', 'min'), ('most_discount', 'lineitem', 'max'), ('order_total', 'orders', 'sum'), ('order_count', 'orders', 'count')) AS m(metric, fact, aggregation) JOIN c ON c.table_name = m.fact GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame([(m["metric"], m["table"], m["aggregation"]) for m in CATALOG.listing()], "metric string, fact string, aggregation string")
    return listed.join(columns(spark, d), F.col("fact") == F.col("table_name")).groupBy("metric", "fact", "aggregation").agg(F.count("*").alias("columns"))


@query("bounded_truncated", "SELECT 'orders' AS name, least(100, count(*)) AS n_rows, count(*) > 100 AS truncated FROM orders UNION ALL SELECT 'region', least(100, count(*)), count(*) > 100 FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    got = [(t, policy.bounded(table(spark, d, t), most=100)) for t in ("orders", "region")]
    return spark.createDataFrame([(t, len(x.rows), x.truncated) for t, x in got], "name string, n_rows long, truncated boolean")


_MESSAGES = ("Query timed out for {}", "Table not found: {}", "syntax error near {}", "type mismatch in {}", "no rows in {}", "disk full at {}", "Deadline for {}", "column {} does not exist")


@query(
    "error_classes",
    f"{_C}, m AS (SELECT replace([{', '.join(f'{chr(39)}{m}{chr(39)}' for m in _MESSAGES)}][position % {len(_MESSAGES)} + 1], '{{}}', column_name) AS message FROM c) SELECT message, "
    "CASE WHEN regexp_matches(lower(message), 'timed out|deadline') THEN 'timeout' WHEN regexp_matches(lower(message), 'not found|does not exist') THEN 'schema' WHEN contains(message, 'syntax') THEN 'syntax' "
    "WHEN contains(message, 'type') THEN 'type' WHEN contains(message, 'no rows') THEN 'empty' ELSE 'execution' END AS class FROM m",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _MESSAGES)), F.col("position") % len(_MESSAGES) + 1)
    x = columns(spark, d).select(F.replace(said, F.lit("{}"), F.col("column_name")).alias("message"))
    return x.select("message", validate.error_class_column(F.col("message")).alias("class"))


def _equal(a: str, b: str) -> str:
    return f"NOT EXISTS ({a} EXCEPT ALL {b}) AND NOT EXISTS ({b} EXCEPT ALL {a})"


_KEYS_OF_ORDERS = "SELECT o_custkey AS k, o_orderstatus AS s FROM orders"
_KEYS_BY_JOIN = "SELECT c_custkey AS k, o_orderstatus AS s FROM customer JOIN orders ON c_custkey = o_custkey"


@query(
    "eq_multiset",
    f"SELECT {_equal(_KEYS_OF_ORDERS, _KEYS_BY_JOIN)} AS same, {_equal(_KEYS_OF_ORDERS, f'SELECT DISTINCT * FROM ({_KEYS_OF_ORDERS})')} AS same_without_repeats, "
    f"{_equal(_KEYS_OF_ORDERS, f'(SELECT * FROM ({_KEYS_OF_ORDERS}) UNION ALL SELECT min(k), min(s) FROM ({_KEYS_OF_ORDERS}))')} AS same_with_one_more",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    y = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(x, "k")
    more = x.unionByName(x.agg(F.min("k").alias("k"), F.min("s").alias("s")))
    found = (evaluation.same_multiset(x, y), evaluation.same_multiset(x, x.distinct()), evaluation.same_multiset(x, more))
    return spark.createDataFrame([found], "same boolean, same_without_repeats boolean, same_with_one_more boolean")


@query(
    "term_documents",
    "SELECT 'glossary.shop.' || r_name || '.' || r_regionkey AS doc_id, '业务术语: ' || r_name || '.' || r_regionkey || '。(' || lower(r_name) || ')。' || CASE WHEN r_regionkey % 2 = 0 THEN 'SQL表达式: sum(x)。' ELSE '描述: b。' END || CASE WHEN r_regionkey > 2 THEN '关联表: t。' ELSE '' END AS text FROM region",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("r_regionkey") % 2 == 0
    terms = table(spark, d, "region").select(
        F.concat_ws(".", "r_name", "r_regionkey").alias("term"), F.lower("r_name").alias("english"), F.when(~even, "b").alias("description"),
        F.when(even, "sum(x)").alias("expression"), F.when(F.col("r_regionkey") > 2, "t").alias("table_name"),
    )
    return knowledge.term_documents(terms, "shop")


@query("generated_scale", "SELECT i AS id, 'table_' || (i % 10) AS name FROM range((SELECT count(*) FROM customer)) t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(table(spark, d, "customer").count()).select("id", F.concat(F.lit("table_"), F.col("id") % 10).alias("name"))
