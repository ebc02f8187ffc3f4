"""Registered queries of the engine: name to (spark, sf_dir) -> DataFrame, with SQL twins."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import text as tx
from tallyforge.functions.patterns import LIMITS_ANY, LIMITS_EN, LIMITS_ZH
from tallyforge.operators import catalog, evaluation, learning, retrieval
from tallyforge.plans import formulas, metrics, policy, validate
from tallyforge.registry import QUERIES, SQL, query
from tallyforge.session import RECURSION_ROWS, register, table

CATALOG = metrics.load_catalog(
    json.dumps(
        {
            "version": "1",
            "metrics": [
                *(
                    {"name": n, "table": "lineitem", "column": c, "aggregation": a, "dimensions": ["l_returnflag", "l_linestatus"], "date_column": "ship_date",
                     "lookup": {"fact_key": "l_orderkey", "table": "orders", "key": "o_orderkey", "dimensions": {"priority": "o_orderpriority", "order_status": "o_orderstatus"}}}
                    for n, c, a in (
                        ("revenue", "l_extendedprice", "sum"), ("line_count", "*", "count"), ("mean_quantity", "l_quantity", "avg"),
                        ("least_discount", "l_discount", "min"), ("most_discount", "l_discount", "max"),
                    )
                ),
                *(
                    {"name": n, "table": "orders", "column": c, "aggregation": a, "dimensions": ["o_orderstatus", "o_orderpriority"], "date_column": "order_date",
                     "lookup": {"fact_key": "o_custkey", "table": "customer", "key": "c_custkey", "dimensions": {"segment": "c_mktsegment"}}}
                    for n, c, a in (("order_total", "o_totalprice", "sum"), ("order_count", "*", "count"))
                ),
            ],
        }
    )
)


def _facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "lineitem": table(spark, d, "lineitem").withColumn("ship_date", F.to_date("l_shipdate")),
        "orders": table(spark, d, "orders").withColumn("order_date", F.to_date("o_orderdate")),
        "customer": table(spark, d, "customer"),
    }


def _metric(name: str, sql: str, digits: dict[str, int] | None = None, **selection) -> None:
    """A metric query: the compiled selection with doubles rounded."""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = metrics.compile_selection(CATALOG, metrics.Selection(**selection), _facts(spark, d))
        for c, n in (digits or {}).items():
            out = out.withColumn(c, F.round(c, n))
        return out


_metric("metric_sum", "SELECT round(sum(l_extendedprice), 2) AS revenue FROM lineitem", {"revenue": 2}, metrics=("revenue",))
_metric("metric_count", "SELECT count(*) AS line_count FROM lineitem", metrics=("line_count",))
_metric("metric_avg", "SELECT round(avg(l_quantity), 6) AS mean_quantity FROM lineitem", {"mean_quantity": 6}, metrics=("mean_quantity",))
_metric("metric_min", "SELECT min(l_discount) AS least_discount FROM lineitem", metrics=("least_discount",))
_metric("metric_max", "SELECT max(l_discount) AS most_discount FROM lineitem", metrics=("most_discount",))
_metric(
    "metric_multi",
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS revenue, count(*) AS line_count, round(avg(l_quantity), 6) AS mean_quantity "
    "FROM lineitem GROUP BY 1, 2",
    {"revenue": 2, "mean_quantity": 6}, metrics=("revenue", "line_count", "mean_quantity"), dimensions=("l_returnflag", "l_linestatus"),
)
_metric(
    "metric_dims", "SELECT o_orderstatus, o_orderpriority, count(*) AS order_count FROM orders GROUP BY 1, 2",
    metrics=("order_count",), dimensions=("o_orderstatus", "o_orderpriority"),
)
_metric(
    "metric_filter", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS order_total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    {"order_total": 2}, metrics=("order_total",), dimensions=("o_orderpriority",), filters=(("o_orderstatus", "F"),),
)
for _g in metrics.GRAINS:
    _metric(
        f"metric_grain_{_g}",
        f"SELECT CAST(date_trunc('{_g}', o_orderdate) AS DATE) AS period_start, count(*) AS order_count FROM orders GROUP BY 1",
        metrics=("order_count",), grain=_g,
    )
_metric(
    "metric_lookup_left",
    "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, o_orderpriority AS priority, round(sum(l_extendedprice), 2) AS revenue, "
    "count(*) AS line_count FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1, 2",
    {"revenue": 2}, metrics=("revenue", "line_count"), dimensions=("priority",), filters=(("l_linestatus", "F"),), grain="month",
)
_metric(
    "metric_lookup_filter",
    "SELECT o_orderstatus, count(*) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
    metrics=("order_count",), dimensions=("o_orderstatus",), filters=(("segment", "BUILDING"),),
)
_metric(
    "metric_lookup_elided", "SELECT o_orderstatus, count(*) AS order_count FROM orders GROUP BY 1", metrics=("order_count",), dimensions=("o_orderstatus",)
)


def _formula(name: str, sql: str, fact: str, formula: str, **asked) -> None:
    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        time_column = {"events": "ts", "orders": "o_orderdate"}[fact]
        return formulas.query_metrics(table(spark, d, fact), [formulas.FormulaMetric("value", formula, time_column)], **asked)


_formula(
    "formula_ratio", "SELECT event_type, round(sum(value) / count(*), 6) AS value FROM events GROUP BY 1", "events", "round(sum(value) / count(*), 6)",
    dimensions=["event_type"],
)
_formula(
    "formula_case", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS value FROM orders GROUP BY 1",
    "orders", "sum(case when o_orderstatus = 'F' then 1 else 0 end)", dimensions=["o_orderpriority"],
)
_formula(
    "formula_top", "SELECT o_orderpriority, count(*) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "orders", "count(*)", dimensions=["o_orderpriority"], filters={"o_orderstatus": "O"}, order_by=[("value", True), ("o_orderpriority", False)], limit=3,
)
for _g in formulas.GRAINS:
    _formula(
        f"formula_{_g}", f"SELECT CAST(date_trunc('{_g}', ts) AS TIMESTAMP) AS period, count(*) AS value FROM events GROUP BY 1", "events", "count(*)", grain=_g
    )


def _sql(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query of the relational surface: through the read-only gate, then Spark SQL."""

    @query(name, duck_sql or spark_sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark, d, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
        spark.conf.set(*RECURSION_ROWS)
        return spark.sql(policy.require_read_query(spark, spark_sql))


_sql("sql_select", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
_sql("sql_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
_sql("sql_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
_sql("sql_between", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 1000")
_sql("sql_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1'")
_sql("sql_ilike", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'bui%'")
_sql("sql_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
_sql("sql_coalesce", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
_sql("sql_join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("sql_join_left_zero", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("sql_semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
_sql("sql_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_sql("sql_anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
_sql("sql_cross_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a CROSS JOIN nation b WHERE a.n_nationkey < b.n_nationkey")
_sql("sql_scalar_sub", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
_sql("sql_derived", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 12")
_sql("sql_cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
_sql(
    "sql_recursive",
    "WITH RECURSIVE t(k, n) AS (SELECT o_orderkey, 1 FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT k, n * 2 FROM t WHERE n < 8) SELECT k, n FROM t",
)
_sql("sql_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_sql("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14")
_sql("sql_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")
_sql(
    "sql_cond_agg", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_custkey",
)
_sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql(
    "sql_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r FROM orders",
)
_sql("sql_dense_rank", "SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS BIGINT) AS r FROM lineitem")
_sql("sql_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS r FROM orders")
_sql("sql_lag", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
_sql("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
_sql("sql_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
_sql("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
_sql("sql_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 8500")
_sql(
    "sql_date_functions", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
)
_sql(
    "sql_null_keys",  # NULL meets no NULL in a join; IS NOT DISTINCT FROM does
    "WITH a AS (SELECT l_returnflag AS k, count(*) AS n FROM (SELECT NULLIF(l_returnflag, 'N') AS l_returnflag FROM lineitem) GROUP BY l_returnflag) "
    "SELECT x.k, x.n, count(y.n) AS met, count(z.n) AS met_null FROM a x LEFT JOIN a y ON x.k = y.k LEFT JOIN a z ON x.k IS NOT DISTINCT FROM z.k GROUP BY x.k, x.n",
)
_sql(
    "sql_null_groups",  # NULLs form one group, are left out of count(column) and avg, and make NOT IN unknown
    "SELECT NULLIF(event_type, 'click') AS kind, count(*) AS n, count(NULLIF(event_type, 'click')) AS named, sum(CASE WHEN NULLIF(event_type, 'click') NOT IN ('view') THEN 1 ELSE 0 END) AS other FROM events GROUP BY 1",
    "SELECT NULLIF(event_type, 'click') AS kind, count(*) AS n, count(NULLIF(event_type, 'click')) AS named, CAST(sum(CASE WHEN NULLIF(event_type, 'click') NOT IN ('view') THEN 1 ELSE 0 END) AS BIGINT) AS other FROM events GROUP BY 1",
)
_sql("sql_typeof_printf", "SELECT n_nationkey, lower(typeof(n_nationkey)) AS kind, printf('%05d|%s', n_nationkey, n_name) AS line FROM nation".replace("typeof(n_nationkey)", "typeof(CAST(n_nationkey AS BIGINT))"))
_sql(
    "sql_string_agg", "SELECT n_regionkey, string_agg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
_sql("sql_abs", "SELECT c_custkey, abs(c_acctbal) AS size, abs(c_custkey - 100) AS away FROM customer")
_sql("sql_round", "SELECT o_orderkey, round(o_totalprice / 3, 2) AS third FROM orders")


@query("validation_score", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE greatest(0.5, round(1 - 0.05 * (o_orderkey % 7) - 0.02 * (o_custkey % 11), 4)) END::DOUBLE AS score FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    score = validate.score_column(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 7, F.col("o_custkey") % 11)
    return table(spark, d, "orders").select("o_orderkey", F.round(score, 4).alias("score"))




_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([{}], w))".format(
    ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
)


@query("tokenize_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.explode(F.array_distinct(tx.english_tokens(F.col("text")))).alias("term"))
    return x.groupBy("term").agg(F.count("*").alias("df"))


_TERMS = ["licensed", "version", "heon"]


def _bm25_sql(where: str, k: int, terms: list[str] = _TERMS) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return (
        f"WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE {where}), n AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d), "
        f"p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN ({names}) GROUP BY ALL), "
        "f AS (SELECT term, count(*) AS df FROM p GROUP BY term) "
        "SELECT p.doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.t) / n.m))), 6) AS score "
        f"FROM p JOIN f USING (term) JOIN d USING (doc_id), n GROUP BY p.doc_id ORDER BY score DESC, p.doc_id LIMIT {k}"
    )


_VECTOR = [((i * 37) % 11 - 5) / 8.0 for i in range(64)]
_COS = f"round(1 - list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, _VECTOR))}]::DOUBLE[]), 6)"
_COS_SQL = "SELECT vec_id, distance, round(1 / (1 + distance), 6) AS score FROM (SELECT vec_id, {} AS distance FROM embeddings WHERE {}) ORDER BY distance, vec_id LIMIT {}"


@query("cosine_topk", _COS_SQL.format(_COS, "true", 20))
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cosine_top(table(spark, d, "embeddings"), _VECTOR, 20)


@query("cosine_filtered", _COS_SQL.format(_COS, "label = 3", 10))
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cosine_top(table(spark, d, "embeddings"), _VECTOR, 10, F.col("label") == 3)


@query(
    "chunk_windows",
    "SELECT doc_id, chunk::INTEGER AS chunk, substring(text, chunk * 1792 + 1, 2048) AS text FROM (SELECT doc_id, text, "
    "unnest(range(0, greatest(1, ceil((length(text) - 256) / 1792.0)::BIGINT))) AS chunk FROM documents WHERE length(text) > 0)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunk_windows(table(spark, d, "documents"))


@query("lang_detect", "SELECT doc_id, CASE WHEN n = 0 THEN 'en' WHEN c / n > 0.5 THEN 'zh' WHEN c / n > 0.1 THEN 'mixed' ELSE 'en' END AS language FROM (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS n, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS c FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.language(F.col("text")).alias("language"))


@query("token_estimate", "SELECT doc_id, CAST(floor(a / 4.0 + (n - a) / 1.5) AS BIGINT) AS tokens FROM (SELECT doc_id, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x08\\x0E-\\x1B\\x21-\\x7F]', '', 'g')) AS a FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("compact_text", "SELECT doc_id, CASE WHEN length(text) <= 205 THEN text ELSE left(text, 100) || chr(10) || '...' || chr(10) || right(text, 100) END AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.compact(F.col("text"), 205).alias("text"))


#: Questions in many phrasings; events take them in turn.
_PHRASES = (
    "show the top 5 products yesterday", "count orders last month", "compare sales this week and last week", "list 20 records of the last 30 days", "how many users this quarter",
    "join orders and customers over the past 3 months", "monthly trend of revenue year to date", "funnel conversion mtd", "retention qtd", "total by region, same period last year",
    "what was sold the day before yesterday?", "deliveries the day after tomorrow", "plan for next week", "budget of next quarter", "forecast next year", "sales 3 weeks ago",
    "orders 2 months ago", "signups 5 days ago limit 7", "revenue 2 years ago", "shipments in the next 10 days", "bookings for the next 2 weeks", "targets for the next 6 months",
    "tomorrow first 3 rows", "today's growth", "last 4 weeks of churn", "past 2 years breakdown", "no time here at all", "查询昨天的订单", "统计上个月各个地区的销售额", "对比本周和上周", "去年同期的趋势",
    "最近7天的转化率", "未来2周", "3个月前的订单", "2024年3月5日的收入", "2025年11月 合计", "第三季度 汇总", "今年以来 top 8", "后天", "plain 查询 last week 订单", "",
    "前10名客户的订单", "取前 5 条记录", "只要3笔", "限制 20 行", "限量7", "客户 前 12 的销售额 top 4",
)
_QUOTED = ", ".join("'" + x.replace("'", "''") + "'" for x in _PHRASES)
_QUESTION = f"[{_QUOTED}][event_id % {len(_PHRASES)} + 1]"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("event_id") % len(_PHRASES) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", asked.alias("question"))


def _score_sql(intent: str) -> str:
    zh, en, both = tx.INTENTS[intent]
    hits = lambda patterns, when: [f"(CASE WHEN {when} AND regexp_matches(q, '{p}') THEN {w} ELSE 0 END)" for p, w in patterns]
    return " + ".join(hits(zh, "lang <> 'en'") + hits(en, "lang <> 'zh'") + hits(both, "true"))


_LANG = (
    "CASE WHEN length(regexp_replace(q, '\\s', '', 'g')) = 0 THEN 'en' WHEN length(regexp_replace(q, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / length(regexp_replace(q, '\\s', '', 'g')) > 0.5 THEN 'zh' "
    "WHEN length(regexp_replace(q, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / length(regexp_replace(q, '\\s', '', 'g')) > 0.1 THEN 'mixed' ELSE 'en' END"
)
_ASKED = f"(SELECT event_id, q, {_LANG} AS lang FROM (SELECT event_id, lower({_QUESTION}) AS q FROM events))"


@query(
    "intent",
    f"WITH s AS (SELECT event_id, {', '.join(f'{_score_sql(i)} AS s_{i}' for i in tx.PRIORITY)} FROM {_ASKED}), "
    f"m AS (SELECT *, greatest({', '.join(f's_{i}' for i in tx.PRIORITY)}) AS most FROM s) "
    f"SELECT event_id, CASE WHEN most = 0 THEN 'UNKNOWN' {' '.join(f'WHEN s_{i} = most THEN {chr(39)}{i}{chr(39)}' for i in tx.PRIORITY)} END AS intent FROM m",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("event_id", tx.intent(F.col("question")).alias("intent"))


_LIMITS = [" || ".join(f"regexp_extract_all(q, '{p}', 1)" for p in x) for x in (LIMITS_ZH, LIMITS_EN, LIMITS_ANY)]


@query(
    "limit_extract",
    f"SELECT event_id, list_min(list_transform((CASE WHEN lang <> 'en' THEN {_LIMITS[0]} ELSE [] END) || (CASE WHEN lang <> 'zh' THEN {_LIMITS[1]} ELSE [] END) || {_LIMITS[2]}, lambda x: x::BIGINT)) AS row_limit FROM {_ASKED}",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("event_id", tx.limit_value(F.col("question")).alias("row_limit"))


_NOW = "2026-07-15"


#: First day and day after the last by name, for a reference date d and a number n, as DuckDB has them.
_SPANS = {
    "day_before_yesterday": ("d - 2", "d - 1"), "yesterday": ("d - 1", "d"), "today": ("d", "d + 1"), "day_after_tomorrow": ("d + 2", "d + 3"), "tomorrow": ("d + 1", "d + 2"),
    "this_week": ("date_trunc('week', d)", "d + 1"), "last_week": ("date_trunc('week', d) - INTERVAL 7 DAY", "date_trunc('week', d)"),
    "next_week": ("date_trunc('week', d) + INTERVAL 7 DAY", "date_trunc('week', d) + INTERVAL 14 DAY"),
    **{f"this_{u}": (f"date_trunc('{u}', d)", "d + 1") for u in ("month", "quarter", "year")},
    **{f"last_{u}": (f"date_trunc('{u}', date_trunc('{u}', d) - INTERVAL 1 DAY)", f"date_trunc('{u}', d)") for u in ("month", "quarter", "year")},
    "next_month": ("date_trunc('month', d) + INTERVAL 1 MONTH", "date_trunc('month', d) + INTERVAL 2 MONTH"),
    "next_quarter": ("date_trunc('quarter', d) + INTERVAL 3 MONTH", "date_trunc('quarter', d) + INTERVAL 6 MONTH"),
    "next_year": ("date_trunc('year', d) + INTERVAL 1 YEAR", "date_trunc('year', d) + INTERVAL 2 YEAR"),
    "same_period_last_year": ("d - INTERVAL 1 YEAR", "d + 1"), "ytd": ("date_trunc('year', d)", "d + 1"), "qtd": ("date_trunc('quarter', d)", "d + 1"), "mtd": ("date_trunc('month', d)", "d + 1"),
    "last_n_days": ("d - n", "d + 1"), "last_n_weeks": ("d - 7 * n", "d + 1"), "last_n_months": ("d - to_months(n)", "d + 1"), "last_n_years": ("d - to_years(n)", "d + 1"),
    "n_days_ago": ("d - n", "d - n + 1"), "n_weeks_ago": ("d - 7 * n", "d - 7 * n + 7"), "n_months_ago": ("date_trunc('month', d - to_months(n))", "date_trunc('month', d - to_months(n)) + INTERVAL 1 MONTH"),
    "n_years_ago": ("date_trunc('year', d - to_years(n))", "date_trunc('year', d - to_years(n)) + INTERVAL 1 YEAR"),
    "next_n_days": ("d", "d + n + 1"), "next_n_weeks": ("d", "d + 7 * n + 1"), "next_n_months": ("d", "(d + to_months(n)) + INTERVAL 1 DAY"),
    "absolute_ymd": ("make_date(n, m, k)", "make_date(n, m, k) + 1"), "absolute_ym": ("make_date(n, m, 1)", "make_date(n, m, 1) + INTERVAL 1 MONTH"),
    "absolute_quarter": ("make_date(year(d)::INT, 3 * n - 2, 1)", "make_date(year(d)::INT, 3 * n - 2, 1) + INTERVAL 3 MONTH"),
}


def _spans_sql(side: int) -> str:
    """The CASE over all patterns that gives one side of the span, reading its numbers from the text."""
    whens = []
    for spoken, patterns in (("zh", tx.TIMES_ZH), ("en", tx.TIMES_EN)):
        for name, p in patterns:
            value = _SPANS[name][side]
            number = lambda i, p=p: f"TRY_CAST(translate(regexp_extract(q, '{p}', {i}), '一二三四', '1234') AS INT)"
            for i, letter in enumerate("nmk", 1):
                value = re.sub(rf"\b{letter}\b", lambda _, i=i: number(i), value) if i <= p.replace("(?", "").count("(") else value
            whens.append(f"WHEN lang <> '{'en' if spoken == 'zh' else 'zh'}' AND regexp_matches(q, '{p}') THEN CAST({value} AS DATE)")
    return f"CASE {' '.join(whens)} END"


@query(
    "time_ranges",
    f"SELECT event_id, {_spans_sql(0)} AS range_start, {_spans_sql(1)} AS range_end FROM (SELECT *, DATE '{_NOW}' AS d FROM {_ASKED})",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = _questions(spark, d).select("event_id", tx.time_range(F.col("question"), _NOW).alias("r"))
    return x.select("event_id", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@query(
    "rank_metrics",
    "WITH rel AS (SELECT DISTINCT d.lang AS query, l.doc_id AS id FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1), "
    "ranked AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents), "
    "h AS (SELECT query, count(*) AS hits, min(r) AS first, sum(1 / log2(r + 1)) AS dcg FROM ranked JOIN rel USING (query, id) WHERE r <= 10 GROUP BY query), "
    "n AS (SELECT query, count(*) AS n FROM rel GROUP BY query) "
    "SELECT query, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(hits / 10, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr, "
    "round(coalesce(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(10, n) + 1)]), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    rel = table(spark, d, "labels").where("quality = 1").join(docs, "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"))
    w = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), "rank")
    return evaluation.ranking_metrics(ranked, rel, 10)


_WILSON = (
    "SELECT {k}, n, s, round(greatest(0, (s/n + 3.8414588206941254/(2*n)) / (1 + 3.8414588206941254/n) - 1.959963984540054 * sqrt((s/n*(1-s/n) + 3.8414588206941254/(4*n))/n) / (1 + 3.8414588206941254/n)), 6) AS low, "
    "round(least(1, (s/n + 3.8414588206941254/(2*n)) / (1 + 3.8414588206941254/n) + 1.959963984540054 * sqrt((s/n*(1-s/n) + 3.8414588206941254/(4*n))/n) / (1 + 3.8414588206941254/n)), 6) AS high FROM "
    "(SELECT {k}, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS s FROM orders GROUP BY 1)"
)


@query("wilson", _WILSON.format(k="o_orderpriority"))
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("s"))
    low, high = evaluation.wilson(F.col("s"), F.col("n"))
    return x.select("o_orderpriority", "n", "s", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("hoeffding", "SELECT o_orderpriority, n, round(greatest(0, m - sqrt(ln(40) / (2 * n))), 6) AS low, round(least(1, m + sqrt(ln(40) / (2 * n))), 6) AS high FROM (SELECT o_orderpriority, count(*) AS n, avg((o_custkey % 10) / 10.0::DOUBLE) AS m FROM orders GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg(F.col("o_custkey") % 10 / 10.0).alias("m"))
    low, high = evaluation.hoeffding(F.col("m"), F.col("n"))
    return x.select("o_orderpriority", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("slices", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS good FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    x = table(spark, d, "orders").groupingSets([[s], [p], []], s, p)
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("good"))


@query("latency_pct", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.exact_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("capacity_metrics", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.95) AS p95, count(DISTINCT user_id) AS users FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.avg("value"), 6).alias("mean_value"),
        *evaluation.nearest_rank("value", {"p95": 0.95}), F.count_distinct("user_id").alias("users"),
    )


@query("slo_by_tenant", "SELECT user_id % 10 AS tenant, count(*) AS n, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.95) <= 100 AS met FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("tenant", F.col("user_id") % 10)
    p = evaluation.exact_percentiles(x, ["tenant"], "value", {"p95": 0.95}).withColumn("met", F.col("p95") <= 100)
    n = x.groupBy("tenant").agg(F.count("*").alias("n"))
    return n.join(p.withColumnRenamed("tenant", "t"), F.col("tenant").eqNullSafe(F.col("t"))).drop("t")


@query("paired_outcomes", "SELECT CASE WHEN a AND b THEN 'both' WHEN b THEN 'improved' WHEN a THEN 'regressed' ELSE 'neither' END AS outcome, count(*) AS n FROM (SELECT o_custkey % 3 > 0 AS a, o_orderstatus = 'F' AS b FROM orders) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    a = x.select("o_orderkey", (F.col("o_custkey") % 3 > 0).alias("good"))
    return evaluation.paired(a, x.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("good")), "o_orderkey", "good")


_USAGE = "SELECT user_id % 5 AS team, event_type AS model, CASE WHEN event_id % 97 <> 0 THEN event_id % 1000 END AS prompt_tokens, event_id % 300 AS completion_tokens FROM events"


@query("cost_estimate", f"WITH u AS ({_USAGE}), p AS (SELECT * FROM (VALUES ('click', 1.25, 10.0), ('view', 0.5, 1.5), ('purchase', 3.0, 15.0)) AS t(model, pp, cp)) SELECT team, count(*) AS calls, CASE WHEN count(*) = count(prompt_tokens * pp + completion_tokens * cp) THEN CAST(sum(prompt_tokens * pp + completion_tokens * cp) / 1000000 AS DOUBLE) END AS cost, count(*) FILTER (WHERE pp IS NULL) AS no_price, count(*) FILTER (WHERE prompt_tokens IS NULL OR completion_tokens IS NULL) AS no_usage FROM u LEFT JOIN p USING (model) GROUP BY team")
def _(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("events",))
    prices = spark.sql("SELECT * FROM VALUES ('click', 1.25BD, 10.0BD), ('view', 0.5BD, 1.5BD), ('purchase', 3.0BD, 15.0BD) AS t(model, prompt_price, completion_price)")
    return evaluation.cost(spark.sql(_USAGE), prices, ["model"], "team")


@query("usage_totals", f"SELECT team, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(count(prompt_tokens) / count(*), 6) AS coverage FROM ({_USAGE}) GROUP BY team")
def _(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("events",))
    return spark.sql(_USAGE).groupBy("team").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.count("prompt_tokens") / F.count("*"), 6).alias("coverage"),
    )


_FEEDBACK = "SELECT event_id, user_id, ts, CAST(event_id % 6 AS INT) AS rating, event_id % 4 <> 0 AS ok, event_id % 13 = 0 AS cancelled, event_id % 5 AS edits FROM events"


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("events",))
    return spark.sql(_FEEDBACK)


@query("feedback_stats", f"SELECT count(*) AS total, round(avg(rating) FILTER (WHERE rating > 0), 6) AS avg_rating, round(avg(ok::INT), 6) AS ok_share, round(avg(cancelled::INT), 6) AS cancel_share, round(avg(edits), 6) AS avg_edits FROM ({_FEEDBACK})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return learning.feedback_stats(_feedback(spark, d))


@query("feedback_hist", f"SELECT rating, count(*) AS n FROM ({_FEEDBACK}) GROUP BY rating")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _feedback(spark, d).groupBy("rating").agg(F.count("*").alias("n"))


@query("feedback_recent", f"SELECT event_id, rating FROM ({_FEEDBACK}) WHERE rating >= 4 ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _feedback(spark, d).where("rating >= 4").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "rating")


@query("quality_daily", f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(rating) / 5, 6) AS quality FROM ({_FEEDBACK}) WHERE rating > 0 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = _feedback(spark, d).where("rating > 0").groupBy(F.to_date("ts").alias("day"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg("rating") / 5, 6).alias("quality"))


@query("pair_upsert", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = learning.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return x.select("user_id", "event_type", "event_id")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query(
    "jaccard_topk",
    f"WITH q AS (SELECT {_WORDS.format('text')} AS w FROM benchmark WHERE item_id = 0), t AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) "
    "SELECT item_id, round(len(list_intersect(t.w, q.w)) / len(list_distinct(list_concat(t.w, q.w))), 6) AS similarity FROM t, q ORDER BY similarity DESC, item_id LIMIT 10",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "benchmark").select("item_id", learning.words_set(F.col("text")).alias("w"))
    q = x.where("item_id = 0").select(F.col("w").alias("q")).limit(1)
    x = x.crossJoin(F.broadcast(q)).select("item_id", F.round(learning.jaccard(F.col("w"), F.col("q")), 6).alias("similarity"))
    return x.orderBy(F.col("similarity").desc(), "item_id").limit(10)


@query(
    "lifecycle",
    "SELECT event_id, CASE WHEN t <> 'active' AND score >= 0.8 AND age < 14 THEN 'active' ELSE t END AS state FROM (SELECT *, CASE WHEN s = 'active' AND ((k = 'schema' AND age > 7) OR (k = 'sql' AND age > 30)) THEN 'stale' "
    "WHEN s = 'stale' AND age > 90 THEN 'archived' ELSE s END AS t FROM (SELECT event_id, ['active', 'stale', 'archived'][event_id % 3 + 1] AS s, ['schema', 'sql', 'term', 'rule'][event_id % 4 + 1] AS k, "
    "event_id % 113 AS age, (event_id % 11) / 10.0 AS score FROM events))",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (e % len(names) + 1).cast("int"))
    state, kind = pick("active", "stale", "archived"), pick("schema", "sql", "term", "rule")
    return table(spark, d, "events").select("event_id", learning.lifecycle(state, kind, e % 113, e % 11 / 10.0).alias("state"))


@query("rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS attempts FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return learning.attempt_rate(table(spark, d, "events"), "user_id", "ts").select("event_id", "attempts")


@query("router_history", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return learning.latest(x, ["user_id"], [F.col("n").desc(), F.col("event_type")])




_NAMES = ("BUILDING", "Building", "build", "the automobile industry", "customer#0000", "n", "households")


@query(
    "name_match",
    "SELECT c_custkey, CASE WHEN name = asked THEN 1.0 WHEN lower(name) = lower(asked) THEN 0.95 WHEN contains(lower(note), lower(asked)) THEN 0.75 WHEN contains(lower(name), lower(asked)) THEN 0.65 "
    "WHEN contains(lower(asked), lower(name)) THEN 0.6 ELSE 0.0 END::DOUBLE AS score, CASE WHEN name = asked THEN 1.0 WHEN lower(name) = lower(asked) THEN 0.95 WHEN contains(lower(note), lower(asked)) THEN 0.7 "
    "WHEN contains(lower(name), lower(asked)) OR contains(lower(asked), lower(name)) THEN 0.65 ELSE 0.0 END::DOUBLE AS table_score "
    f"FROM (SELECT c_custkey, c_mktsegment AS name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS note, [{', '.join(f'{chr(39)}{n}{chr(39)}' for n in _NAMES)}][c_custkey % {len(_NAMES)} + 1] AS asked FROM customer)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % len(_NAMES) + 1).cast("int"))
    note = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    score = lambda of_table: catalog.name_score(F.col("c_mktsegment"), note, asked, of_table)
    return table(spark, d, "customer").select("c_custkey", score(False).alias("score"), score(True).alias("table_score"))


@query("window_tumbling", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


from tallyforge import queries_catalog, queries_knowledge, queries_routing, queries_search, queries_text, queries_words  # noqa: E402, F401  (register more queries)

__all__ = ["CATALOG", "QUERIES", "SQL"]
