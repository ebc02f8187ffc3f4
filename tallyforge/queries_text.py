"""Queries of question structure, knowledge, traces and gates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import questions
from tallyforge.operators import retrieval
from tallyforge.registry import query
from tallyforge.session import table

#: Questions and what they leave open where they aggregate, by hand.
_OPEN = (
    ("total click by region", "attribute"), ("total view per status and average of large orders", "attribute,aggregation,range"), ("sum of recently bought", "temporal"), ("total of the past 7 days", ""),
    ("percentage by type in the past", "attribute,aggregation,temporal"), ("high-value clients", "range"), ("count per user", ""), ("按地区统计平均金额", "attribute,aggregation"), ("最近的大额订单", "range,temporal"),
    ("最近7天的订单", ""), ("历史上的VIP客户", "range,temporal"), ("按状态", "attribute"), ("", ""),
)


@query(
    "ambiguity",
    f"SELECT event_id, aspects FROM (SELECT event_id, [{', '.join(f'{chr(39)}{q}{chr(39)}' for q, _ in _OPEN)}][event_id % {len(_OPEN)} + 1] AS q FROM events) "
    f"JOIN (VALUES {', '.join(f'({chr(39)}{q}{chr(39)}, {chr(39)}{o}{chr(39)})' for q, o in _OPEN)}) AS t(q, aspects) USING (q)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    q = F.element_at(F.array(*(F.lit(q) for q, _ in _OPEN)), (F.col("event_id") % len(_OPEN) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.array_join(questions.ambiguities(q, F.lit("AGGREGATE")), ",").alias("aspects"))


#: Questions and the orders that they ask for, by hand.
_ORDERED = (
    ("sales order by t.price desc", "t.price DESC"), ("users sorted by age ascending, please", "age ASC"), ("list items ordered by name", "name ASC"), ("the highest revenue, then the lowest cost", "revenue DESC, cost ASC"),
    ("sort by day desc and sort by day", "day DESC"), ("Order By Total DESCENDING;", "Total DESC"), ("order by city; sort by zip asc", "zip ASC, city ASC"), ("nothing to sort", ""),
    ("按销售额降序", "销售额 DESC"), ("按照 地区 排序", "地区 ASC"), ("销量最高", "销量 DESC"), ("价格最低", "价格 ASC"), ("", ""),
)


@query(
    "order_extract",
    f"SELECT event_id, ordering FROM (SELECT event_id, [{', '.join(f'{chr(39)}{q}{chr(39)}' for q, _ in _ORDERED)}][event_id % {len(_ORDERED)} + 1] AS q FROM events) "
    f"JOIN (VALUES {', '.join(f'({chr(39)}{q}{chr(39)}, {chr(39)}{o}{chr(39)})' for q, o in _ORDERED)}) AS t(q, ordering) USING (q)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    q = F.element_at(F.array(*(F.lit(q) for q, _ in _ORDERED)), (F.col("event_id") % len(_ORDERED) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.array_join(questions.orders(q), ", ").alias("ordering"))


@query(
    "absolute_periods",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(date_trunc(CASE o_orderkey % 3 WHEN 1 THEN 'month' ELSE 'quarter' END, o_orderdate) AS DATE) END AS period_start, "
    "CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) + 1 WHEN 1 THEN CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) "
    "ELSE CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) END AS period_end FROM orders",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM"))
    text = F.concat(F.lit("sales in "), text.otherwise(F.concat(F.year(day), F.lit(" Q"), F.quarter(day))))
    x = table(spark, d, "orders").select("o_orderkey", questions.absolute_period(text).alias("p"))
    return x.select("o_orderkey", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


@query("sql_extract", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN 'select a from t' END AS sql FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    answer = F.expr("CASE event_id % 3 WHEN 0 THEN 'Here:\\n```sql\\nSELECT 1;\\n```' WHEN 1 THEN 'Use select a from t;' ELSE 'none' END")
    return table(spark, d, "events").select("event_id", questions.sql_of(answer).alias("sql"))


@query(
    "knowledge_hits",
    "SELECT doc_id, round((contains(lower(text), 'licensed')::INT + contains(lower(text), 'version')::INT + contains(lower(text), 'password')::INT) / 3, 4) AS relevance FROM documents",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("licensed", "version", "password", "x")))
    return table(spark, d, "documents").select("doc_id", questions.word_hits(words, F.col("text")).alias("relevance"))


@query("approved_rules", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'regex' WHEN contains(event_type, 'ie') THEN 'substring' END AS rule FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, d, "events").select("event_id", F.when(t.rlike("^cl[a-z]+k$"), "regex").when(t.contains("ie"), "substring").alias("rule"))


@query("trace_stats", "SELECT event_type AS node, count(*) AS runs, round(avg(value), 6) AS mean_ms, quantile_disc(value, 0.5) AS p50, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("node")).agg(
        F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean_ms"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


@query("pilot_gate", "SELECT arm, n, mean_value, n >= 100 AND missing = 0 AND mean_value < 60 AS passed FROM (SELECT user_id % 5 AS arm, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS missing, round(avg(value), 6) AS mean_value FROM events GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("arm"))
    x = x.agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.round(F.avg("value"), 6).alias("mean_value"))
    return x.select("arm", "n", "mean_value", ((F.col("n") >= 100) & (F.col("missing") == 0) & (F.col("mean_value") < 60)).alias("passed"))


@query("deployment_review", "SELECT tenant, peak, peak <= 15 AS within FROM (SELECT tenant, max(n) AS peak FROM (SELECT user_id % 10 AS tenant, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("tenant"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return x.groupBy("tenant").agg(F.max("n").alias("peak")).withColumn("within", F.col("peak") <= 15)


@query("global_stats", "SELECT count(*) AS pairs, count(DISTINCT user_id) AS domains, count(*) FILTER (WHERE event_id % 6 >= 4) AS approved, round(avg(event_id % 6), 6) AS rating FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    rating = F.col("event_id") % 6
    return table(spark, d, "events").agg(
        F.count("*").alias("pairs"), F.count_distinct("user_id").alias("domains"), F.count_if(rating >= 4).alias("approved"), F.round(F.avg(rating), 6).alias("rating")
    )


@query("training_export", "SELECT event_id, event_id % 6 AS rating FROM events WHERE event_id % 6 >= 4 ORDER BY rating DESC, event_id LIMIT 200")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", (F.col("event_id") % 6).alias("rating")).where("rating >= 4")
    return x.orderBy(F.col("rating").desc(), "event_id").limit(200)


@query("fingerprints", "SELECT o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.to_json(F.struct("o_custkey", "o_orderstatus")), 256).alias("fingerprint"))
