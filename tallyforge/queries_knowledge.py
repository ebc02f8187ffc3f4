"""Queries of terms, rules, upkeep, catalog searches and evidence, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import questions
from tallyforge.operators import catalog, knowledge
from tallyforge.registry import query
from tallyforge.session import shared_folder, table
from tallyforge.streaming.sinks import LedgerSink

_NOW = "2024-05-15"
_N = "(event_id % 9 + 1)"
_WHEN = (
    f"concat('sales ', CASE event_id % 8 WHEN 0 THEN concat({_N}, ' days ago') WHEN 1 THEN concat({_N}, ' weeks ago') WHEN 2 THEN concat({_N}, ' months ago') "
    f"WHEN 3 THEN concat({_N}, ' years ago') WHEN 4 THEN concat('next ', {_N}, ' days') WHEN 5 THEN concat('next ', {_N}, ' weeks') "
    f"WHEN 6 THEN concat('next ', {_N}, ' months') ELSE 'by region' END)"
)
_DAY = f"DATE '{_NOW}'"


@query(
    "shifted_ranges",
    f"WITH e AS (SELECT event_id, event_id % 8 AS k, {_N}::INT AS n FROM events) SELECT event_id, CAST(CASE k WHEN 0 THEN {_DAY} - n WHEN 1 THEN {_DAY} - 7 * n "
    f"WHEN 2 THEN DATE '2024-05-01' - to_months(n) WHEN 3 THEN DATE '2024-01-01' - to_years(n) WHEN 7 THEN NULL ELSE {_DAY} END AS DATE) AS range_start, "
    f"CAST(CASE k WHEN 0 THEN {_DAY} - n + 1 WHEN 1 THEN {_DAY} - 7 * n + 7 WHEN 2 THEN DATE '2024-06-01' - to_months(n) WHEN 3 THEN DATE '2025-01-01' - to_years(n) "
    f"WHEN 4 THEN {_DAY} + n + 1 WHEN 5 THEN {_DAY} + 7 * n + 1 WHEN 6 THEN {_DAY} + to_months(n) + to_days(1) END AS DATE) AS range_end FROM e",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", questions.shifted_range(F.expr(_WHEN), _NOW).alias("r"))
    return x.select("event_id", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@query("time_words", "SELECT event_id, event_id % 8 < 7 AS timed FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", questions.speaks_of_time(F.expr(_WHEN)).alias("timed"))


@query(
    "question_places",
    "SELECT event_id, 'orders' || CASE WHEN event_id % 2 = 0 THEN '|' || event_type ELSE '' END AS tables, event_type AS quoted FROM events",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("concat('rows from orders, where kind is \"', event_type, '\"', CASE WHEN event_id % 2 = 0 THEN concat(' in the ', event_type, ' table') ELSE '' END)")
    return table(spark, d, "events").select(
        "event_id", F.array_join(questions.named_tables(text), "|").alias("tables"), F.array_join(questions.quoted_values(text), "|").alias("quoted")
    )


_TERMS = [knowledge.Term("Purchase", "buy"), knowledge.Term("注册", "signup"), knowledge.Term("er", ""), knowledge.Term("clock", "vista")]


@query(
    "term_matches",
    "SELECT event_id, term, score FROM (SELECT event_id, unnest([{'term': 'Purchase', 'score': CASE WHEN contains(event_type, 'purchase') THEN 1.0 ELSE 0.0 END::DOUBLE}, "
    "{'term': '注册', 'score': CASE WHEN contains(event_type, 'signup') THEN 0.95 ELSE 0.0 END::DOUBLE}, "
    "{'term': 'er', 'score': CASE WHEN contains(event_type, 'er') THEN 1.0 ELSE 0.0 END::DOUBLE}, "
    "{'term': 'clock', 'score': CASE WHEN contains(event_type, 'cl') THEN 0.5 WHEN contains(event_type, 'vi') THEN 0.45 ELSE 0.0 END::DOUBLE}], recursive := true) FROM events) WHERE score >= 0.3",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.match_terms(table(spark, d, "events"), "event_id", "event_type", _TERMS)


@query("term_columns", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'o_totalprice|o_custkey' WHEN 1 THEN 'o_totalprice' ELSE '' END AS cols FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'sum(o.o_totalprice) / count(o.o_custkey)' WHEN 1 THEN 'Avg( DISTINCT o_totalprice )' ELSE 'plain' END")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(knowledge.columns_in(text), "|").alias("cols"))


_RULES = [knowledge.Rule("r1", "licen[cs]ed", ("audit=yes", "precision=2")), knowledge.Rule("r2", "the|and", ("precision=4", "note")), knowledge.Rule("r3", "password", ("audit=no",))]
_COVERED = (
    "SELECT doc_id, rule, round(coalesce(list_sum([len(m) FOR m IN regexp_extract_all(text, '(?i)' || pattern)]), 0) / greatest(len(text), 1), 4)::DOUBLE AS score, directives FROM documents, "
    "(VALUES ('r1', 'licen[cs]ed', ['audit=yes', 'precision=2']), ('r2', 'the|and', ['precision=4', 'note']), ('r3', 'password', ['audit=no'])) AS r(rule, pattern, directives)"
)


@query("rule_matches", f"SELECT doc_id, rule, score FROM ({_COVERED}) WHERE score > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.match_rules(table(spark, d, "documents"), "doc_id", "text", _RULES).select("doc_id", "rule", "score")


@query(
    "rule_enforcements",
    f"WITH x AS (SELECT doc_id, rule, score, unnest(directives) AS directive, generate_subscripts(directives, 1) AS pos FROM ({_COVERED}) WHERE score > 0), "
    "y AS (SELECT *, split_part(directive, '=', 1) AS name, split_part(directive, '=', 2) AS value FROM x WHERE contains(directive, '=')) "
    "SELECT doc_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY score DESC, rule, pos) AS r FROM y) WHERE r = 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.enforcements(knowledge.match_rules(table(spark, d, "documents"), "doc_id", "text", _RULES), "doc_id")


_ITEMS = (
    "event_id", "CASE event_id % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'pair' ELSE 'rule' END AS kind",
    "CASE event_id % 4 WHEN 0 THEN 'stale' ELSE 'active' END AS status", "event_id % 10 / 10 AS score", "event_id % 50 AS idle_days", "ts AS created",
)


@query(
    "knowledge_stats",
    f"SELECT kind, status, count(*) AS n, round(avg(score), 4) AS mean_score, min(created) AS oldest, max(created) AS newest FROM (SELECT {', '.join(_ITEMS)} FROM events) GROUP BY CUBE (kind, status)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.knowledge_stats(table(spark, d, "events").selectExpr(*_ITEMS))


@query("knowledge_due", f"SELECT bool_or(status = 'active' AND (kind = 'schema' AND idle_days > 7 OR kind = 'pair' AND idle_days > 30)) AS due FROM (SELECT {', '.join(_ITEMS)} FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.needs_upkeep(table(spark, d, "events").selectExpr(*_ITEMS))


@query("confirmed_pairs", "SELECT event_id, least(event_id % 7 / 5, 1.0)::DOUBLE AS confidence FROM events WHERE event_id % 7 >= 4 AND event_type <> 'error'")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", (F.col("event_id") % 7).alias("rating"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("final"))
    return knowledge.confirmed(x).select("event_id", "confidence")


@query(
    "candidate_pool",
    "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN event_id % 5 > 0 THEN event_id % 5 END, 0) DESC, event_id)::INT AS place FROM events)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("c", F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 5).cast("double")))
    return knowledge.pooled(x, "user_id", "c", ["event_id"]).select("user_id", "event_id", "place")


@query("owner_collisions", "SELECT l_partkey, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.collisions(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query(
    "wrong_answers_caught",
    "WITH a AS (SELECT o_orderpriority, count(DISTINCT o_custkey) AS gold, count(*) AS all_rows, count(DISTINCT o_custkey) + 0 AS same, max(o_custkey) AS top FROM orders GROUP BY 1) "
    "SELECT 'all_rows' AS name, count(*) FILTER (WHERE all_rows <> gold) AS n, count(*) FILTER (WHERE all_rows <> gold) = 0 AS survives FROM a "
    "UNION ALL SELECT 'same', count(*) FILTER (WHERE same <> gold), count(*) FILTER (WHERE same <> gold) = 0 FROM a "
    "UNION ALL SELECT 'top', count(*) FILTER (WHERE top <> gold), count(*) FILTER (WHERE top <> gold) = 0 FROM a",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    customers = F.count_distinct("o_custkey")
    x = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        customers.alias("gold"), F.count("*").alias("all_rows"), (customers + 0).alias("same"), F.max("o_custkey").alias("top")
    )
    return knowledge.caught(x, "o_orderpriority", "gold", ["all_rows", "same", "top"])


@query(
    "reflections",
    "SELECT event_id, event_id % 5 <> 4 AS needs_revision, CASE event_id % 5 WHEN 0 THEN 'rewrite' WHEN 1 THEN 'fix_error' WHEN 4 THEN 'none' ELSE 'broaden_filters' END AS strategy, "
    "CASE event_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 WHEN 4 THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence FROM events",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    return table(spark, d, "events").select("event_id", knowledge.reflection(k > 0, k == 1, F.when(k == 4, 1).when(k == 2, 0)).alias("r")).select("event_id", "r.*")


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.columns_of(spark, {t: table(spark, d, t) for t in ("region", "nation", "customer")})


@query(
    "parsed_questions",
    "SELECT event_id, 'en' AS language, 'AGGREGATE' AS intent, CASE event_id % 4 WHEN 0 THEN DATE '2024-05-14' WHEN 1 THEN DATE '2024-05-15' - 3 END AS period_start, "
    "CASE event_id % 4 WHEN 2 THEN 'attribute' ELSE '' END AS open_aspects, CASE event_id % 4 WHEN 3 THEN 5 END::BIGINT AS most, event_type AS quoted FROM events",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("concat('total of \"', event_type, '\"', CASE event_id % 4 WHEN 0 THEN ' yesterday' WHEN 1 THEN ' 3 days ago' WHEN 2 THEN ' by region' ELSE ' top 5' END)")
    x = questions.with_parsed(table(spark, d, "events"), text, _NOW)
    return x.select(
        "event_id", "p.language", "p.intent", F.col("p.period.start").alias("period_start"), F.array_join("p.ambiguities", ",").alias("open_aspects"), "p.most",
        F.array_join("p.quoted", ",").alias("quoted"),
    )


@query(
    "synonyms",
    "SELECT event_id, event_type AS candidate FROM events UNION SELECT event_id, unnest(CASE event_type WHEN 'click' THEN ['press', 'view'] ELSE ['see'] END) FROM events WHERE event_type IN ('click', 'view')",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("Click", "press"), ("click", "View"), ("view", "see")], "term string, candidate string")
    return knowledge.expanded(table(spark, d, "events"), "event_id", "event_type", known)


@query(
    "upserted_events",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 7 > 0",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    flow = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("gone", F.col("event_id") % 7 == 0)
    folder = f"{shared_folder(spark)}/tallyforge-sinks/{uuid.uuid4().hex}"
    sink = LedgerSink(spark, folder, flow.schema, ["user_id", "event_type"], ["ts", "event_id"], "gone")
    sink.start(flow, f"{folder}/checkpoint").awaitTermination()
    return sink.read().select("user_id", "event_type", "event_id", "value")
