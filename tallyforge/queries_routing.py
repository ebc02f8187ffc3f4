"""Queries of routing, validity, contracts, deltas and metadata, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import questions
from tallyforge.operators import catalog, documents, learning, routing
from tallyforge.registry import query
from tallyforge.session import table

_Q = (
    "concat(CASE event_id % 8 WHEN 0 THEN 'first list then count ' WHEN 1 THEN 'maybe show ' WHEN 2 THEN 'top 5 ' WHEN 3 THEN 'select a join b ' "
    "WHEN 4 THEN 'daily ' WHEN 5 THEN 'how much ' WHEN 6 THEN 'select x from t group by ' ELSE CASE event_id % 10 WHEN 1 THEN '列出' WHEN 3 THEN '关联查询' WHEN 5 THEN '或者 ' WHEN 7 THEN '统计' ELSE 'plain ' END END, event_type)"
)


def _cases(rules: tuple, otherwise: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{n}'" for n, p in rules)
    return f"CASE {whens} ELSE '{otherwise}' END"


@query("question_complexity", f"SELECT event_id, {_cases(routing.COMPLEXITY, 'simple')} AS complexity FROM (SELECT event_id, lower({_Q}) AS q FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", routing.complexity(F.expr(_Q)).alias("complexity"))


@query("plan_router", f"SELECT event_id, {_cases(routing.PLANS, 'default')} AS plan FROM (SELECT event_id, lower({_Q}) AS q FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", routing.plan_of(F.expr(_Q)).alias("plan"))


@query("domain_score", "SELECT event_id, round(least(1, 0.5::DOUBLE * ((event_id % 5) / 4) + 0.3::DOUBLE * ((event_id % 3) / 2) + 0.2::DOUBLE * ((event_id % 7) / 6)), 4) AS score FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", routing.domain_score(e % 5 / 4, e % 3 / 2, e % 7 / 6).alias("score"))


@query("link_confidence", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE round(0.4::DOUBLE * least(1, (event_id % 6) / (event_id % 4)) + 0.6::DOUBLE * ((event_id % 10) / 10), 3) END AS confidence FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", routing.link_confidence(e % 6, e % 4, e % 10 / 10).alias("confidence"))


@query("parse_confidence", "SELECT event_id, round(least(1, greatest(0, 0.5::DOUBLE + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 0.1 END + CASE WHEN event_id % 4 = 0 THEN 0 ELSE 0.15 END + CASE WHEN event_id % 2 = 0 THEN 0.15 ELSE 0 END - 0.05::DOUBLE * (event_id % 5))), 4) AS confidence FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    lang, intent = F.when(e % 3 == 0, "mixed").otherwise("en"), F.when(e % 4 == 0, "UNKNOWN").otherwise("SELECT")
    return table(spark, d, "events").select("event_id", routing.parse_confidence(lang, intent, e % 2 == 0, e % 5).alias("confidence"))


@query("prompt_level", "SELECT event_id, CASE WHEN n <= 0 THEN 'L1_SIMPLE' WHEN n <= 3 THEN 'L2_STANDARD' ELSE 'L3_COMPLEX' END AS level FROM (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END + CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    intent = F.when(e % 4 == 0, "JOIN").when(e % 4 == 1, "AGGREGATE").when(e % 4 == 2, "FUNNEL").otherwise("SELECT")
    return table(spark, d, "events").select("event_id", routing.prompt_level(e % 3, intent, e % 5 == 0, e % 2 == 0).alias("level"))


@query("edit_rules", "SELECT k, n AS occurrences, round(least(1, log10(n + 1) * CASE WHEN kinds = 1 THEN 1.0::DOUBLE ELSE 0.8 END), 2) AS confidence FROM (SELECT event_type || ':' || (user_id % 50) AS k, count(*) AS n, count(DISTINCT event_id % 2) AS kinds FROM events WHERE event_id % 40 <= 30 GROUP BY 1) WHERE n >= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select(
        F.concat_ws(":", "event_type", F.col("user_id") % 50).alias("k"), (F.col("event_id") % 2).alias("kind"), (F.col("event_id") % 40).alias("age")
    )
    return routing.candidate_rules(x, "k", "kind", 30, "age")


_FRAGMENT = (
    "CASE user_id % 9 WHEN 0 THEN 'WHERE ' WHEN 1 THEN ' and ' WHEN 2 THEN 'LEFT JOIN ' WHEN 3 THEN 'Group  By ' WHEN 4 THEN 'order by ' WHEN 5 THEN 'x HAVING ' WHEN 6 THEN 'avg (1) ' WHEN 7 THEN 'or ' ELSE '' END "
    "|| CASE event_id % 4 WHEN 0 THEN event_type || '.Value >= 3' WHEN 1 THEN 'User_Id = 1' WHEN 2 THEN event_type ELSE '' END"
)
_KIND_SQL = "CASE WHEN trim(x) = '' THEN NULL {} ELSE 'OTHER' END".format(" ".join(f"WHEN regexp_matches(lower(trim(x)), '{p}') THEN '{k}'" for k, p in learning.FRAGMENTS))


@query(
    "edit_kinds",
    f"SELECT {_KIND_SQL} AS kind, nullif(lower(regexp_extract(x, '{learning.COMPARED}', 1)), '') AS of, nullif(lower(regexp_extract(x, '{learning.COMPARED}', 2)), '') AS col, count(*) AS n "
    f"FROM (SELECT {_FRAGMENT} AS x FROM events) GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select(F.expr(_FRAGMENT).alias("x"))
    x = x.select(learning.fragment_kind(F.col("x")).alias("kind"), learning.compared_column(F.col("x")).alias("c"))
    return x.groupBy("kind", F.col("c.table").alias("of"), F.col("c.column").alias("col")).agg(F.count("*").alias("n"))


_ANSWER = (
    "'```sql' || chr(10) || 'SELECT ' || doc_id || ' AS ' || source || ';' || chr(10) || '```' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '---ALTERNATIVE---' ELSE '' END || "
    "CASE doc_id % 2 WHEN 0 THEN 'The other: with x as (select ' || lang || ') select * from x ;' ELSE '-- Failed to generate' END || CASE doc_id % 5 WHEN 0 THEN '---ALTERNATIVE---  select ' || doc_id ELSE '' END"
)
_FENCED, _BARE = r"'(?is)```(?:sql)?\s*(.*?)```'", r"'(?is)\b((?:select|with)\b.*)'"


@query(
    "sql_alternatives",
    f"WITH a AS (SELECT doc_id, {_ANSWER} AS x FROM documents), p AS (SELECT doc_id, unnest(string_split(x, '---ALTERNATIVE---')) AS part, generate_subscripts(string_split(x, '---ALTERNATIVE---'), 1) AS place FROM a WHERE contains(x, '---ALTERNATIVE---')), "
    f"q AS (SELECT doc_id, place, regexp_replace(trim(CASE WHEN regexp_extract(part, {_FENCED}, 1) <> '' THEN regexp_extract(part, {_FENCED}, 1) ELSE regexp_extract(part, {_BARE}, 1) END), '[\\s;]+$', '') AS sql FROM p WHERE NOT starts_with(trim(part), '-- Failed to generate')) "
    "SELECT doc_id, string_agg(sql, '|' ORDER BY place) AS texts, count(*) AS n FROM q WHERE sql <> '' GROUP BY doc_id HAVING count(*) > 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", questions.alternatives_of(F.expr(_ANSWER)).alias("t")).where(F.size("t") > 0)
    return x.select("doc_id", F.array_join("t", "|").alias("texts"), F.size("t").cast("long").alias("n"))


@query("cache_hits", "WITH h AS (SELECT event_type AS t, max(event_id) AS used FROM events GROUP BY 1 ORDER BY used DESC LIMIT 2) SELECT event_id, event_type IN (SELECT t FROM h) AS hit FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events")
    held = x.select(F.concat(F.lit(" "), F.upper("event_type")).alias("q"), F.col("event_id").alias("used"))
    return routing.cached(x.select("event_id", F.col("event_type").alias("q")), held, "q", 2).select("event_id", "hit")


@query("plan_outcomes", "SELECT plan, runs, success, edited, rating, edited > 0.3 OR rating < 3 AS attention FROM (SELECT event_type AS plan, count(*) AS runs, round(avg((event_id % 4 <> 0)::INT), 6) AS success, round(avg((event_id % 5 > 0)::INT), 6) AS edited, round(avg(event_id % 6), 6) AS rating FROM events GROUP BY 1) WHERE runs >= 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return routing.better_plans(table(spark, d, "events").select(F.col("event_type").alias("plan"), (e % 4 != 0).alias("ok"), (e % 5).alias("edits"), (e % 6).alias("rating")))


@query("chunk_parents", "SELECT lang, parent, rank FROM (SELECT lang, parent, row_number() OVER (PARTITION BY lang ORDER BY best, parent) AS rank FROM (SELECT lang, doc_id % 50 AS parent, min(n_chars) AS best FROM documents GROUP BY 1, 2)) WHERE rank <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select("lang", (F.col("doc_id") % 50).alias("parent"), "n_chars")
    return routing.parents(hits, "lang", "parent", "n_chars", 5).withColumn("rank", F.col("rank").cast("long"))


@query("rank_invalid", "SELECT l.doc_id % 7 AS query, count(*) AS n, count(*) - count(DISTINCT l.doc_id) AS duplicates, count(*) FILTER (WHERE d.doc_id IS NULL) AS unknown, count(*) FILTER (WHERE d.lang <> 'en') AS out_of_scope FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("known"), "lang")
    x = table(spark, d, "labels").join(docs, F.col("doc_id") == F.col("known"), "left")
    return x.groupBy((F.col("doc_id") % 7).alias("query")).agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("doc_id")).alias("duplicates"),
        F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("lang") != "en").alias("out_of_scope"),
    )


@query("rank_summary", "SELECT lang, quality, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality)")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return x.rollup("lang", "quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("contract_robust", "SELECT o_custkey % 100 AS case_id, bool_and(o_orderstatus <> 'P') AS robust, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("case_id"))
    return x.agg(F.bool_and(F.col("o_orderstatus") != "P").alias("robust"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"))


@query("threshold_gate", "SELECT o_orderpriority, n, score, n >= 100 AND score >= 0.45 AS met FROM (SELECT o_orderpriority, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS score FROM orders GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("score"))
    return x.withColumn("met", (F.col("n") >= 100) & (F.col("score") >= 0.45))


@query("paired_p95_delta", "SELECT quantile_disc(b - a, 0.95) AS p95_delta, count(*) AS pairs FROM (SELECT a.value AS a, b.value AS b FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events")
    a = x.where("event_id % 2 = 0").select((F.col("event_id") + 1).alias("event_id"), F.col("value").alias("a"))
    pairs = a.join(x.select("event_id", F.col("value").alias("b")), "event_id").select((F.col("b") - F.col("a")).alias("delta"))
    return pairs.agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY delta)").alias("p95_delta"), F.count("*").alias("pairs"))


@query("worker_throughput", "SELECT count(DISTINCT user_id % 4) AS workers, count(*) AS attempts, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS rps FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").agg(
        F.count_distinct(F.col("user_id") % 4).alias("workers"), F.count("*").alias("attempts"), F.round(F.count("*") / (F.max(s) - F.min(s)), 6).alias("rps")
    )


@query("billing_attach", "SELECT user_id % 20 AS arm, CASE WHEN count(*) = count(CASE WHEN event_id % 400 <> 3 THEN value END) THEN round(sum(value), 4) END AS billed FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("bill", F.when(F.col("event_id") % 400 != 3, F.col("value")))
    return x.groupBy((F.col("user_id") % 20).alias("arm")).agg(F.when(F.count("*") == F.count("bill"), F.round(F.sum("bill"), 4)).alias("billed"))


@query("keep_newest", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.col("event_id").desc()).limit(100).select("event_id")


@query("delete_by_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")


@query("markdown_chunks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunked(table(spark, d, "documents"))


@query("hash_embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    return documents.embedded(table(spark, d, "benchmark")).select("item_id", "embedding")


@query("edit_diff")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "conversations")
    later = x.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    x = x.select("conv_id", "turn", F.col("text").alias("before")).join(later, ["conv_id", "turn"])
    return x.select("conv_id", "turn", documents.edit_operations(F.col("before"), F.col("after")).alias("ops"))
