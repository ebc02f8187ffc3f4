"""Routing of questions and texts: ordered patterns, complexity, domains, caches, candidate rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import questions
from tallyforge.functions import text as texts
from tallyforge.functions.patterns import COMPLEXITY, PLANS
from tallyforge.operators import catalog
from tallyforge.operators.search import CatalogIndex


def first_match(text: Column, rules: tuple, otherwise: str) -> Column:
    """The name of the first rule whose pattern a text in lower case matches."""
    low, out = F.lower(text), None
    for name, pattern in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(otherwise)


def complexity(text: Column) -> Column:
    """How involved a question is."""
    return first_match(text, COMPLEXITY, "simple")


def plan_of(text: Column) -> Column:
    """The plan that a rule names for a text."""
    return first_match(text, PLANS, "default")


def domain_score(keyword_share: Column, term_share: Column, schema_share: Column) -> Column:
    """Half keywords, three tenths terms, two tenths schema; 1 at most."""
    return F.round(F.least(F.lit(1.0), 0.5 * keyword_share + 0.3 * term_share + 0.2 * schema_share), 4)


def link_confidence(matched: Column, candidates: Column, mean: Column) -> Column:
    """Four tenths coverage, six tenths mean confidence; 0 without candidates."""
    cover = F.least(F.lit(1.0), matched / F.greatest(candidates, F.lit(1)))
    return F.when(candidates > 0, F.round(0.4 * cover + 0.6 * F.coalesce(mean, F.lit(1.0)), 3)).otherwise(0.0)


def parse_confidence(language: Column, intent: Column, has_time: Column, ambiguities: Column) -> Column:
    """From 0.5 up for one language, a known intent and a time range, down for ambiguities."""
    score = 0.5 + F.when(language != "mixed", 0.1).otherwise(0.0) + F.when(intent != "UNKNOWN", 0.15).otherwise(0.0)
    score = score + F.when(has_time, 0.15).otherwise(0.0) - 0.05 * ambiguities
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4)


def prompt_level(entities: Column, intent: Column, aggregation_unclear: Column, has_time: Column) -> Column:
    """How much help a question needs."""
    n = (entities >= 2).cast("int") + F.when(intent == "JOIN", 2).when(intent == "AGGREGATE", 1).when(intent == "FUNNEL", 3).otherwise(0)
    n = n + aggregation_unclear.cast("int") + has_time.cast("int")
    return F.when(n <= 0, "L1_SIMPLE").when(n <= 3, "L2_STANDARD").otherwise("L3_COMPLEX")


def candidate_rules(edits: DataFrame, key: str, kind: str, most_recent_days: int | None = None, age: str | None = None) -> DataFrame:
    """(key, occurrences, confidence): edits that repeat; log10 of the count, less if kinds differ."""
    x = edits.where(F.col(age) <= most_recent_days) if age and most_recent_days is not None else edits
    g = x.groupBy(key).agg(F.count("*").alias("occurrences"), F.count_distinct(kind).alias("kinds")).where("occurrences >= 2")
    same = F.when(F.col("kinds") == 1, 1.0).otherwise(0.8)
    return g.select(key, "occurrences", F.round(F.least(F.lit(1.0), F.log10(F.col("occurrences") + 1) * same), 2).alias("confidence"))


def cached(asked: DataFrame, held: DataFrame, text: str, keep: int) -> DataFrame:
    """Questions with whether an answer to the same text, case and spaces aside, is among the ``keep`` last used."""
    norm = lambda c: F.sha2(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), 256)
    alive = held.groupBy(norm(F.col(text)).alias("k")).agg(F.max("used").alias("used")).orderBy(F.col("used").desc(), "k").limit(keep)
    return asked.withColumn("k", norm(F.col(text))).join(alive.select("k", F.lit(True).alias("hit")), "k", "left").drop("k").withColumn("hit", F.coalesce("hit", F.lit(False)))


def suggested_plans(runs: DataFrame, least: int = 10) -> DataFrame:
    """``better_plans`` that need attention, with the plan of most success that needs none; null if there is no such plan."""
    x = better_plans(runs, least)
    good = x.where(~F.coalesce("attention", F.lit(False))).agg(F.max(F.struct("success", F.negate("edited").alias("e"), "plan"))["plan"].alias("suggested"))
    return x.where("attention").crossJoin(good)  # one row


def better_plans(runs: DataFrame, least: int = 10) -> DataFrame:
    """Plans with enough runs, their success and edit shares and mean rating, and whether they need attention."""
    x = runs.groupBy("plan").agg(
        F.count("*").alias("runs"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("success"),
        F.round(F.avg((F.col("edits") > 0).cast("int")), 6).alias("edited"), F.round(F.avg("rating"), 6).alias("rating"),
    ).where(F.col("runs") >= least)
    return x.withColumn("attention", (F.col("edited") > 0.3) | (F.col("rating") < 3))


def parents(hits: DataFrame, scope: str, parent: str, rank: str, k: int) -> DataFrame:
    """The first ``k`` parents of ranked chunks within each scope, each at its best chunk's place."""
    best = hits.groupBy(scope, parent).agg(F.min(rank).alias("best"))
    w = Window.partitionBy(scope).orderBy("best", parent)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(scope, parent, "rank")


def domain_shares(asked: DataFrame, domains: DataFrame, tables: list[str]) -> DataFrame:
    """(ask_id, domain, score) for each question (ask_id, question) and domain (domain, keywords, terms, tables), arrays of words.

    Shares of keywords and terms in the question; of tables, the mean of the shares that exist and that it names.
    """
    x = asked.select("ask_id", F.lower("question").alias("q")).crossJoin(domains)  # a catalog's domains
    within = lambda words: F.size(F.filter(words, lambda w: F.col("q").contains(F.lower(w)))) / F.greatest(F.size(words), F.lit(1))
    held = F.transform(F.array_distinct(F.transform("tables", F.lower)), lambda t: t.isin(tables).cast("int") + F.col("q").contains(t).cast("int"))
    schema = F.aggregate(held, F.lit(0), lambda a, b: a + b) / F.greatest(2 * F.size(held), F.lit(1))
    return x.select("ask_id", "domain", domain_score(within(F.col("keywords")), within(F.col("terms")), schema).alias("score"))


def retrieval_confidence(rank_mean: Column, column_mean: Column, tables: Column, hits: Column) -> Column:
    """Four tenths mean rank score, four tenths mean column confidence (1 without columns), two tenths coverage; 0 without tables."""
    cover = F.when(hits > 0, F.least(F.lit(1.0), tables / hits)).otherwise(0.5)
    score = 0.4 * F.coalesce(rank_mean, F.lit(0.0)) + 0.4 * F.coalesce(column_mean, F.lit(1.0)) + 0.2 * cover
    return F.when(tables > 0, F.round(score, 3)).otherwise(0.0)


def linked_schema(hits: DataFrame, matched: DataFrame, terms: DataFrame, columns: DataFrame, links: DataFrame) -> DataFrame:
    """(table_name, score, is_seed, columns): five steps from a question to a filtered schema.

    Tables of search hits, of matched names and of glossary terms, each (table_name, score), are those that exist, at their
    best score; foreign keys add neighbours without one; the columns of all are listed by place.
    """
    exist = columns.select("table_name").distinct()
    found = hits.unionByName(matched).unionByName(terms).join(exist, "table_name", "left_semi").groupBy("table_name").agg(F.max("score").alias("score"))
    wide = catalog.neighbours(found.select("table_name"), links).join(exist, "table_name", "left_semi")
    listed = columns.groupBy("table_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "column_name"))), lambda c: c["column_name"]).alias("columns"))
    return wide.join(found, "table_name", "left").join(listed, "table_name").select("table_name", "score", "is_seed", "columns")


def question_schema(index: CatalogIndex, question: str, embed: Callable[[str], list[float]], terms: DataFrame, columns: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """``linked_schema`` from a question alone: its search text, the index's hits, names that it holds, terms, neighbours by keys.

    ``index`` has documents of columns with the field table_name; ``terms`` are (table_name, score) of the glossary.
    """
    said = questions.search_text(F.lit(question))
    asked = columns.sparkSession.range(1).select(said.alias("s"), F.array_distinct(texts.english_tokens(said)).alias("t")).first()
    hits = index.search(asked.t, embed(asked.s), k).groupBy("table_name").agg(F.max("score").alias("score"))
    names = columns.select("table_name").distinct()
    score = reduce(F.greatest, [catalog.name_score(F.col("table_name"), F.lit(""), F.lit(t), True) for t in asked.t], F.lit(0.0))
    matched = names.withColumn("score", score).where("score >= 0.6")
    return linked_schema(hits, matched, terms, columns, links)
