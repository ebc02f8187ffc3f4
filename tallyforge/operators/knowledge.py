"""Business terms and rules held against questions, and the upkeep of what is known.

Terms and rules are configuration of a few hundred entries: they come as lists and become
expressions, so questions are read once and nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Term(NamedTuple):
    """A business term, its English form and the expression it stands for."""

    name: str
    english: str = ""
    expression: str = ""


class Rule(NamedTuple):
    """A pattern, matched in either case, and its ``key=value`` directives."""

    id: str
    pattern: str
    directives: Sequence[str] = ()


def _fuzzy(names: Sequence[str]):
    """Seven tenths of the similarity of a text to each of ``names``, 0 below 0.6; one function for all, as each takes a worker of its own."""

    @F.arrow_udf("array<double>")
    def ratios(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matchers = [SequenceMatcher(None, name, "") for name in names]

        def of(matcher: SequenceMatcher, text: str | None) -> float:
            n, m = len(matcher.a), len(text or "")
            if not m or 2 * min(n, m) < 0.6 * (n + m):  # lengths alone rule it out, as those of long texts do
                return 0.0
            matcher.set_seq2(text)
            x = matcher.ratio()
            return round(x * 0.7, 3) if x >= 0.6 else 0.0

        for texts in batches:
            coded = texts.dictionary_encode()  # equal texts of a batch are compared once
            held = pa.array([[of(m, t) for m in matchers] for t in coded.dictionary.to_pylist()] + [[0.0] * len(matchers)], pa.list_(pa.float64()))
            yield held.take(pc.fill_null(coded.indices, len(held) - 1))

    return ratios


def term_score(term: Term, text: Column, fuzzy: bool = True, alike: Column | None = None) -> Column:
    """How well a term matches a text, both in lower case; 0 for a null text.

    1 if the text holds the term, 0.95 its English form, 0.5 or 0.45 the first two letters
    of one of three or more; else seven tenths of the similarity of sequences from 0.6 up,
    which may be at hand as ``alike``.
    """
    low, name, english = F.lower(F.coalesce(text, F.lit(""))), term.name.lower(), term.english.lower()
    out = F.when(low.contains(name), 1.0)
    if english:
        out = out.when(low.contains(english), 0.95)
    if len(name) >= 3:
        out = out.when(low.contains(name[:2]), 0.5)
        if len(english) >= 3:
            out = out.when(low.contains(english[:2]), 0.45)
    return out.otherwise((_fuzzy([name])(low)[0] if alike is None else alike) if fuzzy else F.lit(0.0))


def match_terms(asked: DataFrame, key: str, text: str, terms: Sequence[Term], least: float = 0.3, fuzzy: bool = True) -> DataFrame:
    """(key, term, score) of each question's terms that score ``least`` or more."""
    told = [F.col(key).alias("key"), F.col(text).alias("text")]
    if fuzzy and terms:
        told.append(_fuzzy([t.name.lower() for t in terms])(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("alike"))
    alike = lambda i: F.col("alike")[i] if fuzzy else None
    scored = asked.select(*told).select(F.col("key").alias(key), *(term_score(t, F.col("text"), fuzzy, alike(i)).alias(f"s{i}") for i, t in enumerate(terms)))
    each = F.array(*(F.struct(F.lit(t.name).alias("term"), F.col(f"s{i}").alias("score")) for i, t in enumerate(terms)))
    return scored.select(key, F.explode(F.filter(each, lambda x: x["score"] >= least)).alias("x")).select(key, "x.term", "x.score")


def columns_in(expression: Column) -> Column:
    """Columns that an expression names: those after a dot, else the arguments of its functions."""
    dotted = F.regexp_extract_all(expression, F.lit(r"(\w+)\.(\w+)"), 2)
    called = F.regexp_extract_all(expression, F.lit(r"(?i)(?:SUM|AVG|COUNT|MAX|MIN|COALESCE)\s*\(\s*(?:DISTINCT\s+)?(\w+)"), 1)
    return F.when(F.size(dotted) > 0, dotted).otherwise(called)


def coverage(pattern: str, text: Column) -> Column:
    """The share of a text's characters within matches of a pattern, in either case; 0 for null."""
    whole = F.coalesce(text, F.lit(""))
    held = F.aggregate(F.regexp_extract_all(whole, F.lit(f"(?i)({pattern})"), 1), F.lit(0), lambda a, x: a + F.length(x))
    return F.round(held / F.greatest(F.length(whole), F.lit(1)), 4)


def match_rules(asked: DataFrame, key: str, text: str, rules: Sequence[Rule], least: float = 0.0) -> DataFrame:
    """(key, rule, score, directives) of the rules that match each question."""
    scored = asked.select(key, *(coverage(r.pattern, F.col(text)).alias(f"s{i}") for i, r in enumerate(rules)))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    each = F.array(*(
        F.struct(F.lit(r.id).alias("rule"), F.col(f"s{i}").alias("score"), texts(r.directives).alias("directives")) for i, r in enumerate(rules)
    ))
    held = F.filter(each, lambda x: (x["score"] > 0) & (x["score"] >= least))
    return scored.select(key, F.explode(held).alias("x")).select(key, "x.rule", "x.score", "x.directives")


def enforcements(matched: DataFrame, key: str) -> DataFrame:
    """(key, name, value): directives of matched rules; the better match wins, then the lower rule id, then the earlier one."""
    x = matched.select(key, "rule", "score", F.posexplode("directives").alias("at", "directive")).where(F.col("directive").contains("="))
    x = x.withColumns({"name": F.substring_index("directive", "=", 1), "value": F.expr("substring(directive, instr(directive, '=') + 1)")})
    return x.groupBy(key, "name").agg(F.min_by("value", F.struct(-F.col("score"), "rule", "at")).alias("value"))


def knowledge_stats(items: DataFrame) -> DataFrame:
    """Items by kind and status, each and together: number, mean score, oldest and newest."""
    return items.cube("kind", "status").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.min("created").alias("oldest"), F.max("created").alias("newest")
    )


def needs_upkeep(items: DataFrame) -> DataFrame:
    """One row: is an active item of a schema idle for over 7 days, or a pair for over 30; false for no items."""
    old = (F.col("status") == "active") & (((F.col("kind") == "schema") & (F.col("idle_days") > 7)) | ((F.col("kind") == "pair") & (F.col("idle_days") > 30)))
    return items.agg(F.coalesce(F.bool_or(old), F.lit(False)).alias("due"))


def confirmed(feedback: DataFrame) -> DataFrame:
    """Feedback with a final text and a rating of 4 or more, and its confidence, a fifth of the rating."""
    good = feedback.where((F.col("rating") >= 4) & (F.coalesce("final", F.lit("")) != ""))
    return good.withColumn("confidence", F.least(F.col("rating") / 5, F.lit(1.0)))


def pooled(candidates: DataFrame, key: str, confidence: str, order: Sequence[str]) -> DataFrame:
    """Candidates of all sources with their place, from 1, by confidence; none counts as 0 and ties keep the given order."""
    w = Window.partitionBy(key).orderBy(F.coalesce(F.col(confidence), F.lit(0.0)).desc(), *order)
    return candidates.withColumn("place", F.row_number().over(w))


def collisions(entries: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owners) of keys that several owners claim."""
    return entries.groupBy(key).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def caught(results: DataFrame, case: str, right: str, wrong: Sequence[str]) -> DataFrame:
    """(name, n, survives): for each wrong answer the cases that tell it from the right one."""
    n = [F.count_if(~F.col(w).eqNullSafe(F.col(right))) for w in wrong]
    row = results.select(case, right, *wrong).agg(F.array(*(F.struct(F.lit(w).alias("name"), x.alias("n")) for w, x in zip(wrong, n, strict=True))).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.name", "x.n", (F.col("x.n") == 0).alias("survives"))


def reflection(ran: Column, failed: Column, rows: Column) -> Column:
    """What follows a run: (needs_revision, strategy, confidence)."""
    what = lambda revise, how, sure: F.struct(F.lit(revise).alias("needs_revision"), F.lit(how).alias("strategy"), F.lit(sure).alias("confidence"))
    return (
        F.when(~F.coalesce(ran, F.lit(False)), what(True, "rewrite", 0.5))
        .when(F.coalesce(failed, F.lit(False)), what(True, "fix_error", 0.8))
        .when(F.coalesce(rows, F.lit(0)) == 0, what(True, "broaden_filters", 0.6))
        .otherwise(what(False, "none", 1.0))
    )


def expanded(tokens: DataFrame, key: str, token: str, synonyms: DataFrame) -> DataFrame:
    """(key, candidate): tokens and their synonyms from a table (term, candidate), without repeats; Spark chooses the join."""
    named = synonyms.select(F.lower("term").alias("term"), F.lower("candidate").alias("candidate"))
    own = tokens.select(key, F.lower(token).alias("term")).where("term IS NOT NULL")
    return own.select(key, F.col("term").alias("candidate")).unionByName(own.join(named, "term").select(key, "candidate")).distinct()


def term_documents(terms: DataFrame, domain: str) -> DataFrame:
    """(doc_id, text): a searchable document per term (term, english, description, expression, table_name), empty parts left out."""
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), c))
    english = F.when(F.coalesce("english", F.lit("")) != "", F.concat(F.lit("("), "english", F.lit(")")))
    parts = [F.concat(F.lit("业务术语: "), "term"), english, part("描述: ", "description"), part("SQL表达式: ", "expression"), part("关联表: ", "table_name")]
    return terms.select(F.concat_ws(".", F.lit("glossary"), F.lit(domain), "term").alias("doc_id"), F.concat(F.concat_ws("。", *parts), F.lit("。")).alias("text"))


def rule_documents(rules: DataFrame, domain: str) -> DataFrame:
    """(doc_id, text): a searchable document per rule (rule, description, pattern, directives), empty parts left out."""
    part = lambda label, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(label), c))
    said = rules.withColumn("enforced", F.array_join("directives", "; "))
    parts = [F.concat(F.lit("业务规则: "), "rule"), part("描述: ", "description"), part("条件: ", "pattern"), part("约束: ", "enforced")]
    return said.select(F.concat_ws(".", F.lit("rules"), F.lit(domain), "rule").alias("doc_id"), F.concat(F.concat_ws("。", *parts), F.lit("。")).alias("text"))


def merged_items(items: DataFrame, key: str, content: str, updated: str) -> DataFrame:
    """(key, version, contents, updated): items of one key as one, its version their number, each content once, newest first."""
    newest = F.array_sort(F.collect_list(F.struct(F.col(updated).alias("u"), F.col(content).alias("c"))), lambda a, b: F.when(a["u"] > b["u"], -1).when(a["u"] < b["u"], 1).when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1).otherwise(0))
    once = items.where(F.col(key).isNotNull()).groupBy(key, content).agg(F.max(updated).alias(updated), F.count("*").alias("_n"))
    return once.groupBy(key).agg(F.sum("_n").alias("version"), F.transform(newest, lambda x: x["c"]).alias("contents"), F.max(updated).alias(updated))
