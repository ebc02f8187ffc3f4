"""More of a question's structure as column expressions: orders, ambiguities, absolute times, SQL in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as texts
from tallyforge.functions.patterns import AMBIGUITIES, ORDERS

#: Words that speak of time.
TIME_WORDS = (
    r"\b(quarters?|weeks?|months?|years?|days?|dates?|time|periods?|ago|last|next|past|recent(?:ly)?|since|until|between|before|after|"
    r"q[1-4]|ytd|qtd|mtd|holidays?)\b"
)
TIME_SIGNS = "季度 周 月 年 天 日 时间 期间 前 后 以来 至今 假期 春节".split()
#: Fixed values: (language, pattern) that name a table in the group.
TABLES = (
    ("zh", r"从\s*(\S+?)\s*(?:表|中|里)"),
    ("zh", r"(?:查询|查找|获取|读取|统计|分析|关联|从|在|的)?(\S{1,4})表(?:格|中|里|的)?"),
    ("en", r"\b(?:from|table)\s+(\S+)"),
    ("en", r"\bthe\s+(\S+)\s+table\b"),
)
QUOTED = r"[\u300c\u300e\"']([^'\"\u300c\u300d\u300e\u300f]+)['\"\u300d\u300f]"


def speaks_of_time(text: Column) -> Column:
    """Whether a text has words of time; false for null."""
    found = F.lower(text).rlike(TIME_WORDS)
    for sign in TIME_SIGNS:
        found = found | text.contains(sign)
    return F.coalesce(found, F.lit(False))


def shifted_range(text: Column, now: str) -> Column:
    """(start, end) dates of "n units ago" and "next n units" from a reference date, ends exclusive; null without one.

    Days, and weeks of seven days, are counted from the date; months and years ago are whole
    ones. The next units begin on the date and hold the day on which they end.
    """
    low, today = F.lower(text), F.to_date(F.lit(now))
    month, year = F.to_date(F.date_trunc("month", today)), F.to_date(F.date_trunc("year", today))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    patterns = {"ago": r"\b(\d{1,4})\s+(day|week|month|year)s?\s+ago\b", "ahead": r"\bnext\s+(\d{1,4})\s+(day|week|month)s?\b"}
    said = F.struct(*(F.regexp_extract(low, p, i).alias(f"{name}{i}") for name, p in patterns.items() for i in (1, 2)))

    def shifted(x: Column) -> Column:
        ago, ahead = ([x[f"{name}{i}"] for i in (1, 2)] for name in patterns)
        n, k = (F.when(c != "", c.cast("int")).otherwise(0) for c in (ago[0], ahead[0]))
        return (
            F.when(ago[1] == "day", pair(F.date_sub(today, n), F.date_sub(today, n - 1)))
            .when(ago[1] == "week", pair(F.date_sub(today, n * 7), F.date_sub(today, n * 7 - 7)))
            .when(ago[1] == "month", pair(F.add_months(month, -n), F.add_months(month, 1 - n)))
            .when(ago[1] == "year", pair(F.add_months(year, n * -12), F.add_months(year, 12 - n * 12)))
            .when(ahead[1] == "day", pair(today, F.date_add(today, k + 1)))
            .when(ahead[1] == "week", pair(today, F.date_add(today, k * 7 + 1)))
            .when(ahead[1] == "month", pair(today, F.date_add(F.add_months(today, k), 1)))
        )

    return F.when(low.rlike(texts.any_of(patterns.values())), texts.let(said, shifted))


def named_tables(text: Column) -> Column:
    """Tables that a question names, by pattern, then place; Chinese patterns count in Chinese and mixed texts, English ones in English and mixed. Final marks are cut off."""
    none = F.array().cast("array<string>")
    found = texts.let(
        texts.language(text),
        lambda lang: F.concat(*(F.when(lang != ("en" if spoken == "zh" else "zh"), F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1)).otherwise(none) for spoken, p in TABLES)),
    )
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"[,.;\x{ff0c}\x{3002}\x{ff1b}]+$", "")), lambda x: x != ""))


def quoted_entities(text: Column) -> Column:
    """array<struct<value,first,past>>: what stands in quotes, trimmed, and the places of the untrimmed text, from 0."""
    whole = F.regexp_extract_all(text, F.lit(QUOTED), 0)  # the first place from the last match on that holds the whole match is the match
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<value:string,first:int,past:int>>").alias("found"))

    def add(state: Column, match: Column) -> Column:
        at = F.position(match, text, state["at"]).cast("int")
        size = F.length(match)
        value = F.struct(F.trim(F.substring(match, F.lit(2), size - 2)).alias("value"), at.alias("first"), (at + size - 2).alias("past"))
        return F.struct((at + size).alias("at"), F.concat(state["found"], F.array(value)).alias("found"))

    return F.filter(F.aggregate(whole, start, add)["found"], lambda x: x["value"] != "")


def quoted_values(text: Column) -> Column:
    """What stands in quotes, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), 1), F.trim), lambda x: x != "")


def ambiguities(text: Column, intent: Column) -> Column:
    """Aspects that a question leaves open; those of aggregation only where it aggregates."""
    low = F.lower(text)
    found = []
    for aspect in dict.fromkeys(a for a, _ in AMBIGUITIES):
        holds = low.rlike(texts.any_of(p for a, p in AMBIGUITIES if a == aspect))
        found.append(F.when(((intent == "AGGREGATE") & holds) if aspect == "aggregation" else holds, aspect))
    return F.array_compact(F.array(*found))


def orders(text: Column) -> Column:
    """Array of "column direction": the columns to order by, in order of patterns and places; the first direction said of a column counts, else ASC."""

    def named(lang: Column) -> Column:
        parts = []
        for spoken, direction, p in ORDERS:
            other = "en" if spoken == "zh" else "zh"
            names = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1), lambda x: F.regexp_replace(x, r"[,.;\x{ff0c}\x{3002}\x{ff1b}]+$", ""))
            found = F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(direction).alias("way")))
            parts.append(F.when(lang != other, found).otherwise(F.array().cast("array<struct<name:string,way:string>>")))
        return F.filter(F.concat(*parts), lambda x: x["name"] != "")

    def directed(every: Column) -> Column:
        def one(name: Column) -> Column:
            said = F.filter(every, lambda x: (x["name"] == name) & (x["way"] != F.lit("")))
            return F.concat_ws(" ", name, F.coalesce(F.get(said, F.lit(0))["way"], F.lit("ASC")))

        return F.transform(F.array_distinct(F.transform(every, lambda x: x["name"])), one)

    none = ~text.rlike(f"(?i){texts.any_of(p for _, _, p in ORDERS)}")
    return F.when(none, F.array().cast("array<string>")).otherwise(texts.let(texts.let(texts.language(text), named), directed))


def absolute_period(text: Column) -> Column:
    """(start, end) dates of a day, quarter or month written in figures; ends are exclusive."""
    y, m, day = (F.regexp_extract(text, r"\b(\d{4})-(\d{1,2})(?:-(\d{1,2}))?\b", i) for i in (1, 2, 3))
    qy, q = (F.regexp_extract(F.lower(text), r"\b(\d{4})\s*q([1-4])\b", i) for i in (1, 2))
    num = lambda c: F.try_to_number(F.when(c != "", c), F.lit("9999")).cast("int")
    made = lambda a, b, c: F.try_make_timestamp(a, b, c, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    start_day, start_month, start_quarter = made(num(y), num(m), num(day)), made(num(y), num(m), F.lit(1)), made(num(qy), num(q) * 3 - 2, F.lit(1))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    period = (
        F.when(q != "", pair(start_quarter, F.add_months(start_quarter, 3)))
        .when(day != "", pair(start_day, F.date_add(start_day, 1)))
        .when(m != "", pair(start_month, F.add_months(start_month, 1)))
    )
    return F.when(text.rlike(r"\d{4}"), period)  # none without a year


def sql_of(answer: Column) -> Column:
    """The SQL in an answer: the fenced block, or the text from its first SELECT or WITH."""
    fenced = F.regexp_extract(answer, r"(?is)```(?:sql)?\s*(.*?)```", 1)
    bare = F.regexp_extract(answer, r"(?is)\b((?:select|with)\b.*)", 1)
    return F.nullif(F.regexp_replace(F.trim(F.when(fenced != "", fenced).otherwise(bare)), r"[\s;]+$", ""), F.lit(""))


#: What stands between alternatives of one answer, and how a failed one begins.
ALTERNATIVE, FAILED = "---ALTERNATIVE---", "-- Failed to generate"


def alternatives_of(answer: Column) -> Column:
    """The SQL texts of an answer that holds two or more, in order; empty where there are fewer. Blank and failed ones do not count."""
    parts = F.filter(F.split(answer, ALTERNATIVE), lambda p: ~F.trim(p).startswith(FAILED))
    found = F.array_compact(F.transform(parts, sql_of))
    return F.when(answer.contains(ALTERNATIVE) & (F.size(found) > 1), found).otherwise(F.array().cast("array<string>"))


def search_text(text: Column) -> Column:
    """What to search a catalog for: a question, its intent, the names it quotes, and the tables it names."""
    kind = texts.intent(text)
    return F.concat_ws(" ", text, F.when(kind != "UNKNOWN", kind), F.array_join(quoted_values(text), " "), F.array_join(named_tables(text), " "))


def word_hits(words: Column, text: Column) -> Column:
    """Share of words, of two characters at least, that a text holds."""
    asked = F.filter(words, lambda w: F.length(w) >= 2)
    low = F.lower(text)
    return F.when(F.size(asked) > 0, F.round(F.size(F.filter(asked, lambda w: low.contains(w))) / F.size(asked), 4)).otherwise(0.0)


def parsed(text: Column, now: str) -> Column:
    """All that is read from a question: language, intent, time range, what is open, limit, order, tables and quoted values."""

    def whole(x: Column) -> Column:
        text, intent = x["text"], x["intent"]
        return F.struct(
            texts.language(text).alias("language"), intent.alias("intent"), F.coalesce(texts.time_range(text, now), shifted_range(text, now), absolute_period(text)).alias("period"),
            ambiguities(text, intent).alias("ambiguities"), texts.limit_value(text).alias("most"), orders(text).alias("ordering"),
            named_tables(text).alias("tables"), quoted_values(text).alias("quoted"),
        )

    return texts.let(texts.let(text, lambda t: F.struct(t.alias("text"), texts.intent(t).alias("intent"))), whole)


def with_parsed(x: DataFrame, text: Column, now: str, name: str = "p") -> DataFrame:
    """``x`` with a column of what is read from each row's question; equal questions are read once.

    Distinct questions are dealt out evenly, as reading takes longer than their bytes tell.
    """
    asked = x.withColumn("_asked", text)
    once = asked.select("_asked").distinct().repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = once.select(F.col("_asked").alias("_once"), parsed(F.col("_asked"), now).alias(name))
    return asked.join(once, F.col("_asked").eqNullSafe(F.col("_once"))).drop("_asked", "_once")
