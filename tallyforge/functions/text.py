"""Row-wise text functions as column expressions: language, tokens, intents, limits, times."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.patterns import INTENTS, LIMITS_ANY, LIMITS_EN, LIMITS_ZH, PRIORITY, STOP_WORDS, TIMES_EN, TIMES_ZH

CJK = r"[\x{4e00}-\x{9fff}]"
def language(text: Column) -> Column:
    """zh if over half of the characters other than spaces are CJK, mixed if over a tenth, else en."""
    all_ = F.length(F.regexp_replace(text, r"\s", ""))
    ratio = F.when(all_ > 0, F.regexp_count(text, F.lit(CJK)) / all_).otherwise(0.0)
    return F.when(ratio > 0.5, "zh").when(ratio > 0.1, "mixed").otherwise("en")


def english_tokens(text: Column) -> Column:
    """Words of letters, digits and underscores in lower case, stop words left out."""
    # \W is the complement of [A-Za-z0-9_], but a look into a table for each character where the bracket is a chain of ranges.
    words = F.split(F.lower(F.regexp_replace(text, r"\W+", " ")), " ")
    return F.filter(words, lambda w: ~w.isin(["", *STOP_WORDS]))


def chinese_tokens(text: Column, words: Callable[[Column], Column] | None = None) -> Column:
    """Words by a segmenter (``segment.segmenter``); without one characters, then pairs of neighbours, of CJK text."""
    if words is not None:
        return words(text)
    han = F.regexp_replace(text, rf"[^\x{{4e00}}-\x{{9fff}}]", "")
    n = F.length(han)
    at = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(han, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.concat(at(1), at(2))


def mixed_tokens(text: Column, words: Callable[[Column], Column] | None = None) -> Column:
    """Chinese tokens, then English ones not seen yet."""
    return F.array_distinct(F.concat(chinese_tokens(text, words), english_tokens(text)))


def tokens_by_language(text: Column, words: Callable[[Column], Column] | None = None) -> Column:
    """Tokens as the text's language asks for."""
    lang = language(text)
    return F.when(lang == "zh", chinese_tokens(text, words)).when(lang == "mixed", mixed_tokens(text, words)).otherwise(english_tokens(text))


def token_estimate(text: Column) -> Column:
    """ASCII characters other than white space by four, all others by one and a half; 0 for null."""
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0E-\x1B\x21-\x7F]", ""))
    return F.coalesce(F.floor(plain / 4.0 + (F.length(text) - plain) / 1.5).cast("long"), F.lit(0).cast("long"))


def compact(text: Column, most: int, marker: str = "\n...\n") -> Column:
    """Head and tail of a text over ``most`` characters, with a marker between."""
    side = (most - len(marker)) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(side)), F.lit(marker), F.right(text, F.lit(side))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(patterns: Iterable[str]) -> str:
    """One pattern that a text holds where it holds any of ``patterns``, which name no group by number. It spares the single ones where none can match."""
    return "|".join(f"(?:{p})" for p in patterns)


def _read(text: Column) -> Column:
    return F.struct(F.lower(text).alias("low"), language(text).alias("lang"))


def intent(text: Column) -> Column:
    """The intent with the greatest sum of weights; ties by priority, UNKNOWN without any match.

    Chinese patterns count in Chinese and mixed texts, English ones in English and mixed.
    """

    def scores(x: Column) -> Column:

        def of(patterns: tuple) -> Column:
            if not patterns:
                return F.lit(0)
            each = sum((F.when(x["low"].rlike(p), w).otherwise(0) for p, w in patterns), F.lit(0))
            return F.when(x["low"].rlike(any_of(p for p, _ in patterns)), each).otherwise(0)

        sums = ((of(zh), of(en), of(both)) for zh, en, both in (INTENTS[i] for i in PRIORITY))
        return F.array(*(F.when(x["lang"] != "en", zh).otherwise(0) + F.when(x["lang"] != "zh", en).otherwise(0) + both for zh, en, both in sums))

    first = lambda s: F.when(F.array_max(s) > 0, F.element_at(F.array(*map(F.lit, PRIORITY)), F.array_position(s, F.array_max(s)).cast("int")))
    return F.coalesce(let(let(_read(text), scores), first), F.lit("UNKNOWN"))


def limit_value(text: Column) -> Column:
    """The least number that asks for so many rows, by the patterns of the text's language; null without one."""
    hits = lambda x, patterns: [F.regexp_extract_all(x["low"], F.lit(p), 1) for p in patterns]
    none = F.array().cast("array<string>")

    def least(x: Column) -> Column:
        zh, en = (F.when(x["lang"] != other, F.concat(*hits(x, patterns))).otherwise(none) for other, patterns in (("en", LIMITS_ZH), ("zh", LIMITS_EN)))
        return F.array_min(F.transform(F.concat(zh, en, *hits(x, LIMITS_ANY)), lambda n: n.try_cast("long")))

    return let(_read(text), least)


def _period(name: str, today: Column, groups: list[Column]) -> tuple[Column, Column]:
    """(first day, day after the last) of a named time. What is under way ends today."""
    n = F.coalesce(F.least(groups[0].try_cast("int"), F.lit(10_000)), F.lit(0))
    week, month, quarter, year = (F.to_date(F.date_trunc(u, today)) for u in ("week", "month", "quarter", "year"))
    after = F.date_add(today, 1)
    one = lambda day: (day, F.date_add(day, 1))
    made = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    num = lambda c: c.try_cast("int")
    if name == "absolute_ymd":
        return one(made(num(groups[0]), num(groups[1]), num(groups[2])))
    if name == "absolute_ym":
        first = made(num(groups[0]), num(groups[1]), F.lit(1))
        return first, F.add_months(first, 1)
    if name == "absolute_quarter":
        first = made(F.year(today), num(F.translate(groups[0], "一二三四", "1234")) * 3 - 2, F.lit(1))
        return first, F.add_months(first, 3)
    return {
        "day_before_yesterday": lambda: one(F.date_sub(today, 2)), "yesterday": lambda: one(F.date_sub(today, 1)), "today": lambda: one(today),
        "tomorrow": lambda: one(after), "day_after_tomorrow": lambda: one(F.date_add(today, 2)),
        "this_week": lambda: (week, after), "last_week": lambda: (F.date_sub(week, 7), week), "next_week": lambda: (F.date_add(week, 7), F.date_add(week, 14)),
        "this_month": lambda: (month, after), "last_month": lambda: (F.add_months(month, -1), month), "next_month": lambda: (F.add_months(month, 1), F.add_months(month, 2)),
        "this_quarter": lambda: (quarter, after), "last_quarter": lambda: (F.add_months(quarter, -3), quarter),
        "next_quarter": lambda: (F.add_months(quarter, 3), F.add_months(quarter, 6)),
        "this_year": lambda: (year, after), "last_year": lambda: (F.add_months(year, -12), year), "next_year": lambda: (F.add_months(year, 12), F.add_months(year, 24)),
        "same_period_last_year": lambda: (F.add_months(today, -12), after), "ytd": lambda: (year, after), "qtd": lambda: (quarter, after), "mtd": lambda: (month, after),
        "last_n_days": lambda: (F.date_sub(today, n), after), "last_n_weeks": lambda: (F.date_sub(today, n * 7), after),
        "last_n_months": lambda: (F.add_months(today, -n), after), "last_n_years": lambda: (F.add_months(today, n * -12), after),
        "n_days_ago": lambda: one(F.date_sub(today, n)), "n_weeks_ago": lambda: (F.date_sub(today, n * 7), F.date_sub(today, n * 7 - 7)),
        "n_months_ago": lambda: (F.add_months(month, -n), F.add_months(month, 1 - n)), "n_years_ago": lambda: (F.add_months(year, n * -12), F.add_months(year, 12 - n * 12)),
        "next_n_days": lambda: (today, F.date_add(today, n + 1)), "next_n_weeks": lambda: (today, F.date_add(today, n * 7 + 1)),
        "next_n_months": lambda: (today, F.date_add(F.add_months(today, n), 1)),
    }[name]()


def time_range(text: Column, now: str) -> Column:
    """(start, end) dates of the first pattern that a text holds, from a reference date, ends exclusive; null without one, or for a day that no calendar has.

    Chinese patterns come first and count in Chinese and mixed texts, English ones in English and mixed.
    """
    today = F.to_date(F.lit(now))

    def first(x: Column) -> Column:
        found = []
        for spoken, patterns in (("zh", TIMES_ZH), ("en", TIMES_EN)):
            other, out = "en" if spoken == "zh" else "zh", None
            for name, p in patterns:
                groups = [F.regexp_extract(x["low"], p, i) for i in range(1, p.replace("(?", "").count("(") + 1)] or [F.lit("")]
                start, end = _period(name, today, groups)
                hit, value = x["low"].rlike(p), F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
                out = F.when(hit, value) if out is None else out.when(hit, value)
            found.append(((x["lang"] != other) & x["low"].rlike(any_of(p for _, p in patterns)), out))
        return F.when(*found[0]).when(*found[1])

    return let(_read(text), first)
