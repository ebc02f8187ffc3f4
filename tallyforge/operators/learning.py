"""Learning from use: feedback statistics, pairs, similarity, lifecycles, routing and rates."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tallyforge.session import cut_lineage


def feedback_stats(x: DataFrame) -> DataFrame:
    """One row over (rating 0-5, ok, cancelled, edits): totals, means and shares."""
    return x.agg(
        F.count("*").alias("total"), F.round(F.avg(F.when(F.col("rating") > 0, F.col("rating"))), 6).alias("avg_rating"),
        F.round(F.avg(F.col("ok").cast("int")), 6).alias("ok_share"), F.round(F.avg(F.col("cancelled").cast("int")), 6).alias("cancel_share"),
        F.round(F.avg("edits"), 6).alias("avg_edits"),
    )


def latest(x: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def words_set(text: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements of two arrays without repeats."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0)


def normal_sql(text: Column) -> Column:
    """SQL in lower case with single spaces and no final semicolon: what pairs are matched by."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"\s*;$", "")


def lifecycle(state: Column, kind: Column, age_days: Column, score: Column) -> Column:
    """The next state: active schema items are stale after 7 days, SQL ones after 30, others never; stale ones are archived after 90.

    Then whatever is stale or archived, by now or before, is active again at a score of 0.8 within 14 days.
    """
    old = ((kind == "schema") & (age_days > 7)) | ((kind == "sql") & (age_days > 30))
    aged = F.when((state == "active") & old, "stale").when((state == "stale") & (age_days > 90), "archived").otherwise(state)
    return F.when(aged.isin("stale", "archived") & (score >= 0.8) & (age_days < 14), "active").otherwise(aged)


def attempt_rate(x: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Attempts of a key within the last ``seconds``, itself included."""
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(-seconds, 0)
    return x.withColumn("_s", second).withColumn("attempts", F.count("*").over(w)).drop("_s")


#: Edit fragments by what they touch, first match wins; then a comparison's column, with its table if it has one.
FRAGMENTS = (
    ("WHERE", r"^where\b"), ("AND", r"^and\b"), ("OR", r"^or\b"), ("JOIN", r"join"), ("GROUP_BY", r"group\s+by"), ("ORDER_BY", r"order\s+by"),
    ("HAVING", r"having"), ("AGGREGATE", r"(sum|count|avg|max|min)\s*\("),
)
COMPARED = r"(?:(\w+)\.)?(\w+)\s*(?:!=|>=|<=|<>|[=><])"


def fragment_kind(text: Column) -> Column:
    """What part of a query an edit touches, by its first word, else by what it holds; null for blank texts."""
    low, out = F.lower(F.trim(text)), F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(None))
    for kind, pattern in FRAGMENTS:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise("OTHER")


def compared_column(text: Column) -> Column:
    """struct<table,column>: the first column that an edit compares, in lower case; null without one, its table null where none is named."""
    part = lambda i: F.lower(F.regexp_extract(text, COMPARED, i))
    return F.when(part(2) != "", F.struct(F.nullif(part(1), F.lit("")).alias("table"), part(2).alias("column")))


def admitted(x: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """``x`` with ``admitted``: an attempt passes if fewer than ``limit`` admitted ones of its key lie within the last ``seconds``.

    Refused attempts do not count, so each verdict depends on those before it: rows of a key stream
    through one task in order of time, which holds the last ``limit`` admissions of one key only.
    """
    names = x.columns
    flow = x.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_at", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, deque()
        for batch in batches:
            out = []
            for k, at in zip(batch.column(key).to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if k != now:
                    now, recent = k, deque()
                while recent and recent[0] <= at - seconds * 1_000_000:
                    recent.popleft()
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(at)
            yield batch.select(names).append_column("admitted", pa.array(out, pa.bool_()))

    return flow.mapInArrow(run, T.StructType([*x.schema.fields, T.StructField("admitted", T.BooleanType())]))


def started(x: DataFrame, key: str, ts: str, limit: int, seconds: float = 60) -> DataFrame:
    """``x`` with ``started``: when each request begins if it waits until fewer than ``limit`` of its key began within the last ``seconds``.

    Requests of a key begin in order of arrival, equal arrivals by their other columns, so a request begins at
    its arrival or ``seconds`` after the one ``limit`` places before began, whichever is later. Rows of a key stream through
    one task in order of time, which holds the last ``limit`` starts of one key only. A request without a time begins at no time and takes no room.
    """
    names = x.columns
    flow = x.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_at", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, clock = None, None
        for batch in batches:
            out = []
            for k, at in zip(batch.column(key).to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if clock is None or k != now:
                    now, clock = k, StartClock(limit, seconds)
                out.append(None if at is None else clock.start(at))
            yield batch.select(names).append_column("started", pa.array(out, pa.timestamp("us", "UTC")))

    return flow.mapInArrow(run, T.StructType([*x.schema.fields, T.StructField("started", T.TimestampType())]))


class StartClock:
    """Start times of one key's requests on a clock in microseconds; ``recent`` holds the last ``limit``."""

    def __init__(self, limit: int, seconds: float, recent: list[int] = ()):
        if limit < 1:
            raise ValueError("a limit of at least one request")
        self.recent: deque[int] = deque(recent, maxlen=limit)
        self.wait = round(seconds * 1_000_000)

    def start(self, at: int) -> int:
        if len(self.recent) == self.recent.maxlen:
            at = max(at, self.recent[0] + self.wait)
        at = max(at, self.recent[-1]) if self.recent else at
        self.recent.append(at)
        return at


def normal_question(text: Column) -> Column:
    """Lower case, marks as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+", " "))


#: Sets that are put in order at once.
AT_ONCE = 500
#: Tokens are counted in so many buckets of hashes, a power of two: 8 MB, which the driver and each task may hold.
BUCKETS = 1 << 20


def _bucket_counts(counts: DataFrame) -> np.ndarray:
    """How often the tokens of each bucket stand in ``counts`` (token, df)."""
    found = counts.groupBy(F.xxhash64("token").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum(F.col("df").cast("long")).alias("df")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("df").to_numpy()
    return out


def _ordered(sets: DataFrame, common: np.ndarray, id_col: str) -> DataFrame:
    """(id, tokens, n): the tokens of each set, those of rare buckets first, then by hash. A set is ordered by itself, without a shuffle; empty ones go."""
    shared = sets.sparkSession.sparkContext.broadcast(common)
    x = sets.select(id_col, "tokens", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    schema = T.StructType([x.schema[id_col], x.schema["tokens"], T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                ids, tokens, hashes = batch.slice(start, AT_ONCE).columns
                n = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                h = hashes.flatten().to_numpy(zero_copy_only=False)
                order = np.lexsort((h, shared.value[h & (BUCKETS - 1)], np.repeat(np.arange(len(n)), n)))
                some = n[n > 0].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some)]).astype(np.int32), tokens.flatten().take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(n > 0)), lists, pa.array(some)], names=schema.names)

    return x.mapInArrow(run, schema)


def by_rarity(sets: DataFrame, counts: DataFrame, id_col: str) -> DataFrame:
    """(id, tokens, n): the tokens of each set, those rarest by ``counts`` (token, df) first; unknown ones are rarest of all.

    Tokens are counted by bucket. Any order that all sets share finds the same pairs; the rarer the first tokens, the fewer candidates meet.
    """
    return _ordered(sets, _bucket_counts(counts), id_col)


def candidate_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, key): pairs of sets that can have a Jaccard similarity of ``least``, and the hash of the first token by which each met, the same for most pairs of a group of near copies; ``a`` and ``b`` have (a or b, tokens by rarity, n).

    Similar sets share a token among the first n - ceil(least n) + 1 of each, so only those rare tokens meet. Of the pairs
    that meet, sizes too different go, and those whose tokens from the shared one on are too few for the overlap needed.
    A pair that shares one of the two tokens before, too, has met there already, so near copies do not meet once for each token.
    """

    def prefix(x: DataFrame, name: str) -> DataFrame:
        first = F.slice("tokens", 1, (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int"))
        x = x.select(name, "n", F.transform(first, lambda t: F.xxhash64(t)).alias("first"))
        x = x.select(name, F.col("n").alias(f"n_{name}"), "first", F.posexplode_outer("first").alias(f"at_{name}", "token"))  # outer: no filter that would put the tokens in order once more
        before = lambda k: F.get("first", F.col(f"at_{name}") - k).alias(f"{name}{k}")
        return x.select(name, f"n_{name}", f"at_{name}", "token", before(1), before(2))

    m, n = F.col("n_a"), F.col("n_b")
    needed = F.ceil(least / (1 + least) * (m + n) - 1e-9)
    left = 1 + F.least(m - F.col("at_a"), n - F.col("at_b")) - 1
    already = F.lit(False)
    for i in (1, 2):
        for j in (1, 2):
            already = already | F.coalesce(F.col(f"a{i}") == F.col(f"b{j}"), F.lit(False))
    met = prefix(a, "a").join(prefix(b, "b"), "token")
    met = met.where((n >= least * m - 1e-9) & (m >= least * n - 1e-9) & (left >= needed) & ~already)
    return met.groupBy("a", "b").agg(F.min_by("token", "at_a").alias("key"))


#: Sets of a block that a task holds, and sets that pass by them.
HELD, PASSING = 512, 4096


def _blocks(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, key) with ``i`` and ``j``: the block of the key in which they are compared; one block for all but large keys.

    Large keys are sent to all tasks, so that pairs of one key need not meet in one; there is at most one for each HELD pairs.
    """
    size = pairs.groupBy("key").agg(F.approx_count_distinct("a").alias("n_a"), F.approx_count_distinct("b").alias("n_b"))
    large = size.where((F.col("n_a") > HELD) | (F.col("n_b") > PASSING))
    part = lambda x, n, most: F.coalesce(F.pmod(F.xxhash64(x), F.ceil(F.col(n) / most)), F.lit(0).cast("long"))
    return pairs.join(F.broadcast(large), "key", "left").select("a", "b", "key", part("a", "n_a", HELD).alias("i"), part("b", "n_b", PASSING).alias("j"))


def _asked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whose sets the blocks of ``pairs`` (a, b, key) need: (key, i, j, a) that tasks hold and (key, i, j, b, others) that pass by them."""
    at = _blocks(pairs)
    return at.select(*BLOCK, "a").distinct(), at.groupBy(*BLOCK, "b").agg(F.collect_list("a").alias("others"))


BLOCK = ["key", "i", "j"]


def _compared(held: DataFrame, passing: DataFrame, least: float, sets: Callable[[DataFrame], DataFrame] = lambda x: x, once: bool = False) -> DataFrame:
    """(a, b, similarity) of those of the pairs asked for whose sets are ``least`` alike or more.

    A set goes once to each block that it is in, not once to each of its pairs; a task holds the sets of ``a`` of one block.
    ``held`` and ``passing`` have ``tokens``, or ``sets`` joins these to both at once; ``once``: a set that passes by again is no other.
    """
    kind, others = held.schema["a"].dataType, passing.schema["others"].dataType
    flow = held.withColumns({"b": F.lit(None).cast(passing.schema["b"].dataType), "others": F.lit(None).cast(others), "turn": F.lit(0)})
    flow = sets(flow.unionByName(passing.withColumns({"a": F.lit(None).cast(kind), "turn": F.lit(1)})))
    flow = flow.select(*BLOCK, "a", "b", "others", "tokens", "turn").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "turn")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", passing.schema["b"].dataType), T.StructField("similarity", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, seen = None, {}, set()
        for batch in batches:
            for start in range(0, batch.num_rows, HELD):
                out = ([], [], [])
                x = batch.slice(start, HELD)
                columns = [x.column(c).to_pylist() for c in (*BLOCK, "a", "b", "others")]
                words, ends = x.column("tokens").flatten().to_numpy(zero_copy_only=False), np.cumsum(x.column("tokens").value_lengths().to_numpy())
                for key, i, j, a_id, b_id, others, first, end in zip(*columns, [0, *ends[:-1]], ends, strict=True):
                    if (key, i, j) != now:
                        now, sets, seen = (key, i, j), {}, set()
                    own = frozenset(words[first:end])
                    if others is None:
                        sets[a_id] = own
                        continue
                    if once and b_id in seen:
                        continue
                    seen.add(b_id)
                    for other in others:
                        both = len(own & sets[other])
                        like = both / (len(own) + len(sets[other]) - both)
                        if like >= least:
                            for column, value in zip(out, (other, b_id, like), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=schema.names)

    return flow.mapInArrow(run, schema)


def similar_sets(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of all pairs of sets, of ``a`` (a, tokens) and ``b`` (b, tokens) without repeats, with a Jaccard similarity of ``least`` or more."""
    each = b.select(F.explode_outer("tokens").alias("token"), F.lit(1).alias("df"))  # outer: a filter would cut texts into tokens once more
    common = _bucket_counts(each.where("token is not null"))
    pairs = cut_lineage(candidate_pairs(_ordered(a, common, "a"), _ordered(b, common, "b"), least))  # read three times
    held, passing = _asked(pairs)
    return _compared(held.join(a.select("a", "tokens"), "a"), passing.join(b.select("b", "tokens"), "b"), least)


def newest_ids(x: DataFrame, key: str, k: int) -> DataFrame:
    """(key, ids): the ``k`` greatest ids of each key; a key that most rows have is ranked in slices first."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("id").desc()))
    some = x.select(key, "id").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = some.withColumn("r", rank(key, "slice")).where(F.col("r") <= k)
    some = some.withColumn("r", rank(key)).where(F.col("r") <= k)
    return some.groupBy(key).agg(F.collect_list("id").alias("ids"))


def similar_questions(asked: DataFrame, history: DataFrame, tokens: Callable[[Column], Column], least: float = 0.6, k: int = 5) -> DataFrame:
    """(ask_id, id, similarity, place): for each question (ask_id, question) the ``k`` closest of history (id, question).

    Equal normal texts come first, at 1; then those of Jaccard similarity of tokens ``least`` or more, the later id first.
    Texts that are equal once normal are compared once, and meet only by tokens that are rare in history.
    """
    own = lambda x: F.array_distinct(tokens(F.col("question")))
    a = asked.select("ask_id", normal_question("question").alias("a"), own(asked).alias("tokens"))
    h = history.select("id", normal_question("question").alias("b"), own(history).alias("tokens"))
    once = lambda x, name: x.groupBy(name).agg(F.first("tokens").alias("tokens"))
    near = similar_sets(once(a, "a"), once(h, "b"), least).where("a <> b").select("a", "b", F.round("similarity", 4).alias("similarity"), F.lit(1).alias("tier"))
    same = a.where("a <> ''").select("a").distinct().join(h.select("b").distinct(), F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("similarity"), F.lit(0).alias("tier"))
    found = same.unionByName(near).join(newest_ids(h, "b", k), "b").select("a", "similarity", "tier", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("tier", F.col("similarity").desc(), F.col("id").desc()))
    best = found.withColumn("place", place).where(F.col("place") <= k)
    return a.select("ask_id", "a").join(best, "a").select("ask_id", "id", "similarity", "place")


#: What no SQL holds, and words that make an appended tail an edit.
INVALID_SQL = r"(?i)==|;\s*[A-Za-z0-9]+\s*;|;\s*\d+\s*$|\b(wher|selec|form|formm|updte|delte)\b"
EDIT_WORDS = "select where and or order group having limit join union insert update delete".split()


def plain_sql(sql: Column) -> Column:
    """A text without comments."""
    return F.trim(F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", ""), r"--[^\n]*", ""))


def plausible_sql(sql: Column) -> Column:
    """Whether a text looks like SQL: not only comments, none of the usual slips."""
    plain = plain_sql(F.coalesce(sql, F.lit("")))
    return (plain != "") & ~plain.rlike(INVALID_SQL)


def meaningful_edit(before: Column, after: Column) -> Column:
    """Whether a change is more than a stray tail: comments aside, a tail counts only with a word of SQL."""
    a, b = plain_sql(before), plain_sql(after)
    tail = F.lower(F.trim(F.substring(b, F.length(a) + 1, F.length(b))))
    has_word = F.lit(False)
    for w in EDIT_WORDS:
        has_word = has_word | tail.contains(w)
    present = (F.coalesce(before, F.lit("")) != "") & (F.coalesce(after, F.lit("")) != "")
    return present & F.when(a == b, False).when(b.startswith(a), has_word).otherwise(True)


def history_plan(asked: DataFrame, history: DataFrame, tokens: Callable[[Column], Column], available: list[str], least: float = 0.6, k: int = 5) -> DataFrame:
    """(ask_id, plan, wins): the plan with most successes among the ``k`` closest of history (id, question, plan, ok); ties by name."""
    near = similar_questions(asked, history, tokens, least, k).select("ask_id", "id")
    won = near.join(history.select("id", "plan", "ok"), "id").where(F.col("ok") & F.col("plan").isin(available))
    count = won.groupBy("ask_id", "plan").agg(F.count("*").alias("wins"))
    best = F.min(F.struct((-F.col("wins")).alias("w"), "plan"))
    return count.groupBy("ask_id").agg(best.alias("b")).select("ask_id", "b.plan", (-F.col("b.w")).alias("wins"))


def hit_rates(asked: DataFrame, by: str) -> DataFrame:
    """(by, asked, hits, rate) of questions with a flag ``hit``."""
    return asked.groupBy(by).agg(F.count("*").alias("asked"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))
