"""The stored index, hybrid search, admission, and questions with answers worked out by hand."""

import random
import re
import zlib
from collections import Counter, deque
from datetime import date, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import questions
from tallyforge.functions import text as tx
from tallyforge.functions.patterns import AMBIGUITIES, STOP_WORDS
from tallyforge.operators import catalog, knowledge, learning, retrieval, routing, search
from tallyforge.plans.policy import _kind, physical_nodes
from tallyforge.sources.versions import Versions


@pytest.fixture(scope="module")
def index(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    x = search.PostingsIndex(spark, str(tmp_path_factory.mktemp("index")), fields=("lang",))
    x.build(docs, tx.english_tokens(F.col("text")))
    return x, docs


def test_a_search_reads_its_terms_only(index):
    x, docs = index
    found = x.search(["licensed", "version"], 10)
    scans = [n for n in physical_nodes(found._jdf.queryExecution().executedPlan()) if _kind(n) == "FileSourceScanExec"]
    read = [n.metadata().get("PartitionFilters").get() for n in scans] + [n.metadata().get("PushedFilters").get() for n in scans]
    assert any("bucket" in r for r in read) and any("In(term" in r for r in read)
    assert found.collect() == retrieval.bm25(docs, tx.english_tokens(F.col("text")), ["licensed", "version"], 10).collect()


def test_documents_are_replaced_at_once(index, spark):
    x, docs = index
    tokens = tx.english_tokens(F.col("text"))
    new = spark.createDataFrame([(3, "unheardof word", "en"), (9999, "unheardof unheardof", "en")], "doc_id long, text string, lang string")
    before = x.versions.current()
    x.replace(new, tokens)
    assert [r.doc_id for r in x.search(["unheardof"], 5).collect()] == [9999, 3]
    now = docs.where("doc_id <> 3").select("doc_id", "text", "lang").unionByName(new)
    assert x.search(["licensed", "unheardof"], 8).collect() == retrieval.bm25(now, tokens, ["licensed", "unheardof"], 8).collect()
    assert x.search(["licensed"], 8, F.col("lang") == "en").collect() == retrieval.bm25(now.where("lang = 'en'"), tokens, ["licensed"], 8).collect()
    x.delete(new.select("doc_id"))
    assert x.search(["unheardof"], 5).count() == 0 and x.versions.current() != before


def _bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_segments_equal_a_fresh_index(spark, sf, tmp_path, monkeypatch):
    """Random replacements and deletions, with merges of few and of all segments between them."""
    monkeypatch.setattr(search, "MOST_SEGMENTS", 3)
    rng, tokens = random.Random(6), F.split("text", " ")
    words = [f"w{i}" for i in range(12)]
    held = {i: " ".join(rng.choices(words, k=rng.randint(1, 9))) for i in range(40)}
    frame = lambda x: spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in x.items()], "doc_id long, text string, lang string")
    x = search.PostingsIndex(spark, str(tmp_path / "index"), fields=("lang",), buckets=4)
    x.build(frame(held), tokens)
    merged = 0
    for step in range(6):
        new = {rng.randint(0, 60): " ".join(rng.choices(words, k=4)) for _ in range(6)}
        x.replace(frame(new), tokens)
        held |= new
        gone = rng.sample(sorted(held), 2)
        x.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        held = {i: t for i, t in held.items() if i not in gone}
        merged += x.compact() is not None if step != 4 else x.compact(everything=True) is not None
        want = retrieval.bm25(frame(held), tokens, ["w1", "w2"], 50).collect()
        assert x.search(["w1", "w2"], 50).collect() == want
        want = retrieval.bm25(frame(held).where("lang = 'en'"), tokens, ["w3"], 50).collect()
        assert x.search(["w3"], 50, F.col("lang") == "en").collect() == want
    segments, dead = x._state()
    assert merged >= 2 and sum(s.n_docs for s in segments) == len(held) and len(segments) <= 4
    x.clean()
    assert len(x.versions.numbers()) == 1 and x.search(["w3"], 50, F.col("lang") == "en").collect() == want


def test_a_replacement_writes_in_proportion(spark, sf, tmp_path):
    docs, tokens = spark.read.parquet(f"{sf}/documents.parquet"), tx.english_tokens(F.col("text"))
    x = search.PostingsIndex(spark, str(tmp_path / "index"), buckets=2)
    x.build(docs, tokens)
    before, old = _bytes(tmp_path), x.search(["licensed"], 5)
    seen = old.collect()
    x.replace(docs.where("doc_id in (3, 5)"), tokens)
    assert _bytes(tmp_path) - before < 0.1 * before
    assert old.collect() == seen  # a reader of the version before sees all of it


def test_writers_that_start_together_have_folders_of_their_own(spark, tmp_path):
    a, b = (Versions(spark, str(tmp_path / "v")) for _ in range(2))
    inner = []

    def write(folder):
        inner.append(b.add(lambda f: spark.range(2).write.parquet(f"{f}/t")))
        spark.range(1).write.parquet(f"{folder}/t")

    n = a.add(write)
    assert n != inner[0] and a.numbers() == sorted([n, *inner])
    assert spark.read.parquet(f"{a.folder(n)}/t").count() == 1 and spark.read.parquet(f"{a.folder(inner[0])}/t").count() == 2


def test_an_index_of_nothing_answers(spark, tmp_path):
    x = search.PostingsIndex(spark, str(tmp_path / "none"), fields=("lang",))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    x.build(docs, tx.english_tokens(F.col("text")))
    assert x.search(["a"], 3).count() == 0
    x.replace(spark.createDataFrame([(1, "some words", "en"), (2, None, None)], docs.schema), tx.english_tokens(F.col("text")))
    assert [r.doc_id for r in x.search(["words"], 3).collect()] == [1] and x.search(["words"], 3, F.col("lang") == "de").count() == 0


def test_fields_of_the_dense_arm_win(spark):
    sparse = spark.createDataFrame([("a", 3.0, "s"), ("b", 2.0, "s")], "id string, score double, side string")
    dense = spark.createDataFrame([("b", 0.9, "d"), ("c", 0.8, None), ("c", 0.1, "later")], "id string, score double, side string")
    got = [(r.id, r.side) for r in search.hybrid(sparse, dense, 5, ["side"]).collect()]
    assert got == [("b", "d"), ("a", "s"), ("c", None)]
    assert search.arm_size(3) == 20 and search.arm_size(30) == 60


def test_targets_answer_though_one_fails(spark):
    ok = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "id string, score double")
    found, errors = search.search_targets(spark, {"x": lambda: ok, "y": lambda: spark.table("no_such_table")}, 1)
    assert [tuple(r) for r in found.collect()] == [("x", "a", 0.5)] and list(errors) == ["y"]


def test_a_union_fails_where_a_target_does(spark, sf, monkeypatch):
    """Rows of two targets are no result of a search over three; an error without a message has a name."""
    from tallyforge import queries_search, registry

    def broken(*_):
        raise OSError

    ok = spark.createDataFrame([("a", 0.5)], "id string, score double")
    assert search.search_targets(spark, {"x": lambda: ok, "y": broken}, 1)[1] == {"y": "OSError"}
    monkeypatch.setattr(queries_search, "hybrid_documents", broken)
    monkeypatch.setattr(queries_search, "hybrid_schema", lambda *_: ok)
    monkeypatch.setattr(queries_search, "hybrid_metrics", lambda *_: ok)
    with pytest.raises(search.TargetsFailed, match="documents: OSError"):
        registry.QUERIES["hybrid_union"](spark, sf)
    monkeypatch.setattr(queries_search, "hybrid_documents", lambda *_: ok)
    assert sorted(r.target for r in registry.QUERIES["hybrid_union"](spark, sf).collect()) == ["documents", "metrics", "schema"]


def test_admission_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), 1_700_000_000 + rng.randrange(600)) for i in range(400)] + [(500, None, 1_700_000_000)]
    x = spark.createDataFrame(rows, "id int, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.admitted for r in learning.admitted(x.repartition(5), "k", "ts", 3).collect()}
    for key in ("a", "b", None):
        recent: deque = deque()
        for s, i in sorted((s, i) for i, k, s in rows if k == key):
            while recent and recent[0] <= s - 60:
                recent.popleft()
            assert got[i] == (len(recent) < 3)
            if got[i]:
                recent.append(s)


NOW = "2026-07-15"  # a Wednesday


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("orders of the day before yesterday", "2026-07-13", "2026-07-14"), ("the day after tomorrow", "2026-07-17", "2026-07-18"), ("sales ytd", "2026-01-01", "2026-07-16"),
        ("quarter to date", "2026-07-01", "2026-07-16"), ("MTD revenue", "2026-07-01", "2026-07-16"), ("same period last year", "2025-07-15", "2026-07-16"), ("next month", "2026-08-01", "2026-09-01"),
        ("next week", "2026-07-20", "2026-07-27"), ("next quarter", "2026-10-01", "2027-01-01"), ("next year", "2027-01-01", "2028-01-01"), ("last quarter", "2026-04-01", "2026-07-01"),
        ("this week", "2026-07-13", "2026-07-16"), ("last 2 years", "2024-07-15", "2026-07-16"), ("2 weeks ago", "2026-07-01", "2026-07-08"), ("next 3 days", "2026-07-15", "2026-07-19"),
        ("上周的订单", "2026-07-06", "2026-07-13"), ("最近30天", "2026-06-15", "2026-07-16"), ("2024年2月", "2024-02-01", "2024-03-01"), ("2024年2月29日", "2024-02-29", "2024-03-01"),
        ("2024年2月30日", None, None), ("第三季度", "2026-07-01", "2026-10-01"), ("Q2季度销售额", "2026-04-01", "2026-07-01"), ("年初至今的收入", "2026-01-01", "2026-07-16"), ("no time", None, None), ("", None, None),
        ("last 99999999999 days", "1999-02-27", "2026-07-16"),
    ],
)
def test_times(spark, text, start, end):
    r = spark.createDataFrame([(text,)], "q string").select(tx.time_range(F.col("q"), NOW).alias("r")).first().r
    if text.startswith("last 9"):
        assert r.start is None or r.start <= date(2026, 7, 15) - timedelta(days=10_000 - 2)  # a number beyond all dates is held in bounds
    else:
        assert (r and r.start and str(r.start), r and r.end and str(r.end)) == (start, end)


@pytest.mark.parametrize(
    ("text", "intent"),
    [
        ("funnel of signups", "FUNNEL"), ("monthly revenue trend", "TIME_SERIES"), ("count of monthly orders", "TIME_SERIES"), ("compare a vs b", "COMPARISON"), ("who ordered what across tables", "JOIN"),
        ("how many users", "AGGREGATE"), ("list users", "SELECT"), ("hello", "UNKNOWN"), ("", "UNKNOWN"), ("统计各个部门的人数", "AGGREGATE"), ("查询订单", "SELECT"), ("用户留存率的趋势", "FUNNEL"), ("对比两个月的销售额", "COMPARISON"),
    ],
)
def test_intents(spark, text, intent):
    assert spark.createDataFrame([(text,)], "q string").select(tx.intent(F.col("q")).alias("i")).first().i == intent


@pytest.mark.parametrize(
    ("text", "orders"),
    [("order by t.price desc", ["t.price DESC"]), ("sort by a asc and the highest b", ["a ASC", "b DESC"]), ("ordered by name,", ["name ASC"]), ("按销售额降序排列", ["销售额 DESC"]), ("nothing", [])],
)
def test_orders(spark, text, orders):
    assert spark.createDataFrame([(text,)], "q string").select(questions.orders(F.col("q")).alias("o")).first().o == orders


def test_small_values(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(tx.token_estimate(F.lit(x))) for x in ("a b", "", "abcdefgh", "中文字", "\t\n ", None)] == [1, 0, 2, 2, 2, 0]
    state = lambda *x: one(learning.lifecycle(*map(F.lit, x)))
    assert state("active", "schema", 10, 0.8) == "active" and state("active", "schema", 10, 0.5) == "stale" and state("active", "sql", 10, 0.1) == "active"
    assert state("archived", "term", 3, 0.9) == "active" and state("active", "term", 400, 0.1) == "active" and state("stale", "sql", 91, 0.9) == "archived"
    score = lambda n, c, q, t=False: one(catalog.name_score(F.lit(n), F.lit(c), F.lit(q), t))
    assert score("total", "the amount paid", "amount") == 0.75 and score("total", "the amount paid", "amount", True) == 0.7
    assert score("order_total", None, "total") == 0.65 and score("id", None, "user id") == 0.6 and score("id", None, "user id", True) == 0.65 and score("a", "", "z") == 0.0
    assert len(tx.STOP_WORDS) == len(set(tx.STOP_WORDS)) == 98


def test_a_plan_in_need_gets_a_better_one(spark):
    runs = [("good", True, 0, 5)] * 12 + [("poor", False, 3, 1)] * 12 + [("fair", True, 0, 4)] * 5
    x = spark.createDataFrame(runs, "plan string, ok boolean, edits int, rating int")
    assert [(r.plan, r.suggested) for r in routing.suggested_plans(x).collect()] == [("poor", "good")]
    assert [r.suggested for r in routing.suggested_plans(x.where("plan = 'poor'")).collect()] == [None]


def test_an_absent_question_finds_no_answer(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert retrieval.cached_answers(x.where("vec_id = 77"), x, 0.05).count() == 0
    assert [tuple(r) for r in retrieval.cached_answers(x.where("vec_id = 3"), x.where("vec_id < 3"), 0.05).collect()] == []


def test_a_stream_is_admitted_as_a_table(spark, tmp_path):
    from tallyforge.streaming.admission import admitted_stream

    rng = random.Random(9)
    rows = [(rng.choice("ab"), 1_700_000_000 + i * 7) for i in range(120)]
    x = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    for part in (0, 1):  # two triggers, in order of time
        x.where((F.unix_timestamp("ts") < 1_700_000_420) == (part == 0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = admitted_stream(stream, "k", "ts", 2).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.key, str(r.ts), r.admitted) for r in spark.table("admitted").collect())
    assert got == sorted((r.k, str(r.ts), r.admitted) for r in learning.admitted(x, "k", "ts", 2).collect())


def test_history_names_a_plan(spark):
    held = [(1, "count orders by city", "a", True), (2, "count orders by town", "b", True), (3, "count orders by city!", "b", True), (4, "Count orders, by city", "b", False), (5, "other words", "c", True)]
    history = spark.createDataFrame(held, "id int, question string, plan string, ok boolean")
    asked = spark.createDataFrame([(1, "count orders by city"), (2, "nothing alike"), (3, "")], "ask_id int, question string")
    assert [tuple(r) for r in learning.history_plan(asked, history, tx.english_tokens, ["a", "b"], 0.5).collect()] == [(1, "b", 2)]
    rates = learning.hit_rates(spark.createDataFrame([("x", True), ("x", False), ("y", False)], "k string, hit boolean"), "k")
    assert sorted(map(tuple, rates.collect())) == [("x", 2, 1, 0.5), ("y", 1, 0, 0.0)]


def test_entities_have_places(spark):
    text = "a \"a\" and ' b c ' or 「中文」 and \"\" end"
    got = spark.createDataFrame([(text,), ("",), (None,)], "q string").select(questions.quoted_entities(F.col("q")).alias("e")).collect()
    assert [(x.value, text[x.first : x.past]) for x in got[0].e] == [("a", "a"), ("b c", " b c "), ("中文", "中文")] and got[1].e == []
    tables = spark.createDataFrame([("查询订单表的金额",), ("from orders, and the users table",)], "q string").select(questions.named_tables(F.col("q")).alias("t")).collect()
    assert "订单" in tables[0].t[0] and tables[1].t == ["orders", "users"]


def test_rules_and_items_become_documents(spark):
    rules = spark.createDataFrame([("r1", "net only", "sum", ["precision=2", "require=net"]), ("r2", None, None, [])], "rule string, description string, pattern string, directives array<string>")
    assert [r.text for r in knowledge.rule_documents(rules, "shop").orderBy("doc_id").collect()] == ["业务规则: r1。描述: net only。条件: sum。约束: precision=2; require=net。", "业务规则: r2。"]
    items = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "x", 2), ("b", "z", 1), (None, "z", 1)], "k string, c string, u int")
    assert sorted((r.k, r.version, r.contents, r.u) for r in knowledge.merged_items(items, "k", "c", "u").collect()) == [("a", 3, ["y", "x"], 3), ("b", 1, ["z"], 1)]


def test_limits_in_chinese_and_days_that_are_none(spark):
    texts = {"前10名客户": 10, "取前 5 条": 5, "只要3笔": 3, "限制20": 20, "限量 7": 7, "top 前 9 个订单 top 4": 4, "first 6 rows": 6, "前10名 of the first 3 rows and a long tail of english words": 3, "没有": None}
    df = spark.createDataFrame(list(texts.items()), "q string, want long")
    assert {r.q: r.n for r in df.select("q", tx.limit_value(F.col("q")).alias("n")).collect()} == texts
    days = spark.createDataFrame([("2024年2月30日",), ("2024年2月29日",), ("plain",)], "q string").select("q", tx.time_range(F.col("q"), "2026-07-15").alias("r")).collect()
    assert [r.r is None for r in days] == [True, False, True]


def test_an_index_cuts_texts_once_and_counts_them_by_parts(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(text):
        read.add(1)
        return text.split() if text is not None else None

    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b")], "doc_id long, text string")
    index = search.PostingsIndex(spark, str(tmp_path / "once"))
    index.build(docs, tokens(F.col("text")))
    assert read.value == 4
    assert sorted(map(tuple, index.documents().collect())) == [(1, 3), (2, 0), (3, 0), (4, 1)]
    assert sorted((r.doc_id, r.len, r.term, r.tf) for r in index.postings().collect()) == [(1, 3, "a", 2), (1, 3, "b", 1), (4, 1, "b", 1)]


def test_terms_are_counted_some_tokens_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2_000)), "tokens": [[f"t{i % 7}"] * 200 + ["u"] for i in range(2_000)]})
    parts = list(search._counted(())(iter([batch])))
    rows = [r for p in parts for r in p.to_pylist() if r["term"] is not None]
    assert len(parts) > 1 and sorted((r["doc_id"], r["term"], r["tf"]) for r in rows) == sorted(x for i in range(2_000) for x in ((i, f"t{i % 7}", 200), (i, "u", 1)))


def test_a_question_is_read_once_however_many_ask_it(spark):
    """Equal questions are read once, null among them, and each row gets what its own question says."""
    asked = ["total of 'x' 3 days ago", "按地区统计平均订单 最近", "show vip orders sorted by price desc, recently", "next 2 weeks by region", "2024 q2", "rank per city in the past", None, ""]
    x = spark.createDataFrame([(i, asked[i % len(asked)]) for i in range(400)], "id long, q string")
    got = questions.with_parsed(x, F.col("q"), NOW)
    want = {r.id: r.p for r in x.select("id", questions.parsed(F.col("q"), NOW).alias("p")).collect()}
    assert {r.id: r.p for r in got.collect()} == want and len(want) == 400
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    reads = [i for i, line in enumerate(lines) if "RLIKE" in line]
    assert reads and any("Aggregate" in line for line in lines[max(reads) :])


def test_patterns_put_together_find_what_each_finds(spark):
    """Aspects, and orders by the first direction said, as the single patterns give them."""
    asked = ["按地区 平均 排名", "show vip customers lately by region", "average price ranking by region, past 3 days", "最近 3 天 大额订单", "recent 5 days top-tier", "历史 2 年", "Big ORDERS historical", "", None]
    x, low = spark.createDataFrame([(q,) for q in asked], "q string"), F.lower("q")
    for kind in ("AGGREGATE", "SELECT"):
        each = [F.when(low.rlike(p) & F.lit(a != "aggregation" or kind == "AGGREGATE"), a) for a, p in AMBIGUITIES]
        rows = x.select(questions.ambiguities(F.col("q"), F.lit(kind)).alias("got"), F.array_distinct(F.array_compact(F.array(*each))).alias("want")).collect()
        assert all(r.got == r.want for r in rows) and sum(map(len, (r.got for r in rows))) >= 8
    of = spark.createDataFrame([("highest price, sorted by price asc and lowest cost.",), ("no order",), (None,)], "q string").select(questions.orders(F.col("q")).alias("o")).collect()
    assert [r.o for r in of][1:] == [[], None] and "price ASC" in of[0].o and "cost ASC" in of[0].o


def test_english_tokens_are_cut_and_sifted_in_one_pass_each(spark):
    """One class of characters and one filter over the words; letters that only lower case makes ASCII part words as before."""
    texts = ["The Quick_fox's 2nd\tjump, and  A  nap!", "café naïve 中文 a\U0001f600b", "İstanbul 5K ſtop ª² Ａ ١", "__ _ 0", "a\nb\r\nc\x00d e", " ,.", "", "of the", None]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "id long, text string").select("id", tx.english_tokens(F.col("text")).alias("t"))
    want = [None if t is None else [w for w in re.sub(r"[^A-Za-z0-9_]+", " ", t).lower().split(" ") if w and w not in STOP_WORDS] for t in texts]
    assert sorted((r.id, r.t) for r in x.collect()) == sorted(list(enumerate(want)) * 2) and ["stanbul", "5", "top"] in want
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") == 1 and "[^" not in plan


def test_counted_terms_come_in_the_order_they_are_stored(monkeypatch):
    """Each part is one run by bucket and term, its documents first; null and repeated ids, null fields and texts of no words are kept."""
    monkeypatch.setattr(search, "AT_ONCE", 40)
    rng = random.Random(3)
    docs = [(i % 17 or None, rng.choice(["en", None]), rng.choice([None, [], rng.choices(["é", "中", "_", *map(str, range(30))], k=rng.randint(1, 60))])) for i in range(60)]
    kinds = pa.schema({"doc_id": pa.int64(), "lang": pa.string(), "tokens": pa.list_(pa.string())})
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, d, strict=True)) for d in some], kinds) for some in (docs, [(1, "en", None), (1, "en", [])])]
    parts = [p.to_pylist() for p in search._counted(("lang",), 4)(iter(batches))]
    key = lambda r: (r["bucket"], (r["term"] or "").encode())
    assert len(parts) > 5 and all(p == sorted(p, key=key) for p in parts)
    got = Counter((r["doc_id"], r["lang"], r["len"], r["term"], r["tf"], r["bucket"]) for p in parts for r in p)
    want = Counter()
    for i, lang, words in [*docs, (1, "en", None), (1, "en", [])]:
        n = len(words or [])
        want[i, lang, n, None, 0, -1] += 1
        want.update((i, lang, n, t, tf, zlib.crc32(t.encode()) % 4) for t, tf in Counter(words or []).items())
    assert got == want
