"""Set-similarity joins, exact percentiles and waiting admission against plain versions."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as tx
from tallyforge.operators import alike, evaluation, learning
from tallyforge.streaming import admission


def sets_of(seed, n, words=40):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]  # a few words are in most sets
    out = {i: sorted(set(rng.choices([f"w{j}" for j in range(words)], weights, k=rng.randint(0, 12)))) for i in range(n)}
    return out | {n + 1: ["w0"], n + 2: []}


def plain_pairs(a, b, least):
    return {(i, j) for i, x in a.items() for j, y in b.items() if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least - 1e-12}


@pytest.mark.parametrize("least", [0.2, 0.5, 0.6, 0.8, 1.0])
def test_similar_sets_equal_all_pairs(spark, least):
    a, b = sets_of(1, 60), sets_of(2, 90)
    frame = lambda x, name: spark.createDataFrame(list(x.items()), f"{name} long, tokens array<string>")
    got = learning.similar_sets(frame(a, "a"), frame(b, "b"), least).collect()
    assert {(r.a, r.b) for r in got} == plain_pairs(a, b, least) and len(got) == len({(r.a, r.b) for r in got})
    assert all(abs(r.similarity - len(set(a[r.a]) & set(b[r.b])) / len(set(a[r.a]) | set(b[r.b]))) < 1e-9 for r in got)


def test_frequent_tokens_bring_no_pairs_together(spark):
    """A word that all sets share is the last of each, beyond the prefix."""
    rows = [(i, ["every", *(f"own{i}-{j}" for j in range(9))]) for i in range(200)] + [(500, ["every", *(f"own7-{j}" for j in range(9))])]
    x = spark.createDataFrame(rows, "a long, tokens array<string>")
    counts = x.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    left, right = learning.by_rarity(x, counts, "a"), learning.by_rarity(x.withColumnRenamed("a", "b"), counts, "b")
    met = learning.candidate_pairs(left, right, 0.8)
    assert met.where("a <> b").count() == 2 and met.count() == 203
    assert left.where("a = 3").first().tokens[-1] == "every"


def test_questions_asked_by_thousands(spark):
    """Equal questions are compared once; each asked one gets the newest of equal ones."""
    history = spark.createDataFrame([(i, "How many Orders?") for i in range(3000)] + [(5000, "how many orders shipped"), (5001, "other things")], "id long, question string")
    asked = spark.createDataFrame([(i, "how many orders") for i in range(2000)] + [(9000, "nothing alike"), (9001, None), (9002, "  ")], "ask_id long, question string")
    got = learning.similar_questions(asked, history, tx.english_tokens, 0.4, 3)
    by = {r.ask_id: r.ids for r in got.groupBy("ask_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "similarity"))).alias("ids")).collect()}
    assert len(by) == 2000 and all([tuple(x) for x in v] == [(1, 2999, 1.0), (2, 2998, 1.0), (3, 2997, 1.0)] for v in by.values())


def plain_rank(values, p):
    v = sorted(x for x in values if x is not None and not math.isnan(x)) + [math.nan] * sum(x is not None and math.isnan(x) for x in values)
    from fractions import Fraction

    return v[max(1, math.ceil(Fraction(str(p)) * len(v))) - 1] if v else None


@pytest.mark.parametrize("buckets", [4096, 2, 3])
def test_percentiles_equal_sorting(spark, monkeypatch, buckets):
    monkeypatch.setattr(evaluation, "BUCKETS", buckets)
    rng = random.Random(buckets)
    n = 400 if buckets < 10 else 3000
    groups = {
        "hot": [rng.gauss(0, 1) * 10 ** rng.randint(-3, 3) for _ in range(n)], "ties": [1.0, 2.0] * 50, "one": [5.5], "none": [None, None], None: [3.0, None, 1.0, 2.0],
        "odd": [math.nan, math.inf, -math.inf, 0.0, -0.5, 1.7976931348623157e308, -1.7976931348623157e308], "inf": [math.inf, math.inf, 1.0], "nan": [math.nan] * 3, "low": [-math.inf] * 3 + [1.0],
        "tiny": [0.0, 5e-324, 1e-323, 2.0],
    }
    points = {"p0": 0.0, "p7": 0.07, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    points = points if buckets > 2 else {"p50": 0.5}
    x = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    got = {r.g: r for r in evaluation.exact_percentiles(x, ["g"], "v", points).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in points.items():
            want = plain_rank(vs, p)
            assert (got[g][name] is None) == (want is None) and (want is None or got[g][name] == want or (math.isnan(want) and math.isnan(got[g][name])))


def test_percentiles_over_all_rows_and_none(spark):
    x = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert tuple(evaluation.exact_percentiles(x, [], "v", {"a": 0.5, "b": 0.951}).first()) == (499.0, 950.0)
    empty = evaluation.exact_percentiles(x.where("v < 0").withColumn("g", F.lit(1)), ["g"], "v", {"a": 0.5})
    assert empty.count() == 0


def plain_starts(arrivals, limit, wait):
    """A queue by hand: time goes on to the next moment at which a request may begin."""
    out = []
    for at in arrivals:
        now = max([at, *out[-1:]])
        while sum(s > now - wait for s in out) >= limit:
            now = min(s for s in out if s > now - wait) + wait
        out.append(now)
    return out


def test_clock_equals_a_queue_by_hand():
    rng = random.Random(3)
    for _ in range(200):
        limit, wait = rng.randint(1, 4), rng.randint(1, 9)
        arrivals = sorted(rng.randint(0, 40) for _ in range(rng.randint(0, 25)))
        clock = learning.StartClock(limit, wait / 1_000_000)
        assert [clock.start(a) for a in arrivals] == plain_starts(arrivals, limit, wait)
    with pytest.raises(ValueError):
        learning.StartClock(0, 1)


def test_requests_wait_for_room(spark, tmp_path):
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rng = random.Random(5)
    rows = [(k, base + timedelta(seconds=rng.randint(0, 300)), i) for i, k in enumerate(rng.choices(["a", "b", None], k=120))] + [("a", None, 999)]
    x = spark.createDataFrame(rows, "who string, at timestamp, i long")
    got = learning.started(x, "who", "at", 3, 60).withColumn("begun", F.unix_micros("started")).collect()
    assert len(got) == 121 and [r.begun for r in got if r.i == 999] == [None]
    for who in ("a", "b", None):
        mine = sorted((t, i) for k, t, i in rows if k == who and t)
        want = plain_starts([round((t - base).total_seconds()) for t, _ in mine], 3, 60)
        assert [r.begun // 1_000_000 - round(base.timestamp()) for r in sorted((r for r in got if r.who == who and r.begun), key=lambda r: (r.at, r.i))] == want

    # The same requests as a stream of two triggers, the second later than the first.
    cut = base + timedelta(seconds=150)
    for n, part in enumerate((x.where(F.col("at") < F.lit(cut)), x.where(F.col("at") >= F.lit(cut)))):
        part.where("who is not null").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    flow = spark.readStream.schema(x.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = admission.started_stream(flow, "who", "at", 3, 60).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.key, r.started.timestamp()) for r in streamed.collect()) == sorted((r.who, r.started.timestamp()) for r in got if r.who and r.started)


def test_near_copies_meet_once_and_sets_are_not_sent_with_each_pair(spark):
    """Copies and near copies: pairs meet by few tokens, and a set goes once to each block, not once to each of its pairs."""
    rng, words = random.Random(3), [f"v{i}" for i in range(60)]
    rows = {i: sorted(set(words) - set(rng.sample(words, i % 4))) for i in range(400)}
    x = spark.createDataFrame(list(rows.items()), "a long, tokens array<string>")
    y = x.withColumnRenamed("a", "b")
    counts = x.select(F.explode("tokens").alias("token"), F.lit(1).alias("df"))
    pairs = learning.candidate_pairs(learning.by_rarity(x, counts, "a"), learning.by_rarity(y, counts, "b"), 0.8).cache()
    sets = pairs.select("key", "a").distinct().count() + pairs.select("key", "b").distinct().count()
    assert pairs.count() > 100_000 and sets < pairs.count() / 10
    blocks = learning._blocks(pairs).groupBy("key", "i", "j").agg(F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b")).agg(F.max("n_a"), F.max("n_b")).first()
    assert blocks[0] < 2 * learning.HELD and blocks[1] <= learning.PASSING
    got = learning.similar_sets(x, y, 0.9).collect()
    assert {(r.a, r.b) for r in got} == plain_pairs(rows, rows, 0.9) and len(got) == len({(r.a, r.b) for r in got})
    plan = learning.similar_sets(x, y, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert all("tokens" not in line for line in plan.splitlines() if "Aggregate" in line) and plan.count("MapInArrow") == 1


def test_similar_texts_meet_all_with_all(spark, sf):
    """Each document is held against every other, whatever its id."""
    from tallyforge.queries import QUERIES

    texts = {r.doc_id: set(re.split(r"\s+", (r.text or "").lower(), flags=re.ASCII)) - {""} for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["similar_texts"](spark, sf).collect()
    assert {(r.a, r.b) for r in found} == {(a, b) for a, b in plain_pairs(texts, texts, 0.8) if a != b} and len(found) == len({(r.a, r.b) for r in found})
    assert any(r.a % 20 for r in found)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_pairs_within_a_table_equal_all_pairs(spark, monkeypatch, least):
    """Equal sets in slices, several groups of bitmaps, ids that occur twice or are null, sets that are empty or null."""
    monkeypatch.setattr(alike, "SLICE", 3)
    monkeypatch.setattr(alike, "GROUP", 7)
    rows = [*sets_of(5, 70).items(), *((200 + i, ["copy", "of", "one"]) for i in range(8)), (3, ["w0", "w1"]), (4, ["copy", "of", "one"]), (200, ["copy", "of", "one"]), (None, ["copy", "of", "one"]), (300, None)]
    got = alike.similar_pairs(spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3), least).collect()
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    full = [(i, x) for i, x in rows if i is not None and x]
    want = Counter((i, j, round(like(x, y), 9)) for i, x in full for j, y in full if i != j and like(x, y) >= least)
    assert Counter((r.a, r.b, round(r.similarity, 9)) for r in got) == want and len(want) > 50


def test_bitmaps_differ_by_no_more_than_sets():
    rng = np.random.default_rng(8)
    sets = [rng.integers(-(2**62), 2**62, size=n) for n in (1, 63, 64, 65, 100, 130, 500, 700, 5000, 6000)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(-(2**62), 2**62, size=len(s) // 10)]) for s in sets if len(s) > 50]
    n = np.array([len(s) for s in sets])
    bits = alike._bitmaps(np.concatenate(sets), n)
    widths = np.array([len(b.as_py()) // 8 for b in bits])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    told = alike._differing(np.frombuffer(b"".join(b.as_py() for b in bits), np.uint64), np.cumsum(widths) - widths, widths, a, b)
    real = np.array([len(set(sets[i]) ^ set(sets[j])) for i, j in zip(a, b, strict=True)])
    assert (told <= real).all() and (told[a == b] == 0).all() and (told % 2 == real % 2).all()
    assert (told > 0)[a != b].all() and set(widths) == {1, 2, 4, 8, 16, 64}


def test_pairs_that_only_share_a_rare_token_go_without_their_sets(spark):
    """Sets are sent for pairs alone whose bitmaps leave room for a likeness, and equal sets count as one."""
    rows = [(i, [f"own{i}-{j}" for j in range(40)] + [f"rare{i % 4}"]) for i in range(200)] + [(1000 + i, [f"own7-{j}" for j in range(40)] + ["rare3"]) for i in range(30)]
    rows.append((2000, [f"own7-{j}" for j in range(38)] + ["rare3"]))
    sets = alike.distinct_sets(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.8)
    assert sets.count() == 201 and sets.agg(F.max(F.size("ids"))).first()[0] == 31
    # Put in front of all others, the shared tokens bring pairs together.
    met = alike.meeting_pairs(sets.withColumn("first", F.concat(F.array(F.expr("id % 4")), "first")), 0.8).cache()
    kept = alike.sifted_pairs(met, sets, 0.8).collect()
    assert met.count() > 4000 and len(kept) == 1
    named = {r.id for r in sets.where(F.col("set").isin(kept[0].a, kept[0].b)).collect()}
    assert 2000 in named and (named - {2000}) <= {7, *range(1000, 1030)}


def test_pairs_of_one_key_need_not_lie_in_one_task(spark):
    """A group of copies is dealt by its sets, not by the key that all its pairs have."""
    pairs = spark.range(400_000).select((F.col("id") % 2000).alias("a"), F.floor(F.col("id") / 2000).alias("b"), F.expr("id % 1 + 7 AS key")).repartition(8)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # what few pairs would hide
    try:
        dealt = learning._blocks(pairs).groupBy("i", F.spark_partition_id().alias("task")).count().collect()
        assert len({r.task for r in dealt}) == 8 and len({r.i for r in dealt}) > 1 and sum(r["count"] for r in dealt) == 400_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
