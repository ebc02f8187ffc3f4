"""The vector index against scans, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import retrieval, vectors
from tallyforge.plans.policy import _kind, physical_nodes


@pytest.fixture(scope="module")
def clustered(spark):
    rng = random.Random(8)
    centers = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.08) for c in centers[i % 12]], i % 5) for i in range(1500)]
    rows += [(2000 + i, rows[0][1], 1) for i in range(30)]  # equal vectors: ties go by id
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").cache(), centers


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    x = vectors.VectorIndex(spark, str(tmp_path_factory.mktemp("vectors")), fields=("label",))
    x.build(clustered[0], lists=12)
    return x


def test_equal_to_a_scan(index, clustered):
    rows, centers = clustered
    rng = random.Random(1)
    for q in [centers[3], [-v for v in centers[0]], [rng.gauss(0, 1) for _ in range(16)]]:
        for k, where in ((5, None), (40, None), (7, F.col("label") == 3)):
            assert index.search(q, k, where).collect() == retrieval.cosine_top(rows, q, k, where).collect()
    assert index.search(centers[0], 5000).collect() == retrieval.cosine_top(rows, centers[0], 5000).collect()


def test_lists_that_hold_nothing_nearer_are_not_read(index, clustered):
    q = clustered[1][4]
    lists = index.lists_for(q, 10)
    assert index.share_read(lists) < 0.3 and 0 < len(lists) < len(index.balls())
    scans = [n for n in physical_nodes(index.search(q, 10)._jdf.queryExecution().executedPlan()) if _kind(n) == "FileSourceScanExec"]
    assert scans and all("list" in n.metadata().get("PartitionFilters").get() for n in scans)
    folders = {r[0].split("list=")[1].split("/")[0] for r in index.vectors(lists).select(F.input_file_name()).distinct().collect()}
    assert folders == {str(i) for i in lists}


def test_bounds_hold_for_every_vector(index, clustered):
    q = clustered[1][7]
    held = index.vectors([b.list for b in index.balls()]).select("list", (1 - retrieval.cosine(F.col("embedding"), q)).alias("d")).collect()
    low = {b.list: index.least_distance(b, q) for b in index.balls()}
    assert len(held) == 1530 and all(r.d >= low[r.list] - 1e-6 for r in held)


def test_nearest_within_equals_all_pairs(index, clustered):
    rows, centers = clustered
    asked = rows.where("vec_id in (0, 1, 17, 2003)").select(F.col("vec_id").alias("asked"), "embedding")
    want = retrieval.cached_answers(rows.where("vec_id in (0, 1, 17, 2003)"), rows, 0.05).collect()
    assert sorted(index.nearest_within(asked, 0.05).collect()) == sorted(want) and len(want) == 4
    far = asked.sparkSession.createDataFrame([(1, [-v for v in centers[0]])], "asked long, embedding array<double>")
    assert index.nearest_within(far, 1e-4).count() == 0


def test_few_vectors_and_none(spark, tmp_path):
    x = vectors.VectorIndex(spark, str(tmp_path / "few"))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    x.build(empty)
    assert x.search([1.0, 0.0], 3).count() == 0
    y = vectors.VectorIndex(spark, str(tmp_path / "some"))
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    y.build(some)
    assert y.search([1.0, 0.0], 3).collect() == retrieval.cosine_top(some, [1.0, 0.0], 3).collect()


def test_a_length_is_worked_out_once_for_a_vector(spark):
    """Not once for each component, which takes the square of the dimension."""
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, None), (7, [])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", vectors._unit(F.col("embedding")).alias("unit"))
    assert {r.vec_id: r.unit for r in x.collect()} == {1: [0.6, 0.8], 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1, plan
