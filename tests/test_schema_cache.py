"""Schemas that are held: lifetimes by a clock handed in, one load for many, changes seen at once."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import policy
from tallyforge.session import SchemaCache, SchemaChanged, schema_revision
from tallyforge.sources.connectors import Connections


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_lifetimes_and_revisions():
    clock, loads = Clock(), []
    cache = SchemaCache(seconds=10, clock=clock)
    ask = lambda revision="1": cache.get("db", "t", revision, lambda: loads.append(revision) or len(loads))
    assert [ask(), ask()] == [1, 1]
    clock.now = 9.9
    assert ask() == 1
    clock.now = 10
    assert ask() == 2
    assert [ask("2"), ask("2"), ask("1")] == [3, 3, 4]
    cache.drop("db", "t")
    assert ask() == 5
    cache.drop("db")
    assert ask() == 6 and cache.get("other", "t", "1", lambda: "x") == "x" and len(cache) == 2


def test_many_askers_share_one_load():
    cache, loads, go = SchemaCache(), [], threading.Event()

    def load():
        go.wait(20)
        loads.append(1)
        return "schema"

    with ThreadPoolExecutor(16) as pool:
        asked = [pool.submit(cache.get, "db", "t", "1", load) for _ in range(16)]
        go.set()
        assert {a.result() for a in asked} == {"schema"} and len(loads) == 1


def test_errors_are_not_held():
    cache = SchemaCache()
    with pytest.raises(ZeroDivisionError):
        cache.get("db", "t", "1", lambda: 1 // 0)
    assert cache.get("db", "t", "1", lambda: 7) == 7


def test_the_least_asked_goes():
    cache = SchemaCache(most=2)
    for name in ("a", "b", "a", "c"):
        cache.get("db", name, "1", lambda n=name: n)
    assert [cache.get("db", n, "1", lambda: "again") for n in ("a", "c", "b")] == ["a", "c", "again"]


def test_a_changed_table_is_seen_at_once(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    held = Connections(spark)
    held.create("files", "parquet", path=str(tmp_path))
    assert held.schema("files", "t").names == ["id"] and held.require_schema("files", "t").count() == 3
    spark.read.parquet(str(tmp_path / "t.parquet")).createOrReplaceTempView("held_table")
    seen = schema_revision(spark.table("held_table"))
    spark.range(2).withColumn("more", F.lit("x")).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert held.schema("files", "t").names == ["id"]  # within its lifetime
    with pytest.raises(SchemaChanged):
        held.require_schema("files", "t")
    assert held.require_schema("files", "t").count() == 2 and held.schema("files", "t").names == ["id", "more"]
    spark.read.parquet(str(tmp_path / "t.parquet")).createOrReplaceTempView("held_table")
    with pytest.raises(SchemaChanged):
        policy.run_query(spark, "SELECT count(*) FROM held_table", revisions={"held_table": seen})
    held.close("files")
    assert len(held.schemas) == 0
