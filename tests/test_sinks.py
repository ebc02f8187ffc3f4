"""Sinks that take each batch once: streams stopped anywhere equal a batch job."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.streaming import sinks

BASE = datetime(2024, 1, 1)
PAIRS = "question string, database string, sql string, quality double, ts timestamp, gone boolean"


def pairs(n, start=0):
    return [(f"q{i % 5}", None if i % 4 == 3 else "db", f"select {i}", i / 10, BASE + timedelta(minutes=i), i % 11 == 10) for i in range(start, start + n)]


def latest(rows):
    last = {}
    for r in sorted(rows, key=lambda r: r[4]):
        last[r[:2]] = r
    return sorted((r for r in last.values() if not r[5]), key=str)


def held(sink):
    return sorted((tuple(r) for r in sink.read().collect()), key=str)


def feed(spark, folder, rows, name):
    spark.createDataFrame(rows, PAIRS).coalesce(1).write.parquet(f"{folder}/{name}")
    return spark.readStream.schema(PAIRS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("where", ["before the write", "before the ledger", "after the ledger"])
def test_a_stream_that_stops_and_starts_again(spark, tmp_path, monkeypatch, where):
    folder, rows = str(tmp_path / "in"), []
    for n in range(3):
        rows += pairs(20, 20 * n)
        flow = feed(spark, folder, pairs(20, 20 * n), n)
    sink = sinks.pair_sink(spark, str(tmp_path / "pairs"))
    enter, write = sink.enter, sink.write

    def stop(batch):
        if batch == 1 and where == "after the ledger":
            enter(batch)
        if batch == 1:
            raise RuntimeError("stopped here")
        enter(batch)

    def stop_early(x, batch):
        if batch == 1:
            raise RuntimeError("stopped here")
        return write(x, batch)

    monkeypatch.setattr(sink, *(("write", stop_early) if where == "before the write" else ("enter", stop)))
    with pytest.raises(Exception, match="stopped here"):
        sink.start(flow, str(tmp_path / "c")).awaitTermination(120)
    taken = 40 if where == "after the ledger" else 20
    again = sinks.pair_sink(spark, str(tmp_path / "pairs"))
    if where != "after the ledger":
        assert len(again.ledger()) == 1 and again.read().count() > 0
    else:
        assert len(again.ledger()) == taken // 20
    again.start(flow, str(tmp_path / "c")).awaitTermination(120)
    assert len(again.ledger()) == 3 and held(again) == latest(rows)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    sink = sinks.audit_sink(spark, str(tmp_path / "audit"))
    frame = lambda n: spark.createDataFrame([(f"a{n}", "ask", f"{i}", True, BASE) for i in range(4)], sink.schema)
    assert sink.write(frame(0), 0) and sink.write(frame(1), 1) and not sink.write(frame(9), 1)
    assert sink.read().groupBy("actor").count().orderBy("actor").collect() == [("a0", 4), ("a1", 4)]
    assert sink.merge() is not None and sink.merge() is None and not sink.write(frame(9), 0)
    sink.clean()
    assert sink.ledger() == [] and sink.read().count() == 8 and not sink.write(frame(9), 1) and sink.write(frame(2), 2)
    assert sink.read().count() == 12


def test_merging_keeps_the_last_of_each_key(spark, tmp_path):
    sink = sinks.pair_sink(spark, str(tmp_path / "pairs"))
    rows = []
    for n in range(4):
        rows += pairs(9, 9 * n)
        sink.write(spark.createDataFrame(pairs(9, 9 * n), PAIRS), n)
        if n % 2:
            sink.merge()
            sink.clean()
        assert held(sink) == latest(rows)
    assert sinks.pair_sink(spark, str(tmp_path / "none")).read().count() == 0


def test_rows_that_most_batches_hold_are_combined_first(spark, tmp_path):
    sink = sinks.pair_sink(spark, str(tmp_path / "pairs"))
    sink.write(spark.createDataFrame(pairs(9), PAIRS), 0)
    plan = sink.read()._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_history_and_traces(spark, tmp_path):
    h = sinks.history_sink(spark, str(tmp_path / "h"))
    h.write(spark.createDataFrame([("r1", "q", "a", False, BASE), ("r2", "q", "b", True, BASE)], h.schema), 0)
    h.write(spark.createDataFrame([("r1", "q", "a", True, BASE + timedelta(1))], h.schema), 1)
    assert sorted((r.run_id, r.ok) for r in h.read().collect()) == [("r1", True), ("r2", True)]
    t = sinks.trace_sink(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([("r1", "plan", 0.5, BASE)] * 2, t.schema), 0)
    assert t.read().agg(F.sum("seconds")).first()[0] == 1.0
