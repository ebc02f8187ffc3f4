"""Exact admission over a stream, refusing or waiting: state per key is the last admissions or starts, no more than the limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.learning import StartClock


def admitted_stream(x: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """(key, ts, admitted): an attempt passes if fewer than ``limit`` admitted ones of its key lie within the last ``seconds``.

    Attempts of one trigger are taken in order of time; those that come late are judged by the admissions known then. A
    trigger's rows of one key are held by one task, so size triggers by ``maxFilesPerTrigger``.
    """
    flow = x.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def judge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        at = sorted(v for b in batches for v in b["at"])
        out = []
        for v in at:
            recent = [r for r in recent if r > v - seconds * 1_000_000]
            out.append(len(recent) < limit)
            if out[-1]:
                recent.append(v)
        state.update((recent,))
        yield pd.DataFrame({"key": [k[0]] * len(at), "at": at, "admitted": out})

    kind = x.schema[key].dataType.simpleString()
    found = flow.groupBy("key").applyInPandasWithState(judge, f"key {kind}, at long, admitted boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout)
    return found.select("key", F.timestamp_micros("at").alias("ts"), "admitted")


def started_stream(x: DataFrame, key: str, ts: str, limit: int, seconds: float = 60) -> DataFrame:
    """(key, ts, started): when each request begins if it waits until fewer than ``limit`` of its key began within the last ``seconds``.

    Requests of one trigger are taken in order of time; those that come late begin after the starts known then.
    """
    flow = x.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where("at is not null")

    def judge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = StartClock(limit, seconds, state.get[0] if state.exists else ())
        at = sorted(v for b in batches for v in b["at"])
        out = [clock.start(v) for v in at]
        state.update((list(clock.recent),))
        yield pd.DataFrame({"key": [k[0]] * len(at), "at": at, "begun": out})

    kind = x.schema[key].dataType.simpleString()
    found = flow.groupBy("key").applyInPandasWithState(judge, f"key {kind}, at long, begun long", "recent array<long>", "append", GroupStateTimeout.NoTimeout)
    return found.select("key", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("begun").alias("started"))
