"""Periodic runs of words, by bit-parallel lags.

A run is a stretch of words with smallest period q that holds q at least ``TIMES`` times and
at least ``LEAST`` words, and that no neighbouring word extends with that period. The ids of
a text's words are held as bit planes, one big integer for each bit of an id. XOR of a plane
with itself shifted by q tells where words q apart differ in that bit, OR over the planes
where they differ at all. A stretch of m zeros is found by AND of the shifted complement
with shifts that double, so m is reached in log2(m) steps; most lags end after one plane,
whose zeros are too short. A stretch that a shorter period, a divisor of q, has given is the
same run and is left out.

In a text of more than ``DENSE`` words a lag is first looked at in places an eighth of the
needed stretch apart: a run has eight equal pairs there in a row. Lags without, or with
none outside of runs that a divisor has given, hold nothing new, so that the work over all
lags stays near n log n. The planes then decide on the other lags.

Cases: a null or empty text has no words and no runs. Ties for the longest run go to the
smallest start and then period. A very long text is split into words a megabyte at a time
and held as one number of 32 bits a word beside its distinct words. Repeated rows and
repeated or null ids give a result each. Other columns are not looked at, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._words import pieces, slices

#: A run has its period so many times and so many words.
TIMES, LEAST = 4, 6
#: Up to so many words all lags go through the planes; beyond, lags from FIRST on are looked at in places first.
DENSE, FIRST = 4096, 64
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
#: An odd factor spreads ids over the planes without making two alike.
_ODD = 0x9E3779B1


def word_ids(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word in order, the distinct words by number) of a text in UTF-8."""
    known: dict[bytes, int] = {}
    parts = [np.array([known.setdefault(w, len(known)) for w in part.split()], np.int32) for part in pieces(raw.translate(_SPACES))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(known)


def bit_planes(ids: np.ndarray) -> list[int]:
    """One big integer for each bit of the ids, word i at bit i; equal ids, and only those, agree in all."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    spread = (ids.astype(np.uint64) * np.uint64(_ODD)) & np.uint64((1 << bits) - 1)
    return [int.from_bytes(np.packbits(((spread >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes(), "little") for j in range(bits)]


def long_stretches(bits: int, least: int) -> int:
    """The places of ``bits`` from which at least ``least`` ones follow, by shifts that double."""
    reach = 1
    while bits and 2 * reach <= least:
        bits &= bits >> reach
        reach *= 2
    return bits & bits >> (least - reach) if bits and reach < least else bits


def _places(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def sampled_lags(ids: np.ndarray, first: int, last: int, times: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(lag, places, reach) for the lags from ``first`` to ``last`` at which pairs in even steps leave room for a run.

    Each place begins eight equal pairs in a row, over ``reach`` words; lags of a like size share their steps.
    """
    n = len(ids)
    padded = np.concatenate([ids, np.full(last // 8 + 2, -1, ids.dtype)])
    q = first
    while q <= last:
        width, step = min(q // 8 + 1, last - q + 1), (times - 1) * q // 8
        rows = (n - q - 1) // step + 1
        shifted = np.lib.stride_tricks.as_strided(padded[q:], (rows, width), (step * padded.itemsize, padded.itemsize))
        same = shifted == padded[: rows * step : step][:, None]
        for gap in (1, 2, 4):
            same = same[:-gap] & same[gap:]
        for j in np.flatnonzero(same.any(axis=0)).tolist():
            yield q + j, np.flatnonzero(same[:, j]) * step, 7 * step
        q += width


def _lags(ids: np.ndarray, out: list[tuple[int, int, int]], times: int, dense: int) -> Iterator[int]:
    """The lags at which there may be runs that ``out`` does not have yet, in order."""
    last = len(ids) // times
    yield from range(1, (last if len(ids) <= dense else min(last, FIRST - 1)) + 1)
    if len(ids) > dense:
        long, known = [], 0
        for q, at, reach in sampled_lags(ids, FIRST, last, times):
            long = [x for x in (*long, *out[known:]) if x[1] >= times * q]
            known = len(out)
            for start, length, period in long:
                if q % period == 0:
                    at = at[(at < start) | (at + reach >= start + length - q)]
            if len(at):
                yield q


def runs_of(ids: np.ndarray, times: int = TIMES, least: int = LEAST, dense: int = DENSE) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    n, out, seen = len(ids), [], set()
    if n < least:
        return out
    planes, full = bit_planes(ids), (1 << n) - 1
    inverse = [p ^ full for p in planes]
    for q in _lags(ids, out, times, dense):
        need = max(least, times * q) - q
        same = full >> q
        for j, plane in enumerate(planes):
            same &= plane ^ (inverse[j] >> q)
            if j == 0 and not long_stretches(same, need):
                break
        else:
            found = long_stretches(same, need)
            first, last = _places(found & ~(found << 1)), _places(found & ~(found >> 1))
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                run = a, b - a + need + q
                if run not in seen:
                    seen.add(run)
                    out.append((*run, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed(ids: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The ids that stay once each run is cut to its first period."""
    stay = np.ones(len(ids), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return ids[stay]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: Callable[[object, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start,length,period>>, collapsed) for every row of ``docs``.

    ``collapsed`` is the text with each run cut to its first period, words joined by a space.
    ``repeat`` may name a place and a period (a, p) for an id and a number of words: from a on, the words then repeat the p words there.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, found, short = [], [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                ids, words = word_ids(raw.as_py())
                if repeat and (where := repeat(doc_id, len(ids))):
                    a, p = where
                    ids[a:] = ids[a + np.arange(len(ids) - a) % p]
                runs = runs_of(ids)
                n.append(len(ids))
                found.append([{"start": s, "length": k, "period": q} for s, k, q in runs])
                short.append(b" ".join(map(words.__getitem__, collapsed(ids, runs).tolist())).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, _RUN), pa.array(short, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
            )

    return picked.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted_repeat(doc_id: object, n: int) -> tuple[int, int] | None:
    """Where the query's texts repeat, by the digest of their ids; texts without an id stay as they are."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    a, g = h // 10 % n, h // 10
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def op13_periodic_runs(docs: DataFrame) -> DataFrame:
    """The digest of ``periodic_runs`` over documents, a tenth of which repeat words from a place on."""
    found = periodic_runs(docs, repeat=planted_repeat)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.short")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
