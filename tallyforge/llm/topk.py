"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Components become whole numbers, so scores are exact. The vectors' second moments give
a rotation that puts most of their length into the first coordinates. Vectors lie in
order of descending length; for each query a lower limit of its k-th score is known
from the longest vectors, and grows. A vector is dropped as soon as the partial sum
over the coordinates so far plus the Cauchy-Schwarz bound on the rest, the product of
the two residual lengths, cannot reach the limit; scores of all others are worked out
in whole numbers.

Queries come in blocks of a fixed size, each of which is broadcast and meets every
vector in one pass; a pass keeps k scores per query and task.

Cases: vectors that are null or hold a null or a value that is not finite take no part,
nor do rows without an id; shorter vectors are padded with zeros. Equal scores go to
the smaller id. A query id that repeats is answered once, from its least vector, and
leaves out all rows of its id; other repeated rows are candidates each. Ids that are no
whole numbers, and vectors so long that a score might not fit into 64 bits, are refused. Other columns are not looked at,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyforge.llm._scratch import Scope, keep

SCALE = 1024
#: Queries in a block, the longest vectors that seed the limits, and rows of a step.
BLOCK, SEEDS, STEP = 2048, 2048, 2048
#: Partial sums end once fewer pairs than this share can still count.
FEW = 0.01
NONE = np.iinfo(np.int64).min


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    flat = col.values.to_numpy()[col.offsets[0].as_py() : col.offsets[-1].as_py()] if isinstance(col, pa.ListArray) else col.flatten().to_numpy()
    ends = np.diff(col.offsets.to_numpy())
    if len(ends) and (ends == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(col), d), np.int64)
    for i, row in enumerate(col.to_pylist()):
        out[i, : len(row)] = row
    return out


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column("v"), d).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), _lists(total)], names=["i", "x"])

    return run


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _summed(table: pa.Table) -> pa.Table:
    """One row of the moments from all tasks' shares of it."""
    total = sum(np.array(x.as_py()) for x in table.column("x"))
    return pa.table({"i": table.column("i").slice(0, 1), "x": _lists(total[None, :])})


class BestOf:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.ids = np.zeros((n, k), np.int64)

    def limit(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge new scores; equal scores go to the smaller id."""
        touched = np.unique(query)
        old = self.score[touched] > NONE
        q = np.concatenate([query, np.repeat(touched, old.sum(axis=1))])
        s = np.concatenate([score, self.score[touched][old]])
        v = np.concatenate([ids, self.ids[touched][old]])
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.score[q[top], rank[top]] = s[top]
        self.ids[q[top], rank[top]] = v[top]


class Rotation:
    """Coordinates in which the first few carry most of the length, taken some at a time."""

    def __init__(self, moments: np.ndarray, step: int = 16):
        values, vectors = np.linalg.eigh(moments)
        self.axes = vectors[:, np.argsort(-values)]
        self.ends = [*range(step, len(moments), step), len(moments)]

    def split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coordinates, lengths of what is left: of all, then after each stage) of each row."""
        r = m.astype(float) @ self.axes
        after = np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]
        return r, np.sqrt(np.column_stack([after[:, [0, *self.ends[:-1]]], np.zeros(len(r))]))


def compare(best: BestOf, floor: np.ndarray, ids: np.ndarray, queries: np.ndarray, q_split, cand_ids: np.ndarray, cands: np.ndarray, rotation: Rotation) -> int:
    """Meet queries with candidates; returns how many scores had to be worked out in whole numbers.

    Partial sums grow stage by stage until few pairs can still reach their query's limit.
    """
    worked = 0
    q_at, q_rest = q_split
    for at in range(0, len(cands), STEP):
        m, v = cands[at : at + STEP], cand_ids[at : at + STEP]
        c_at, c_rest = rotation.split(m)
        longest = c_rest[:, 0].max(initial=0)
        limit = np.maximum(floor, best.limit()).astype(float)
        slack = 1e-9 * q_rest[:, 0] * longest + 1e-6
        live = np.flatnonzero(q_rest[:, 0] * longest >= limit - slack)
        if not len(live):
            continue
        least, part, begin = (limit - slack)[live, None], np.zeros((len(live), len(m))), 0
        for stage, end in enumerate(rotation.ends, 1):
            part += q_at[live, begin:end] @ c_at[:, begin:end].T
            open_ = part + q_rest[live, stage, None] * c_rest[None, :, stage] >= least
            begin = end
            if np.count_nonzero(open_) < FEW * open_.size:
                break
        qi, ci = np.nonzero(open_ & (v[None, :] != ids[live, None]))
        qi = live[qi]
        for a in range(0, len(qi), 1 << 18):
            q, c = qi[a : a + (1 << 18)], ci[a : a + (1 << 18)]
            best.add(q, np.einsum("ij,ij->i", queries[q], m[c]), v[c])
        worked += len(qi)
    return worked


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest whole inner product for each query, its own aside."""
    with Scope(vectors.sparkSession) as passing:
        return passing.hand_over(_top_k(vectors, is_query, id_col, vector_col, k, scale), "topk-found")


def _top_k(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int, scale: int) -> DataFrame:
    spark = vectors.sparkSession
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} holds no whole numbers")
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    picked = vectors.where(x.isNotNull() & F.col(id_col).isNotNull()).where(finite).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    picked = picked.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    parts = max(1, spark.sparkContext.defaultParallelism)
    ordered = keep(
        picked.repartitionByRange(parts, F.col("norm2").desc(), F.xxhash64("vec_id")).sortWithinPartitions(F.col("norm2").desc()), "topk-vectors"
    )
    d, longest = ordered.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
    if longest >= 2.0**62:
        raise ValueError("scores of vectors of this length do not fit into 64 bits: choose a smaller scale")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not d:
        return empty
    shares = ordered.select("v").mapInArrow(_moments(d), "i int, x array<double>")
    summed = shares.groupBy("i").applyInArrow(_summed, "i int, x array<double>").orderBy("i").toArrow()
    rotation = Rotation(summed.column("x").combine_chunks().flatten().to_numpy().reshape(d, d))
    seeds = ordered.orderBy(F.col("norm2").desc(), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    seed_ids, seed_m = seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v").combine_chunks(), d)
    queries = keep(ordered.where("q").groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    parts: list[DataFrame] = []
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if not held.num_rows:
            continue
        ids, q = held.column("vec_id").to_numpy(), _matrix(held.column("v").combine_chunks(), d)
        seeded = BestOf(len(ids), k)
        compare(seeded, np.full(len(ids), NONE), ids, q, rotation.split(q), seed_ids, seed_m, rotation)
        block = spark.sparkContext.broadcast((ids, q, seeded.limit(), rotation))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, q, floor, rotation = block.value
            best, split = BestOf(len(ids), k), rotation.split(q)
            for batch in batches:
                compare(best, floor, ids, q, split, batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), d), rotation)
            held = best.score > NONE
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, held.sum(axis=1))), pa.array(best.ids[held]), pa.array(best.score[held])],
                names=["query_id", "vec_id", "score"],
            )

        part = ordered.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        parts.append(keep(part.select("query_id", "rank", "vec_id", "score"), "topk-block"))
        block.unpersist()
        if len(parts) == 64:
            parts = [keep(reduce(DataFrame.unionByName, parts), "topk-blocks")]
    return reduce(DataFrame.unionByName, parts) if parts else empty


def op4_top_k(vectors: DataFrame) -> DataFrame:
    """The ten best rows for every id divisible by 100."""
    return top_k(vectors, F.col("vec_id") % 100 == 0)
