"""A stored vector index: lists around centroids with radii, skipped where they cannot hold a nearer vector.

Vectors are dealt to the centroid of least angle. A list keeps the greatest angle of its vectors to
its centroid; by the triangle inequality of angles no vector of the list is nearer to a question than
the centroid's angle less that radius. A search reads the nearest lists first and then those whose
bound is within the k-th distance found, so its answer is that of a scan of all vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import let
from tallyforge.operators import retrieval
from tallyforge.sources.versions import Versions

#: Centroids are learned from about so many vectors; there are at most so many lists, so the driver may hold them.
SAMPLE, MOST_LISTS = 100_000, 1024
#: Distances are rounded to millionths, so a list is read if its bound is above by no more than this.
SLACK = 2e-6


@dataclass(frozen=True)
class Ball:
    """A list of vectors: its unit centroid, the greatest angle of its vectors to it, and how many there are."""

    list: int
    centroid: np.ndarray
    radius: float
    n: int


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _unit(a: Column) -> Column:
    """``a`` at length 1; null for what has no direction. Its length is worked out once, not once for each component."""

    def scaled(norm: Column) -> Column:
        whole = F.coalesce((norm > 0) & (norm < math.inf) & ~F.exists(a, lambda v: v.isNull()), F.lit(False))
        return F.when(whole, F.transform(a, lambda v: v.cast("double") / norm))

    return let(_norm(a), scaled)


class VectorIndex:
    """Vectors of a table (id, embedding, fields) in a folder, partitioned by list; what has no direction is in list -1 and always read."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", fields: tuple[str, ...] = ()):
        self.spark, self.id_col, self.fields = spark, id_col, fields
        self.versions = Versions(spark, path)

    def build(self, vectors: DataFrame, lists: int | None = None, seed: int = 7) -> int:
        """Index ``vectors``; by default in about as many lists as the square root of their number."""
        x = vectors.select(F.col(self.id_col).alias("vec_id"), *self.fields, "embedding")
        x = x.withColumn("unit", _unit(F.col("embedding")))
        n = x.where("unit is not null").count()
        k = min(lists or math.isqrt(n), MOST_LISTS, n)
        if k > 1:
            some = x.where("unit is not null").sample(min(1.0, SAMPLE / n), seed).select(array_to_vector("unit").alias("features"))
            model = KMeans(k=k, seed=seed, maxIter=8, distanceMeasure="cosine").fit(some)
            centers = [c / np.linalg.norm(c) for c in model.clusterCenters()]
            held = model.transform(x.where("unit is not null").withColumn("features", array_to_vector("unit"))).drop("features").withColumnRenamed("prediction", "list")
        else:
            first = x.where("unit is not null").select("unit").head(1)
            centers = [np.array(first[0].unit)] if first else []
            held = x.where("unit is not null").withColumn("list", F.lit(0))

        def write(folder: str) -> None:
            every = held.select("vec_id", *self.fields, "embedding", "list").unionByName(x.where("unit is null").select("vec_id", *self.fields, "embedding", F.lit(-1).alias("list")))
            every.hint("rebalance", F.col("list")).write.partitionBy("list").parquet(f"{folder}/vectors")
            sent = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, centroid array<double>")
            met = self._read(folder, "vectors").where("list >= 0").join(F.broadcast(sent), "list")  # MOST_LISTS rows at most
            cosine = _dot(F.col("embedding"), F.col("centroid")) / _norm(F.col("embedding"))
            angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
            met.groupBy("list").agg(F.first("centroid").alias("centroid"), F.max(angle).alias("radius"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{folder}/lists")

        self._schema = held.select("vec_id", *self.fields, "embedding", "list").schema
        return self.versions.add(write)

    def _read(self, folder: str, part: str) -> DataFrame:
        if part == "vectors" and hasattr(self, "_schema"):
            return self.spark.read.schema(self._schema).parquet(f"{folder}/{part}")
        return self.spark.read.parquet(f"{folder}/{part}")

    def balls(self) -> list[Ball]:
        """The lists of the current version."""
        rows = self._read(self.versions.current(), "lists").collect()
        return [Ball(r.list, np.array(r.centroid), r.radius, r.n) for r in sorted(rows, key=lambda r: r.list)]

    @staticmethod
    def least_distance(ball: Ball, query: list[float]) -> float:
        """No vector of the list has a smaller cosine distance to ``query``."""
        q = np.asarray(query, float)
        cosine = float(np.clip(q @ ball.centroid / np.linalg.norm(q), -1, 1))
        return 1 - math.cos(max(0.0, math.acos(cosine) - ball.radius - 1e-9))

    def vectors(self, lists: list[int]) -> DataFrame:
        """The vectors of some lists, whose folders alone are read."""
        return self._read(self.versions.current(), "vectors").where(F.col("list").isin([-1, *lists]))

    def lists_for(self, query: list[float], k: int, where: Column | None = None) -> list[int]:
        """The lists that may hold one of the ``k`` nearest vectors that pass the filter."""
        near = sorted((self.least_distance(b, query), b.list) for b in self.balls())
        probes = 2
        while probes < len(near):
            found = retrieval.cosine_top(self.vectors([i for _, i in near[:probes]]), query, k, where).collect()
            if len(found) == k:  # rows without a distance come first, as in a scan; then no list can come before them
                return [i for d, i in near if found[-1].distance is not None and d <= found[-1].distance + SLACK]
            probes *= 4
        return [i for _, i in near]

    def search(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """(vec_id, distance, score): the ``k`` nearest vectors that pass the filter, as a scan of all gives them."""
        return retrieval.cosine_top(self.vectors(self.lists_for(query, k, where)), query, k, where)

    def share_read(self, lists: list[int]) -> float:
        """The part of all listed vectors that some lists hold."""
        balls = self.balls()
        return sum(b.n for b in balls if b.list in set(lists)) / max(1, sum(b.n for b in balls))

    def nearest_within(self, asked: DataFrame, most: float) -> DataFrame:
        """(asked, vec_id, distance): for each of ``asked`` (asked, embedding) the nearest vector, if it lies within ``most``.

        A question meets only the lists whose bound is within ``most``.
        """
        balls = self._read(self.versions.current(), "lists").select("list", "centroid", "radius")
        a = asked.select("asked", F.col("embedding").alias("a")).crossJoin(F.broadcast(balls))  # MOST_LISTS rows at most
        cosine = _dot(F.col("a"), F.col("centroid")) / _norm(F.col("a"))
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("radius") - 1e-9
        a = a.where(1 - F.cos(F.greatest(F.lit(0.0), angle)) <= most + SLACK).select("asked", "a", "list")
        x = self._read(self.versions.current(), "vectors").where("list >= 0").join(a, "list")
        distance = F.round(1 - _dot(F.col("a"), F.col("embedding")) / (_norm(F.col("a")) * _norm(F.col("embedding"))), 6)
        best = x.select("asked", F.struct(distance.alias("distance"), "vec_id").alias("p")).where(F.col("p.distance") <= most).groupBy("asked").agg(F.min("p").alias("p"))
        return best.select("asked", "p.vec_id", "p.distance")
