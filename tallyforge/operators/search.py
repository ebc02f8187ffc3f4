"""Search by a stored keyword index and by vectors, fused, over several targets."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators import retrieval
from tallyforge.operators.documents import embedded
from tallyforge.operators.vectors import VectorIndex
from tallyforge.sources.versions import Versions

#: Each arm of a hybrid search gives twice the rows asked for, and at least so many.
ARM_LEAST = 20


def arm_size(k: int) -> int:
    """Rows that each arm of a search for ``k`` hands to the fusion."""
    return max(2 * k, ARM_LEAST)


#: Small segments are merged beyond so many, and all are once tombstones hide this part of their documents.
MOST_SEGMENTS, MOST_DEAD = 8, 0.2


#: Terms are counted about so many tokens at a time, as sorting takes several times their room.
AT_ONCE = 1 << 18


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches again, of about AT_ONCE tokens each; a longer document comes alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def _buckets(terms: Iterable[bytes], n: int) -> list[int]:
    """The folder of each term's postings, of ``n``."""
    return [zlib.crc32(t) % n for t in terms]


def _counted(fields: tuple[str, ...], buckets: int = 64):
    """Terms of each document with their counts, and the document once without a term, in bucket -1: tokens lie in one row, so no row has to meet another.

    A part's rows come in the order in which they are stored, by bucket and term: its few different terms are put in order, not its rows,
    and the sort after the shuffle finds long runs that it only has to merge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *fields]
        for batch in _sliced(batches):
            tokens = batch.column("tokens")
            coded = tokens.flatten().dictionary_encode()
            size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            bucket = pa.array(_buckets(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), buckets), pa.int32())
            order = pc.sort_indices(pa.table({"bucket": bucket, "term": coded.dictionary}), [("bucket", "ascending"), ("term", "ascending")]).to_numpy().astype(np.int64)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            n, none = len(size), np.zeros(len(size), np.int64)
            pair, tf = np.unique(place[coded.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(np.arange(n), size), return_counts=True)
            row = np.concatenate([np.arange(n), pair % n])
            at = pa.array(np.concatenate([none, order[pair // n]]), mask=np.arange(len(row)) < n)
            out = [batch.column(c).take(pa.array(row)) for c in names]
            out += [pa.array(size[row], pa.int32()), coded.dictionary.take(at), pa.array(np.concatenate([none, tf]), pa.int32())]
            out.append(pc.fill_null(bucket.take(at), -1))
            yield pa.RecordBatch.from_arrays(out, names=[*names, "len", "term", "tf", "bucket"])

    return run


class PostingsIndex:
    """Postings of a folder in segments, each partitioned by a hash of the term, with the lengths of its documents.

    A search reads the partitions of its own terms in all segments, and of these the terms' own row groups;
    document frequencies are the postings' counts. ``fields`` are columns to filter by.
    Replacing documents writes one segment of them, and tombstones for their ids that hide them in earlier
    segments. Many small segments are merged, the smallest first; all are when too many documents are hidden.
    A version is a list of segments and tombstones: readers see the old one until the new one is whole, and
    segments that a version names are never changed.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", fields: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.id_col, self.fields, self.buckets = spark, id_col, fields, buckets
        self.path, self.versions = path.rstrip("/"), Versions(spark, path)

    # Writing

    def _segment(self, postings: DataFrame, lengths: DataFrame | None = None) -> str:
        """Write a segment and give its name; without ``lengths`` the postings hold each document once more, in bucket -1."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        # Adaptive execution splits the partitions of frequent terms; within a file terms lie together, so row groups can be skipped.
        dealt = postings.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term")
        dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
        if lengths is None:  # so texts are cut into tokens once
            lengths = self.spark.read.schema(postings.schema).parquet(f"{folder}/postings").where("bucket = -1").drop("term", "tf", "bucket")
        lengths.write.parquet(f"{folder}/lengths")
        return name

    def _new(self, docs: DataFrame, tokens: Column) -> str:
        x = docs.select(F.col(self.id_col).alias("doc_id"), *self.fields, F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
        kept = T.StructType([*(f for f in x.schema.fields if f.name != "tokens"), T.StructField("len", T.IntegerType())])
        more = [T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
        return self._segment(x.mapInArrow(_counted(self.fields, self.buckets), T.StructType([*kept.fields, *more])))

    def _stats(self, name: str) -> tuple[int, int]:
        r = self._lengths(name).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
        return r.n, r.tokens

    def _publish(self, segments: list[Segment], dead: DataFrame | None) -> int:
        def write(folder: str) -> None:
            self.spark.createDataFrame([tuple(vars(s).values()) for s in segments], _SEGMENTS).coalesce(1).write.parquet(f"{folder}/segments")
            if dead is not None:
                dead.write.parquet(f"{folder}/dead")

        return self.versions.add(write)

    def build(self, docs: DataFrame, tokens: Column) -> int:
        """Index ``docs``; returns the version."""
        name = self._new(docs, tokens)
        return self._publish([Segment(name, 0, *self._stats(name), False)], None)

    def replace(self, docs: DataFrame, tokens: Column) -> int:
        """Documents take the place of those with their ids, or are added; what is written is in proportion to them."""
        return self._change(docs.select(F.col(self.id_col).alias("doc_id")), lambda: self._new(docs, tokens))

    def delete(self, ids: DataFrame) -> int:
        """Drop the documents with ids in column doc_id."""
        return self._change(ids.select("doc_id"), None)

    def _change(self, ids: DataFrame, new: Callable[[], str] | None) -> int:
        segments, dead = self._state()
        seq = max((s.seq for s in segments), default=-1) + 1
        name = new() if new else None
        # Ids come from the new segment where there is one, as it is written and small.
        ids = (self._lengths(name) if name else ids).select("doc_id").distinct()
        hidden, gone = [], {}
        if segments:
            live = self._live("lengths", segments, dead).join(ids, "doc_id", "left_semi")
            gone = {r.seq: (r.n, r.tokens) for r in live.groupBy("seq").agg(F.count("*").alias("n"), F.sum("len").alias("tokens")).collect()}
            hidden = [live.select("doc_id", F.lit(seq).cast("long").alias("seq")).distinct()] if gone else []
        segments = [replace(s, n_docs=s.n_docs - gone[s.seq][0], tokens=s.tokens - gone[s.seq][1], hides=True) if s.seq in gone else s for s in segments]
        if name:
            segments.append(Segment(name, seq, *self._stats(name), False))
        if dead is not None:
            hidden.append(dead)
        return self._publish(segments, reduce(DataFrame.unionByName, hidden) if hidden else None)

    def compact(self, everything: bool = False) -> int | None:
        """Merge small segments where there are many, or all where much is hidden; the version, or None if nothing is to do."""
        segments, dead = self._state()
        hidden = dead.count() if dead is not None else 0
        whole = everything or hidden > MOST_DEAD * (sum(s.n_docs for s in segments) + hidden)
        by_size = sorted(segments, key=lambda s: s.tokens)
        some = by_size if whole else by_size[: max(0, len(by_size) - MOST_SEGMENTS // 2)] if len(by_size) > MOST_SEGMENTS else []
        if not some or (len(some) == 1 and not hidden):
            return None
        name = self._segment(self._live("postings", some, dead).drop("seq"), self._live("lengths", some, dead).drop("seq"))
        left = [s for s in segments if s not in some]
        left.append(Segment(name, max(s.seq for s in some), *self._stats(name), False))
        # A tombstone is done with once no segment is older than it and hides a document.
        oldest = min((s.seq for s in left if s.hides), default=None)
        return self._publish(left, None if dead is None or oldest is None else dead.where(F.col("seq") > oldest))

    # Reading

    def _state(self) -> tuple[list[Segment], DataFrame | None]:
        """(segments of the current version, its tombstones (doc_id, seq), if any)."""
        folder = self.versions.current()
        segments = [Segment(*r) for r in self.spark.read.parquet(f"{folder}/segments").collect()]
        held = self.versions.holds(f"{folder}/dead")
        return sorted(segments, key=lambda s: s.seq), self.spark.read.parquet(f"{folder}/dead") if held else None

    def _lengths(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{name}/lengths")

    def _live(self, part: str, segments: list[Segment], dead: DataFrame | None) -> DataFrame:
        """A part of several segments with ``seq``, without the documents that tombstones hide there."""
        return self._without_dead(reduce(DataFrame.unionByName, (self._read(part, s) for s in segments)), segments, dead)

    @staticmethod
    def _without_dead(x: DataFrame, segments: list[Segment], dead: DataFrame | None) -> DataFrame:
        if dead is None or not any(s.hides for s in segments):
            return x
        d = dead.select(F.col("doc_id").alias("dead_id"), F.col("seq").alias("dead_seq"))
        return x.join(d, (F.col("doc_id") == F.col("dead_id")) & (F.col("dead_seq") > F.col("seq")), "left_anti")

    def _read(self, part: str, s: Segment) -> DataFrame:
        """A part of a segment; postings of no document at all have no file that tells their columns."""
        x = self._lengths(s.name)
        if part == "postings":
            more = [T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
            x = self.spark.read.schema(T.StructType([*x.schema.fields, *more])).parquet(f"{self.path}/segments/{s.name}/postings").where("bucket >= 0")
        return x.withColumn("seq", F.lit(s.seq).cast("long"))

    def postings(self) -> DataFrame:
        """(doc_id, fields, len, term, tf, bucket) of all documents."""
        return self._live("postings", *self._state()).drop("seq")

    def documents(self) -> DataFrame:
        """(doc_id, fields, len) of all documents."""
        return self._live("lengths", *self._state()).drop("seq")

    def search(self, terms: list[str], k: int, where: Column | None = None) -> DataFrame:
        """(doc_id, score): the ``k`` best documents by BM25 for any of ``terms``; ``where`` is over the fields, and so are all counts."""
        (segments, dead), asked = self._state(), list(dict.fromkeys(terms))
        buckets = sorted(set(_buckets(map(str.encode, asked), self.buckets)))
        x = reduce(DataFrame.unionByName, (self._read("postings", s).where(F.col("bucket").isin(buckets) & F.col("term").isin(asked)) for s in segments))
        x = self._without_dead(x, segments, dead)
        if where is None:
            n = sum(s.n_docs for s in segments)
            stats = self.spark.range(1).select(F.lit(n).alias("n_docs"), F.lit(sum(s.tokens for s in segments) / n if n else None).cast("double").alias("mean"))
        else:
            x = x.where(where)
            stats = self._live("lengths", segments, dead).where(where).agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"))
        df = x.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term asked
        y = x.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # and one row
        idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("len") / F.col("mean"))
        score = F.sum(idf * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + norm))
        return y.groupBy("doc_id").agg(F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)

    def clean(self, versions: int = 1) -> None:
        """Delete all but the last ``versions`` and the segments that none of these names; only when nobody reads older ones."""
        kept = self.versions.numbers()[-versions:]
        named = {r.name for n in kept for r in self.spark.read.parquet(f"{self.versions.folder(n)}/segments").collect()}
        self.versions.drop_before(kept[0])
        self.versions.drop_others(f"{self.path}/segments", named)


@dataclass(frozen=True)
class Segment:
    """A segment's name, its place in time, its documents and tokens that are not hidden, and whether tombstones hide some."""

    name: str
    seq: int
    n_docs: int
    tokens: int
    hides: bool


_SEGMENTS = "name string, seq long, n_docs long, tokens long, hides boolean"


def hybrid(sparse: DataFrame, dense: DataFrame, k: int, fields: list[str] = (), alpha: float = 0.5, c: int = 60) -> DataFrame:
    """(id, score, fields): the ``k`` best of two short lists (id, score, fields) by reciprocal ranks; of a field in both the dense one's counts."""
    best = lambda x: x.groupBy("id").agg(F.max("score").alias("score"), *(F.max_by(f, "score").alias(f) for f in fields))
    d, s = best(dense), best(sparse)
    fused = retrieval.fuse(retrieval.ranked(d, F.col("score"), "id"), retrieval.ranked(s, F.col("score"), "id"), alpha, c)
    side = lambda x, n: x.select("id", *(F.col(f).alias(f"{n}_{f}") for f in fields))
    out = fused.join(side(d, "d"), "id", "left").join(side(s, "s"), "id", "left")
    return out.select("id", "score", *(F.coalesce(f"d_{f}", f"s_{f}").alias(f) for f in fields)).orderBy(F.col("score").desc(), "id").limit(k)


class CatalogIndex:
    """Documents of a catalog (id, text, fields) stored once: postings for keywords, vectors in lists for the rest."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = ()):
        self.fields = fields
        self.words = PostingsIndex(spark, f"{path}/words", id_col="id", fields=fields)
        self.near = VectorIndex(spark, f"{path}/vectors", id_col="id", fields=fields)

    def ready(self) -> bool:
        return bool(self.words.versions.numbers() and self.near.versions.numbers())

    def build(self, docs: DataFrame, tokens: Column, embed: Callable[[DataFrame], DataFrame] = embedded, lists: int | None = 1) -> None:
        """Index ``docs``; ``embed`` adds a column embedding, by default hash vectors of the texts.

        Hash vectors lie everywhere, so no list of them could be skipped and one will do; with a model's vectors of a
        large catalog ``lists`` of None deals them to centroids.
        """
        self.words.build(docs, tokens)
        self.near.build(embed(docs.select("id", *self.fields, "text")), lists)

    def search(self, terms: list[str], vector: list[float], k: int, where: Column | None = None) -> DataFrame:
        """(id, score, fields): the ``k`` best by keywords and by nearness, of documents that pass the filter over the fields.

        ``vector`` is the question's, by the same embedding as the documents'.
        """
        n, known = arm_size(k), self.words.documents().select(F.col("doc_id").alias("id"), *self.fields)
        sparse = self.words.search(terms, n, where).withColumnRenamed("doc_id", "id")
        dense = self.near.search(vector, n, where).select(F.col("vec_id").alias("id"), "score")
        return hybrid(sparse.join(known, "id"), dense.join(known, "id"), k, list(self.fields))


class TargetsFailed(RuntimeError):
    """Targets of a search that gave no answer; ``errors`` has what each said."""

    def __init__(self, errors: dict[str, str]):
        super().__init__("; ".join(f"{name}: {e}" for name, e in errors.items()))
        self.errors = errors


def search_targets(spark: SparkSession, targets: dict[str, Callable[[], DataFrame]], k: int) -> tuple[DataFrame, dict[str, str]]:
    """(target, id, score) of all targets, and the errors of those that failed; each gives ``k`` rows at most, so they are fetched.

    With errors the rows are not the whole answer; ``search_all`` is for those that want nothing less.
    """
    parts, errors = [], {}
    for name, ask in targets.items():
        try:
            rows = [(name, str(r["id"]), float(r["score"])) for r in ask().select("id", "score").limit(k).collect()]
            parts.append(spark.createDataFrame(rows, "target string, id string, score double"))
        except Exception as e:  # whatever a target's source raises: the others still answer
            errors[name] = next((line.strip() for line in str(e).splitlines() if line.strip()), type(e).__name__)[:200]
    empty = spark.createDataFrame([], "target string, id string, score double")
    return reduce(DataFrame.unionByName, parts, empty), errors


def search_all(spark: SparkSession, targets: dict[str, Callable[[], DataFrame]], k: int) -> DataFrame:
    """(target, id, score) of all targets; where one fails so does the search, as rows of the others alone would look like its result."""
    found, errors = search_targets(spark, targets, k)
    if errors:
        raise TargetsFailed(errors)
    return found
