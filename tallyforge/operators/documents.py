"""Documents for retrieval: markdown chunks, hash embeddings, edits between texts, vector tables."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.versions import Versions

MOST, SHARED = 2048, 256
DIMENSION = 256
_HEADING = re.compile(r"\n(?=#{1,6}\s)")
_PARAGRAPH = re.compile(r"\n\s*\n")


def _packed(parts: list[str], most: int, finer: Callable[[str], list[str]]) -> list[str]:
    """Parts joined by blank lines while they fit; one that never fits is cut by ``finer``."""
    out: list[str] = []
    open_ = False  # whether the last chunk may grow
    for part in filter(None, map(str.strip, parts)):
        if open_ and len(out[-1]) + 2 + len(part) <= most:
            out[-1] = f"{out[-1]}\n\n{part}"
        elif len(part) <= most:
            out.append(part)
            open_ = True
        else:
            out += finer(part)
            open_ = False
    return out


def _windows(text: str, most: int, shared: int) -> list[str]:
    starts = range(0, max(1, len(text) - shared), most - shared)
    return [text[a : a + most].strip() for a in starts]


def markdown_chunks(text: str | None, most: int = MOST, shared: int = SHARED) -> list[str]:
    """Chunks of ``most`` characters at most: sections by heading, then paragraphs, then windows."""
    by_paragraph = lambda s: _packed(_PARAGRAPH.split(s), most, lambda p: _windows(p, most, shared))
    return _packed(_HEADING.split(text or ""), most, by_paragraph)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, text): markdown chunks of whole texts."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(markdown_chunks)

    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split(text_col)).alias("chunk", "text"))


def hash_vector(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """A unit vector that depends on the text's digest alone."""
    digest = np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8)
    place = np.arange(dimension)
    v = (digest[place % len(digest)] ^ (place & 0xFF).astype(np.uint8)) / 127.5 - 1.0
    return v / max(np.linalg.norm(v), 1e-12)


def hash_vectors(texts: list[str], dimension: int = DIMENSION) -> list[np.ndarray]:
    """Hash vectors of some texts."""
    return [hash_vector(t, dimension) for t in texts]


#: Fixed value: texts that a model is given at once.
AT_ONCE = 100


def embedded(
    docs: DataFrame, text_col: str = "text", dimension: int = DIMENSION, model: Callable[[list[str]], list] | None = None, at_once: int = AT_ONCE
) -> DataFrame:
    """``docs`` with an embedding of each text, null texts as empty ones, ``at_once`` of them at most to a call of ``model``.

    Without a model it is the hash embedding. A model that gives another number of vectors than it got texts fails the job.
    """
    ask = model or (lambda texts: hash_vectors(texts, dimension))

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            whole, out = texts.fillna("").tolist(), []
            for i in range(0, len(whole), at_once):
                found = ask(whole[i : i + at_once])
                if len(found) != len(whole[i : i + at_once]):
                    raise ValueError("a model gives one vector for each text")
                out += [np.asarray(v, "float32") for v in found]
            yield pd.Series(out, dtype=object)

    return docs.withColumn("embedding", embed(text_col))


def edit_operations(before: Column, after: Column) -> Column:
    """Words added, removed or changed between two texts, as array<struct<op,before,after>>."""

    @F.pandas_udf("array<struct<op:string,before:string,after:string>>")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> list[dict]:
            p, q = (x or "").split(), (y or "").split()
            codes = difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes()
            return [{"op": op, "before": " ".join(p[i:j]), "after": " ".join(q[k:n])} for op, i, j, k, n in codes if op != "equal"]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return diff(before, after)


def edit_ratio(before: Column, after: Column) -> Column:
    """How alike two texts are by words, from 0 to 1, rounded to 4 places."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(difflib.SequenceMatcher(None, (x or "").split(), (y or "").split(), autojunk=False).ratio(), 4) for x, y in zip(a, b, strict=True)])

    return ratio(before, after)


def rolled_back(history: DataFrame, item: str, version: str, to: DataFrame) -> DataFrame:
    """``history`` with a new last version of each item in ``to`` (item, version): the content of the version named. Nothing is lost."""
    last = history.groupBy(item).agg(F.max(version).alias("_last"))
    again = history.join(to, [item, version]).join(last, item).withColumn(version, F.col("_last") + 1).select(history.columns)
    return history.unionByName(again)


def branched(history: DataFrame, item: str, version: str, source: object, upto: int, target: object) -> DataFrame:
    """``history`` with versions up to ``upto`` of one item under another name as well."""
    copied = history.where((F.col(item) == F.lit(source)) & (F.col(version) <= upto)).withColumn(item, F.lit(target).cast(history.schema[item].dataType))
    return history.unionByName(copied)


class VectorTable:
    """Vectors of one dimension under one embedding version; a replacement takes effect at once or not at all."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, version: str):
        self.spark, self.path, self.dimension, self.version = spark, path, dimension, version
        self.versions = Versions(spark, f"{path}/data")

    def _guard(self) -> None:
        held = self.spark.read.parquet(f"{self.path}/version").first()
        if (held["dimension"], held["version"]) != (self.dimension, self.version):
            raise ValueError(f"held vectors have dimension {held['dimension']} and version {held['version']}")

    def create(self, x: DataFrame) -> None:
        self.spark.createDataFrame([(self.dimension, self.version)], "dimension int, version string").write.parquet(f"{self.path}/version")
        self._write(x)

    def _write(self, x: DataFrame) -> None:
        """A new version; a row of another dimension fails it as a whole."""
        wrong = F.raise_error(F.lit(f"a vector has not {self.dimension} components"))
        fits = F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(wrong)
        self.versions.add(lambda folder: x.withColumn("embedding", fits).write.parquet(f"{folder}/rows"))

    def read(self) -> DataFrame:
        self._guard()
        return self.spark.read.parquet(f"{self.versions.current()}/rows")

    def count(self) -> int:
        return self.read().count()

    def replace(self, scope: Column, x: DataFrame) -> None:
        """Rows of ``scope`` give way to ``x``."""
        self._write(self.read().where(~F.coalesce(scope, F.lit(False))).unionByName(x))

    def delete(self, where: Column) -> None:
        self.replace(where, self.read().limit(0))

    def restore(self, n: int) -> None:
        """The rows of version ``n`` as the newest version."""
        self._guard()
        if n not in self.versions.numbers():
            raise ValueError(f"no complete version {n}")
        self._write(self.spark.read.parquet(f"{self.versions.folder(n)}/rows"))
