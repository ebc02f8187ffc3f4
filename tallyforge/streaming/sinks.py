"""Sinks of streams that take each batch once: a ledger of batch numbers over folders of their own.

A batch is written whole to the folder of its number, over whatever an earlier attempt left there, and
then entered in the ledger. A batch that the ledger has is passed over; one that was written but not
entered is not read by anybody and is written again. So a stream that stops anywhere and starts
again gives what a batch job gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources.versions import Versions


class LedgerSink:
    """Rows in a folder: all of them, or with ``keys`` the last row of each key by ``order``.

    Rows of equal order go by batch, the later one last. With ``gone`` a column of truth values tells rows that delete
    their key. ``merge`` folds batches into one table, so that readers do not meet ever more folders.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None, order: list[str] = (), gone: str | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.gone = keys, list(order), gone
        self.merged = Versions(spark, f"{self.path}/merged")
        self._whole = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batches/b-{batch}"

    def _mark(self, batch: int) -> str:
        return f"{self.path}/ledger/{batch}"

    def ledger(self) -> list[int]:
        """The batches that count, in order."""
        return sorted(int(n) for n in self.merged.names(f"{self.path}/ledger") if n.isdigit())

    def _latest(self, x: DataFrame) -> DataFrame:
        """The last row of each key, combined by every task before rows are sent; all rows where there are no keys."""
        if self.keys is None:
            return x
        last = F.max_by(F.struct("*"), F.struct(*self.order, "_batch"))
        return x.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys))).agg(last.alias("row")).select("row.*")

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Take a batch, if the ledger does not have it; what ``foreachBatch`` calls."""
        if self.merged.holds(self._mark(batch)) or batch <= self._upto()[1]:
            return False
        x = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(batch).cast("long").alias("_batch"))
        self._latest(x).write.mode("overwrite").parquet(self._folder(batch))
        self.enter(batch)
        return True

    def enter(self, batch: int) -> None:
        """Let a written batch count."""
        self.merged.mark(self._mark(batch))

    def _upto(self) -> tuple[str | None, int]:
        """(folder of the merged table, the last batch in it)."""
        if not self.merged.numbers():
            return None, -1
        folder = self.merged.current()
        return folder, self.spark.read.parquet(f"{folder}/upto").first().upto

    def _rows(self) -> tuple[DataFrame, list[int]]:
        folder, upto = self._upto()
        batches = [b for b in self.ledger() if b > upto]
        places = [*([f"{folder}/rows"] if folder else []), *map(self._folder, batches)]
        parts = [self.spark.read.schema(self._whole).parquet(p) for p in places]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._whole)
        return self._latest(rows), batches

    def _there(self) -> Column:
        return ~F.coalesce(F.col(self.gone), F.lit(False)) if self.gone else F.lit(True)

    def read(self) -> DataFrame:
        """The rows that count now."""
        return self._rows()[0].where(self._there()).drop("_batch")

    def merge(self) -> int | None:
        """Fold all batches into one table, without keys that are deleted; None if there is nothing to fold.

        Readers of the folders before keep them until ``clean``.
        """
        rows, batches = self._rows()
        if not batches:
            return None

        def write(folder: str) -> None:
            rows.where(self._there()).write.parquet(f"{folder}/rows")
            self.spark.createDataFrame([(batches[-1],)], "upto long").coalesce(1).write.parquet(f"{folder}/upto")

        return self.merged.add(write)

    def clean(self) -> None:
        """Delete the batches that the merged table has, and earlier tables; only when nobody reads them."""
        upto = self._upto()[1]
        self.merged.drop_others(f"{self.path}/batches", {f"b-{b}" for b in self.ledger() if b > upto})
        self.merged.drop_others(f"{self.path}/ledger", {str(b) for b in self.ledger() if b > upto})
        if self.merged.numbers():
            self.merged.drop_before(self.merged.numbers()[-1])

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take what a stream has now, batch by batch, and end."""
        write = stream.writeStream.foreachBatch(lambda rows, batch: self.write(rows, batch) and None)
        return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair_sink(spark: SparkSession, path: str) -> LedgerSink:
    """Questions with their SQL: the last of each question and database counts."""
    kind = "question string, database string, sql string, quality double, ts timestamp, gone boolean"
    return LedgerSink(spark, path, T._parse_datatype_string(kind), ["question", "database"], ["ts"], "gone")


def history_sink(spark: SparkSession, path: str) -> LedgerSink:
    """Questions with the plan that was taken: the last outcome of each run."""
    return LedgerSink(spark, path, T._parse_datatype_string("run_id string, question string, plan string, ok boolean, ts timestamp"), ["run_id"], ["ts"])


def trace_sink(spark: SparkSession, path: str) -> LedgerSink:
    """Steps of runs, each of which counts."""
    return LedgerSink(spark, path, T._parse_datatype_string("run_id string, step string, seconds double, ts timestamp"))


def audit_sink(spark: SparkSession, path: str) -> LedgerSink:
    """What was asked and allowed, each row of which counts."""
    return LedgerSink(spark, path, T._parse_datatype_string("actor string, action string, detail string, allowed boolean, ts timestamp"))
