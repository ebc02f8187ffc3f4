"""Connections to other databases as JDBC readers, and vector tables on Parquet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import SchemaCache, SchemaChanged
from tallyforge.sources import databases, statements

#: Kinds of sources and their JDBC addresses; None where there is no reader.
KINDS = {
    "parquet": "", "sqlite": "jdbc:sqlite:{database}", "duckdb": "jdbc:duckdb:{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}", "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "clickhouse": "jdbc:clickhouse://{host}:{port}/{database}", "trino": "jdbc:trino://{host}:{port}/{database}",
    "starrocks": "jdbc:mysql://{host}:{port}/{database}", "snowflake": "jdbc:snowflake://{host}/?db={database}",
    "oracle": None, "sqlserver": None, "bigquery": None,
}


@dataclass
class Connections:
    """Named sources; each table comes as a DataFrame, read in ranges of a column where one is given."""

    spark: SparkSession
    held: dict[str, tuple[str, dict]] = field(default_factory=dict)
    schemas: SchemaCache = field(default_factory=SchemaCache)

    def create(self, name: str, kind: str, **options: str) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of source: {kind}")
        if KINDS[kind] is None:
            raise NotImplementedError(f"no reader for {kind}")
        self.held[name] = (kind, options)

    def list(self) -> list[str]:
        return sorted(self.held)

    def close(self, name: str) -> None:
        del self.held[name]
        self.schemas.drop(name)

    def address(self, name: str) -> str:
        kind, options = self.held[name]
        return KINDS[kind].format(**{"host": "localhost", "port": "", "database": ""} | options)

    def read(self, name: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
        kind, options = self.held[name]
        if kind == "parquet":
            return self.spark.read.parquet(f"{options['path']}/{table}.parquet")
        reader = self.spark.read.format("jdbc").option("url", self.address(name)).option("dbtable", table).option("fetchsize", 10_000)
        for k in ("user", "password", "driver"):
            reader = reader.option(k, options[k]) if k in options else reader
        if column:
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.load()

    def schema(self, name: str, table: str, revision: str = "") -> T.StructType:
        """The schema of a table, asked once a lifetime; another ``revision`` of the caller's asks again."""
        return self.schemas.get(name, table, revision, lambda: self.read(name, table).schema)

    def require_schema(self, name: str, table: str) -> DataFrame:
        """A table as it is now; refused, and its held schema dropped, if that is not what was held."""
        held, now = self.schema(name, table), self.read(name, table)
        if now.schema != held:
            self.schemas.drop(name, table)
            raise SchemaChanged(f"{table} changed since its schema was held")
        return now

    def attach(self, name: str) -> None:
        """Name the source's tables ``name.schema.table`` in texts of this session; its database gets what Spark's dialect can say."""
        kind, options = self.held[name]
        if not KINDS[kind]:
            raise NotImplementedError(f"{kind} is no database")
        own = {k: options[k] for k in ("user", "password", "driver") if k in options}
        databases.attach(self.spark, name, self.address(name), **own)

    def statement(self, name: str, sql: str, **options: object) -> DataFrame:
        """The result of a statement at a source that has an HTTP interface; options as of ``statements.StatementSource``."""
        kind, own = self.held[name]
        if kind not in statements.PROTOCOLS:
            raise NotImplementedError(f"no statements by HTTP for {kind}")
        return statements.statement(self.spark, kind, sql, **own | options)


def keep_newest(x: DataFrame, n: int, order: str) -> DataFrame:
    """The ``n`` newest rows."""
    return x.orderBy(F.col(order).desc()).limit(n)


def without(x: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those deleted."""
    return x.join(gone.select(key).distinct(), key, "left_anti")
