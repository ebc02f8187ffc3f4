"""Other databases as catalogs of a session: a text is written once, in Spark SQL, and Spark's dialects put it to each database.

What a database can do itself (filters, aggregates and, where its dialect writes them, sorting with limits, offsets and joins) is pushed into
the statement that it gets; the rest stays in Spark, so a text means the same everywhere. ``asked`` tells which part went where.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.plans.policy import _items, _kind, physical_nodes

_CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
#: Kinds whose dialect takes a limit and then leaves it out of the statement, so that all rows would come.
LOSE_LIMITS = ("derby", "teradata")
#: What each new connection is told first, so that it only reads; by the kind in the address.
READ_ONLY = {
    "postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY",
    "mysql": "SET SESSION TRANSACTION READ ONLY",
    "oracle": "SET TRANSACTION READ ONLY",
}
SECONDS, ROWS_A_FETCH = 300, 10_000


class AttachError(ValueError):
    """A database that can't be attached under this name."""


def attach(spark: SparkSession, name: str, url: str, seconds: int = SECONDS, **options: str) -> None:
    """Name a database's tables ``name.schema.table`` in this session; ``options`` are those of Spark's JDBC source (user, driver).

    Connections are told to read only where their kind knows it, and a statement is given up after ``seconds``. A session keeps
    a catalog once it is used, so a name stays with its address; ``spark.newSession()`` starts afresh.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name) or name.lower() in ("spark_catalog", "system", "session", "global_temp"):
        raise AttachError(f"no name for a database: {name}")
    kind = re.match(r"jdbc:(\w+):", url)
    if not kind:
        raise AttachError("an address begins with jdbc:")
    place = f"spark.sql.catalog.{name}"
    if spark.conf.get(place, None) and spark.conf.get(f"{place}.url", None) != url:
        raise AttachError(f"{name} is another database")
    first = {"sessionInitStatement": READ_ONLY[kind[1]]} if kind[1] in READ_ONLY else {}
    bounds = () if kind[1] in LOSE_LIMITS else ("Limit", "Offset", "TableSample")
    pushed = {f"pushDown{x}": "true" if x in bounds or x in ("Aggregate", "Join") else "false" for x in ("Aggregate", "Join", "Limit", "Offset", "TableSample")}
    held = {"url": url, "queryTimeout": str(seconds), "fetchsize": str(ROWS_A_FETCH)} | pushed | first | options
    for key, value in held.items():
        spark.conf.set(f"{place}.{key}", value)
    spark.conf.set(place, _CATALOG)


def tables(spark: SparkSession, name: str, schema: str) -> dict[str, DataFrame]:
    """The tables of a schema by their names in lower case, as metrics take them."""
    found = spark.sql(f"SHOW TABLES IN `{name}`.`{schema}`").collect()
    return {r.tableName.lower(): spark.table(f"`{name}`.`{schema}`.`{r.tableName}`") for r in found}


def in_ranges(spark: SparkSession, table: str, column: str, parts: int) -> DataFrame:
    """An attached table read by ``parts`` connections, each a range of ``column``; the database tells its least and greatest value.

    Rows without a value are read with the first range. Aggregates are then pushed part by part and merged in Spark.
    """
    of = spark.table(table).schema[column].dataType
    if not isinstance(of, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType)):
        raise ValueError("ranges are of whole numbers, dates or times")
    least = spark.table(table).agg(F.min(column).cast("string").alias("low"), F.max(column).cast("string").alias("high")).first()
    if least.low is None:
        return spark.table(table)
    options = {"partitionColumn": column, "lowerBound": least.low, "upperBound": least.high, "numPartitions": str(parts)}
    return spark.read.options(**options).table(table)


@dataclass
class Asked:
    """What one scan leaves to its database."""

    table: str
    pushed: dict[str, str] = field(default_factory=dict)


def asked(df: DataFrame) -> list[Asked]:
    """The scans of databases in the plan of ``df``, and what each database computes."""
    return list(_scans(df))


def _scans(df: DataFrame) -> Iterator[Asked]:
    for node in physical_nodes(df._jdf.queryExecution().executedPlan()):
        if _kind(node) == "RowDataSourceScanExec":
            said = {kv._1(): kv._2() for kv in _items(node.metadata())}
            yield Asked(node.nodeName().removeprefix("Scan "), {k: v for k, v in said.items() if k.startswith("Pushed") and v not in ("[]", "")})


def spark_after(df: DataFrame) -> set[str]:
    """Aggregates, sorts, limits and joins that Spark does itself, by the names of their nodes; empty where the database does all."""
    kinds = {_kind(n) for n in physical_nodes(df._jdf.queryExecution().executedPlan())}
    return {k for k in kinds if re.search(r"Aggregate|Sort|Limit|TakeOrdered|Join|Filter", k)}
