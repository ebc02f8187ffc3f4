"""What other databases can say, by Spark's own dialects: abilities, types, conditions and metrics in their words.

Nothing here runs a statement; ``databases`` does, and leaves this writing to Spark's planner. What a dialect has no word for is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.plans.metrics import Catalog, Metric, Selection, check
from tallyforge.plans.policy import _items, _kind, logical_nodes, require_expression

#: Functions that are asked about; those of conditions and aggregates that Spark can hand on.
ASKED = (
    "ABS AVG BIT_LENGTH CEIL CHAR_LENGTH COALESCE CORR COVAR_POP COVAR_SAMP DATE_ADD DATE_DIFF EXP FLOOR GREATEST LEAST LN LOWER MAX MIN POWER ROUND "
    "SQRT STDDEV_POP STDDEV_SAMP SUBSTRING SUM TRIM UPPER VAR_POP VAR_SAMP"
).split()


class Untranslatable(ValueError):
    """A text that a database's dialect has no words for."""


def _dialect(spark: SparkSession, url: str):
    if not url.startswith("jdbc:"):
        raise ValueError("an address begins with jdbc:")
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)


def abilities(spark: SparkSession, url: str) -> dict[str, object]:
    """Whether a database takes limits, offsets, samples and joins from Spark, and which functions."""
    d = _dialect(spark, url)
    out: dict[str, object] = {"limit": d.supportsLimit(), "offset": d.supportsOffset(), "sample": d.supportsTableSample(), "join": d.supportsJoin()}
    return out | {"functions": [f for f in ASKED if d.isSupportedFunction(f)]}


def column_type(spark: SparkSession, url: str, of: T.DataType) -> str:
    """The name of a type in a database; where its dialect has none of its own, the common one."""
    j = spark._jsparkSession.parseDataType(of.json())
    found = _dialect(spark, url).getJDBCType(j)
    found = found if found.isDefined() else spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.getCommonJDBCType(j)
    if not found.isDefined():
        raise Untranslatable(f"no type for {of.simpleString()}")
    return found.get().databaseTypeDefinition()


def condition(df: DataFrame, text: str, url: str) -> str:
    """A condition over the columns of a stored table in a database's words; it is true for the same rows there.

    The optimizer's form is written: names are those of the stored table, constants are folded, tests for null may be added.
    """
    spark = df.sparkSession
    return _written(spark, df.where(require_expression(text, spark)), url)


def _written(spark: SparkSession, x: DataFrame, url: str) -> str:
    held = [n for n in logical_nodes(x._jdf.queryExecution().optimizedPlan()) if _kind(n) == "Filter"]
    if len(held) != 1:
        raise Untranslatable("a condition that is no filter of one table")
    if any("\\" in v for v in _literals(held[0].condition())):
        raise Untranslatable("backslashes mean different things in different databases")
    built = spark._jvm.org.apache.spark.sql.catalyst.util.V2ExpressionBuilder(held[0].condition(), True).build()
    said = _dialect(spark, url).compileExpression(built.get()) if built.isDefined() else None
    if said is None or not said.isDefined():
        raise Untranslatable("its dialect has no words for this condition")
    return said.get()


def _literals(e) -> Iterator[str]:
    """The constants of an expression as texts."""
    if _kind(e) == "Literal":
        yield str(e.value())
    for child in _items(e.children()):
        yield from _literals(child)


def selection(catalog: Catalog, s: Selection, tables: dict[str, DataFrame], url: str) -> str:
    """The statement of a metric selection for a database; grains and lookups need ``databases`` and are refused here.

    The selection is checked as any other, and its columns against the tables. Groups come ordered, those without a value where
    the database puts them.
    """
    found = check(catalog, s)
    fact = tables[found[0].table]
    spark, first = fact.sparkSession, found[0]
    quote = _dialect(spark, url).quoteIdentifier
    if s.grain or {*s.dimensions, *(k for k, _ in s.filters)} - set(first.dimensions):
        raise Untranslatable("grains and lookups are left to Spark")
    missing = {*first.dimensions, *(m.column for m in found if m.column != "*")} - set(fact.columns)
    if missing:
        raise Untranslatable(f"no such columns: {', '.join(sorted(missing))}")
    groups = [quote(d) for d in s.dimensions]
    parts = [f"SELECT {', '.join([*groups, *(_aggregate(m, quote) for m in found)])}", f"FROM {quote(first.table)}"]
    if s.filters:
        x = fact
        for name, value in s.filters:
            x = x.where(F.col(name) == F.lit(value))
        parts.append(f"WHERE {_written(spark, x, url)}")
    parts += [f"GROUP BY {', '.join(groups)}", f"ORDER BY {', '.join(groups)}"] if groups else []
    return " ".join(parts)


def _aggregate(m: Metric, quote) -> str:
    return f"{m.aggregation.upper()}({'*' if m.column == '*' else quote(m.column)}) AS {quote(m.name)}"
