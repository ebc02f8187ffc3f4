"""A read-only gate for SQL texts: an allow-list over Spark's own parsed plans, and bounded runs.

A text is parsed, never run, before it is let through: one SELECT-like statement, of node
kinds on a list, over named tables, with functions on a list. What passes is run under a
row cap and a deadline.
"""

from __future__ import annotations

import math
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyforge.session import require_revision

#: Kinds of parsed plan nodes that only read.
NODES = set(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias "
    "UnresolvedRelation UnresolvedWith CTERelationDef UnresolvedHaving Window WithWindowDefinition OneRowRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedInlineTable LocalRelation RepartitionByExpression UnresolvedHint "
    "LateralJoin Pivot Unpivot Sample ParameterizedQuery UnresolvedCTERelationDef".split()
)
#: Functions that read their arguments only.
FUNCTIONS = set(
    "abs acos add_months any_value approx_count_distinct array array_contains asin atan atan2 avg bit_and bit_or bool_and bool_or "
    "bround btrim case cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count "
    "count_if covar_pop covar_samp cume_dist current_date current_timestamp date date_add date_diff date_format date_part date_sub "
    "date_trunc datediff day dayofmonth dayofweek dayofyear decode degrees dense_rank element_at endswith every exp explode extract "
    "first first_value floor format_number format_string from_unixtime get_json_object greatest grouping grouping_id hour if ifnull "
    "ilike in initcap instr isnotnull isnull json_extract lag last last_day last_value lcase lead least left len length like listagg "
    "ln locate log log10 log2 lower lpad ltrim make_date max max_by md5 mean median min min_by minute mod mode month months_between "
    "negative nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod position positive pow power printf quarter "
    "radians rank regexp_count regexp_extract regexp_like regexp_replace repeat replace reverse right rlike round row_number rpad "
    "rtrim second sha2 sign sin size sort_array split sqrt startswith std stddev stddev_pop stddev_samp string_agg strpos struct "
    "substr substring substring_index sum tan timestamp timestampdiff to_char to_date to_json to_number to_timestamp translate trim "
    "trunc try_cast try_divide typeof ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear when year "
    "and or not = == != <> < <= > >= <=> + - * / % || between div".split()
)
_LEXICAL = (
    (re.compile(r"/\*[!+]"), "executable comment"),
    (re.compile(r"\\"), "backslash"),
    (re.compile("\0"), "NUL"),
    (re.compile(r"--(?=\S)"), "comment without a space"),
    (re.compile(r"/\*(?:(?!\*/).)*/\*", re.S), "nested comment"),
)


class PolicyViolation(ValueError):
    """A text that isn't one read of allowed tables with allowed functions."""


def _items(seq) -> Iterator:
    """Members of a Scala sequence or iterator."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(node, found: list[tuple[str, str]], bound: frozenset[str] = frozenset()) -> None:
    """Names of all nodes: children, bodies of WITH, and plans inside expressions.

    ``bound`` are the names that WITH gives in this scope; other relations are tables.
    """
    kind = _kind(node)
    found.append((kind, node.nodeName()))
    if kind == "UnresolvedRelation":
        parts = list(_items(node.multipartIdentifier()))
        if len(parts) > 1 or parts[0].lower() not in bound:
            found.append(("table", ".".join(parts)))
    if kind == "UnresolvedWith":
        for relation in _items(node.cteRelations()):
            name = relation._1().lower()
            _walk(relation._2(), found, bound | {name} if node.allowRecursion() else bound)
            bound = bound | {name}
    for child in _items(node.children()):
        _walk(child, found, bound)
    for e in _items(node.expressions()):
        _walk_expression(e, found, bound)


def _walk_expression(e, found: list[tuple[str, str]], bound: frozenset[str] = frozenset()) -> None:
    name = _kind(e)
    found.append(("expression", name))
    if name == "UnresolvedFunction":
        found.append(("function", ".".join(_items(e.nameParts())).lower()))
    holder = e.getClass().getClassLoader().loadClass("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    if holder.isInstance(e):  # any kind of subquery
        _walk(e.plan(), found, bound)
    for child in _items(e.children()):
        _walk_expression(child, found, bound)


def parsed_nodes(spark: SparkSession, sql: str) -> list[tuple[str, str]]:
    """(kind, name) of every node, table and function of a parsed text."""
    found: list[tuple[str, str]] = []
    _walk(_parsed(spark, sql, "parsePlan"), found)
    return found


def _parsed(spark: SparkSession, text: str, how: str):
    try:
        return getattr(spark._jsparkSession.sessionState().sqlParser(), how)(text)
    except Exception as e:
        raise PolicyViolation(f"not one statement: {str(e).splitlines()[0][:200]}") from None


_FILE_NAME = re.compile(r"[/\\:]|\.(?:csv|parquet|json|txt|orc|avro)(?:\.|$)", re.I)


def _require_table(spark: SparkSession, name: str, tables: set[str] | None) -> None:
    """A table by its plain name, or by a database that exists; none outside ``tables`` where these are given."""
    if tables is not None and name.lower() not in {t.lower() for t in tables}:
        raise PolicyViolation(f"table not allowed: {name}")
    if _FILE_NAME.search(name):
        raise PolicyViolation(f"files are no tables: {name}")
    database = name.rpartition(".")[0]
    if database and not _database_exists(spark, database):
        raise PolicyViolation(f"no such database: {database}")


def _database_exists(spark: SparkSession, name: str) -> bool:
    try:
        return spark.catalog.databaseExists(name)
    except AnalysisException:  # a catalog that is not configured
        return False


def require_read_query(spark: SparkSession, sql: str, tables: set[str] | None = None) -> str:
    """The text, if it is one read; EXPLAIN of a read is one too. ``tables`` are all that it may name."""
    for pattern, what in _LEXICAL:
        if pattern.search(sql):
            raise PolicyViolation(what)
    body = re.sub(r"^\s*explain\s+(?=select|with|\()", "", sql, flags=re.I)
    for kind, name in parsed_nodes(spark, body.strip().rstrip(";")):
        if kind == "function":
            if name not in FUNCTIONS:
                raise PolicyViolation(f"function not allowed: {name}")
        elif kind == "table":
            _require_table(spark, name, tables)
        elif kind != "expression" and kind not in NODES:
            raise PolicyViolation(f"not allowed: {kind}")
    return sql


def require_expression(text: str, spark: SparkSession | None = None) -> str:
    """An expression text without comments, subqueries or functions off the list, by Spark's own parser."""
    if re.search(r";|--|/\*", text):
        raise PolicyViolation("an expression only")
    found: list[tuple[str, str]] = []
    _walk_expression(_parsed(spark or SparkSession.active(), text, "parseExpression"), found)
    for kind, name in found:
        if kind == "function" and name not in FUNCTIONS:
            raise PolicyViolation(f"function not allowed: {name}")
        if kind not in ("function", "expression"):
            raise PolicyViolation("no subquery in an expression")
    return text


@dataclass
class Bounded:
    """Rows of a bounded run."""

    columns: list[str]
    rows: list[tuple]
    truncated: bool


#: Fixed value: the most bytes of a result.
MOST_BYTES = 8 * 1024 * 1024


def _size(f: T.StructField, c: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def _within(df: DataFrame, most_bytes: int) -> DataFrame:
    """One column of rows in order, null from where they are over ``most_bytes`` together; for a limited number of rows."""
    x = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    size = F.lit(0).cast("long")
    for f in x.schema.fields:
        size = size + _size(f, F.col(f.name))
    upto = F.sum("bytes").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = x.select(F.struct("*").alias("row"), size.alias("bytes")).withColumn("n", F.monotonically_increasing_id())
    return rows.withColumn("upto", upto).select(F.when(F.col("upto") <= most_bytes, F.col("row")).alias("row"), "n").orderBy("n").select("row")


def bounded(df: DataFrame, most: int = 1000, seconds: float = 30.0, most_bytes: int = MOST_BYTES) -> Bounded:
    """At most ``most`` rows of at most ``most_bytes`` within a deadline; one more is looked at to tell whether there are more.

    Rows are measured where they are made; those beyond the bytes do not reach the driver.
    """
    spark = df.sparkSession
    group = f"bounded-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "bounded run", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        rows = [r.row for r in _within(df.limit(most + 1), most_bytes).collect()] if df.columns else df.limit(most + 1).collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    held = rows.index(None) if None in rows else len(rows)
    return Bounded(df.columns, [tuple(r) for r in rows[: min(held, most)]], len(rows) > min(held, most))


#: Functions whose results are as long as an argument says, and the place of that argument.
_GROWS = {"StringRepeat": 1, "StringLPad": 1, "StringRPad": 1, "ArrayRepeat": 1, "StringSpace": 0}


def _longest(e, most: int) -> int:
    """No constant of this expression is longer; refuses one over ``most`` and lengths that are no constants."""
    children = list(_items(e.children()))
    kind = _kind(e)
    if kind == "Literal":
        return len(str(e.value()))
    sizes = [_longest(c, most) for c in children]
    if kind in _GROWS:
        n = children[_GROWS[kind]]
        if not n.foldable():
            raise PolicyViolation("a length that is no constant")
        n = int(n.eval(None) or 0)
        size = n * max(1, sizes[0]) if kind.endswith("Repeat") else max(n, *sizes) if len(sizes) > 1 else n
    elif "Replace" in kind or "Translate" in kind:
        size = math.prod(max(1, x) for x in sizes)
    else:
        size = sum(sizes)
    if size > most:
        raise PolicyViolation(f"a value of more than {most} bytes")
    return size


def require_short_values(spark: SparkSession, sql: str, most: int = MOST_BYTES) -> None:
    """Refuse texts whose constants Spark would blow up beyond ``most`` bytes while it plans."""
    body = re.sub(r"^\s*explain\s+(?=select|with|\()", "", sql, flags=re.I)
    try:
        plan = spark.sql(body)._jdf.queryExecution().analyzed()
    except Exception:  # what does not resolve is for the validation to tell
        return

    def walk(node) -> None:
        for x in logical_nodes(node):
            for e in _items(x.expressions()):
                _longest(e, most)
                inner(e)

    def inner(e) -> None:
        holder = e.getClass().getClassLoader().loadClass("org.apache.spark.sql.catalyst.expressions.PlanExpression")
        if holder.isInstance(e):
            walk(e.plan())
        for c in _items(e.children()):
            inner(c)

    walk(plan)


def run_query(
    spark: SparkSession, sql: str, most: int = 1000, seconds: float = 30.0, tables: set[str] | None = None, revisions: dict[str, str] | None = None
) -> Bounded:
    """Gate and validate a text, see that the tables' schemas are those captured, then run it bounded.

    Schemas are looked at when it runs, never from a cache, so a table that changed meanwhile is seen.
    """
    from tallyforge.plans.validate import validate

    require_read_query(spark, sql, tables)
    require_short_values(spark, sql)
    report = validate(spark, sql, tables=tables)
    if not report.valid:
        raise PolicyViolation("; ".join(report.errors))
    for name, captured in (revisions or {}).items():
        require_revision(spark.table(name), captured)
    return bounded(spark.sql(sql), most, seconds)


@dataclass
class PlanFacts:
    """What a physical plan does."""

    scans: list[str] = field(default_factory=list)
    full_scans: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    pushed: bool = False
    exchanges: int = 0
    estimated_bytes: int = 0
    estimated_rows: int | None = None
    warnings: list[str] = field(default_factory=list)


def physical_nodes(node) -> Iterator:
    """All nodes of a physical plan, through adaptive plans and their stages."""
    kind = _kind(node)
    if kind == "AdaptiveSparkPlanExec":
        yield from physical_nodes(node.executedPlan())
        return
    yield node
    if kind.endswith("QueryStageExec"):
        yield from physical_nodes(node.plan())
    for child in _items(node.children()):
        yield from physical_nodes(child)


def logical_nodes(node) -> Iterator:
    """All nodes of a logical plan."""
    yield node
    for child in _items(node.children()):
        yield from logical_nodes(child)


def _wrapped_columns(e) -> Iterator[str]:
    """Columns that a comparison reaches only through a function, so no source can skip by them."""
    if _kind(e) in ("EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "InSet"):
        side = next(_items(e.children()))
        if _kind(side) not in ("AttributeReference", "Literal", "Cast") and not side.foldable():
            yield from (a.name() for a in _items(side.references()))
    for child in _items(e.children()):
        yield from _wrapped_columns(child)


def plan_facts(df: DataFrame) -> PlanFacts:
    """Scans, joins, pushed filters, exchanges and sizes of a plan, and what looks costly."""
    execution, out = df._jdf.queryExecution(), PlanFacts()
    for node in physical_nodes(execution.executedPlan()):
        kind = _kind(node)
        if kind == "FileSourceScanExec":
            name = node.relation().fileFormat().toString()
            pushed = node.metadata().get("PushedFilters")
            held = pushed.isDefined() and pushed.get() != "[]"
            out.scans.append(name)
            out.pushed = out.pushed or held
            if not held and not node.partitionFilters().nonEmpty():
                out.full_scans.append(name)
        elif kind.endswith(("JoinExec", "CartesianProductExec")):
            out.joins.append(kind.removesuffix("Exec"))
        elif kind == "ShuffleExchangeExec":
            out.exchanges += 1
    stats = execution.optimizedPlan().stats()
    out.estimated_bytes = int(str(stats.sizeInBytes()))
    out.estimated_rows = int(str(stats.rowCount().get())) if stats.rowCount().isDefined() else None
    filters = [x for x in logical_nodes(execution.optimizedPlan()) if _kind(x) == "Filter"]
    if out.scans and not filters:
        out.warnings.append("no filter: every row is read")
    for name in dict.fromkeys(c for x in filters for c in _wrapped_columns(x.condition())):
        out.warnings.append(f"a filter over a function of {name} is not pushed")
    if {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(out.joins):
        out.warnings.append("a join without an equality condition")
    return out


def merged_facts(facts: list[PlanFacts]) -> PlanFacts:
    """Facts of several plans as one: lists joined, sizes added, each warning once."""
    out = PlanFacts()
    for x in facts:
        for name in ("scans", "full_scans", "joins"):
            getattr(out, name).extend(getattr(x, name))
        out.pushed, out.exchanges = out.pushed or x.pushed, out.exchanges + x.exchanges
        out.estimated_bytes += x.estimated_bytes
        out.warnings += [w for w in x.warnings if w not in out.warnings]
    rows = [x.estimated_rows for x in facts]
    out.estimated_rows = sum(rows) if rows and None not in rows else None
    return out


#: What an alias may stand for without being a subquery.
_NAMED = ("UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation", "UnresolvedTableValuedFunction", "SubqueryAlias")


def structure(spark: SparkSession, sql: str) -> dict:
    """What a text is made of, by its parsed plan: tables, joins, and whether it filters, sorts, groups, nests or names statements."""
    found = parsed_nodes(spark, sql)
    kinds = [k for k, _ in found]
    aliases = [next(_items(x.children())) for x in logical_nodes(_parsed(spark, sql, "parsePlan")) if _kind(x) == "SubqueryAlias"]
    functions = {n for k, n in found if k == "function"}
    return {
        "tables": sorted({n for k, n in found if k == "table"}), "joins": kinds.count("Join") + kinds.count("LateralJoin"), "where": "Filter" in kinds, "order": "Sort" in kinds,
        "aggregate": "Aggregate" in kinds or bool(functions & {"count", "sum", "avg", "min", "max"}),
        "subquery": any(k == "expression" and n in ("ScalarSubquery", "Exists", "ListQuery") for k, n in found) or any(_kind(x) not in _NAMED for x in aliases), "cte": "UnresolvedWith" in kinds,
    }
