"""Formula metrics: free aggregate expressions with six grains, filters, order and limit."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.plans.policy import require_expression

GRAINS = ("hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class FormulaMetric:
    """A metric as an aggregate expression, or a template with ``{filters}``."""

    name: str
    formula: str
    time_column: str | None = None
    aliases: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    domain: str = ""


def resolve(metrics: list[FormulaMetric], name: str, domain: str = "") -> FormulaMetric | None:
    """By name, alias, then either in any case; a domain's own metric before a global one."""
    for scope in (domain, "") if domain else ("",):
        own = [m for m in metrics if m.domain == scope]
        for test in (lambda m: m.name == name, lambda m: name in m.aliases, lambda m: name.lower() in {x.lower() for x in (m.name, *m.aliases)}):
            if found := next(filter(test, own), None):
                return found
    return None


def truncated(col: Column, grain: str) -> Column:
    """Start of the period that holds a time stamp; an unknown grain is a day."""
    return F.date_trunc(grain if grain in GRAINS else "day", col).cast("timestamp_ntz")


def fill_template(template: str, filters: dict[str, object]) -> Column:
    """A template as an expression; its ``{filters}`` become a conjunction, true when empty."""
    clause = " AND ".join(f"({_quoted(k)} = {_literal(v)})" for k, v in filters.items()) or "1=1"
    return F.expr(require_expression(template.replace("{filters}", clause)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(v: object) -> str:
    if isinstance(v, bool) or v is None:
        return str(v).upper() if v is not None else "NULL"
    return str(v) if isinstance(v, int | float) else "'" + re.sub(r"(['\\])", r"\\\1", str(v)) + "'"


def query_metrics(
    fact: DataFrame, metrics: list[FormulaMetric], dimensions: list[str] = (), grain: str | None = None,
    filters: dict[str, object] | None = None, order_by: list[tuple[str, bool]] = (), limit: int | None = None,
) -> DataFrame:
    """One aggregate pass for all metrics, by truncated period and dimensions."""
    for k, v in (filters or {}).items():
        fact = fact.where(F.col(k) == F.lit(v))
    keys: list[Column] = [F.col(d) for d in dimensions]
    if grain:
        keys.insert(0, truncated(F.col(metrics[0].time_column), grain).alias("period"))
    values = [F.expr(require_expression(m.formula)).alias(m.name) for m in metrics]
    out = fact.groupBy(*keys).agg(*values) if keys else fact.agg(*values)
    if order_by:
        out = out.orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in order_by))
    return out.limit(limit) if limit is not None else out


def lineage(fact: DataFrame, metric: FormulaMetric) -> dict[str, list[str]]:
    """Columns that a formula reads and the files behind them."""
    out = fact.agg(F.expr(require_expression(metric.formula)).alias(metric.name))
    seen = out._jdf.queryExecution().analyzed().references().mkString(",")
    return {"columns": sorted({re.sub(r"#\d+L?$", "", c) for c in seen.split(",") if c}), "files": sorted(out.inputFiles())}


def from_terms(terms: list[tuple[str, str]], known: list[FormulaMetric], domain: str = "") -> list[FormulaMetric]:
    """Metrics of (name, expression) terms that have both and are no metric yet."""
    new: list[FormulaMetric] = []
    for name, expression in terms:
        if name and expression and not resolve([*known, *new], name, domain):
            new.append(FormulaMetric(name, expression, domain=domain))
    return new


def suggested_dimensions(metrics: list[FormulaMetric]) -> list[str]:
    """Dimensions of any of the metrics, in order."""
    return sorted({d for m in metrics for d in m.dimensions})
