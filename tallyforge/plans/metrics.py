"""Named metrics: a versioned catalog, checked selections, and their DataFrame plans.

A selection names metrics of one fact table, dimensions of the fact or of a lookup,
equality filters and at most one calendar grain. It compiles to one aggregate: filters
first, the lookup joined only if a dimension or filter needs it, one pass for all metrics.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATIONS = ("sum", "count", "avg", "min", "max")
GRAINS = ("day", "week", "month")
MOST_METRICS, MOST_DIMENSIONS, MOST_FILTERS = 8, 32, 32


class CatalogError(ValueError):
    """A catalog or selection that can't be right."""


@dataclass(frozen=True)
class Lookup:
    """A dimension table joined on its single-column key."""

    fact_key: str
    table: str
    key: str
    dimensions: tuple[tuple[str, str], ...]  # (alias, column)


@dataclass(frozen=True)
class Metric:
    """One aggregate of a fact table."""

    name: str
    table: str
    column: str
    aggregation: str
    dimensions: tuple[str, ...] = ()
    date_column: str | None = None
    lookup: Lookup | None = None

    def dimension_names(self) -> tuple[str, ...]:
        return self.dimensions + tuple(a for a, _ in (self.lookup.dimensions if self.lookup else ()))


@dataclass(frozen=True)
class Catalog:
    """All metrics of one version."""

    version: str
    metrics: tuple[Metric, ...]

    def fingerprint(self) -> str:
        """A hash of the content, equal for equal catalogs."""
        return hashlib.sha256(repr(self).encode()).hexdigest()

    def metric(self, name: str) -> Metric:
        found = next((m for m in self.metrics if m.name == name), None)
        if found is None:
            raise CatalogError(f"unknown metric: {name}")
        return found

    def listing(self) -> list[dict]:
        """What can be asked: metrics with their dimensions and grains."""
        return [
            {"metric": m.name, "table": m.table, "aggregation": m.aggregation, "dimensions": list(m.dimension_names()), "grains": list(GRAINS) if m.date_column else []}
            for m in self.metrics
        ]


def _unique(pairs: list[tuple]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise CatalogError(f"repeated key: {k}")
        out[k] = v
    return out


def _yaml(text: str) -> object:
    """Plain YAML: no aliases, no repeated keys, no tags beyond the safe ones."""
    try:
        import yaml
    except ImportError:
        raise CatalogError("PyYAML is not installed: give the catalog as JSON") from None

    class Loader(yaml.SafeLoader):
        def compose_node(self, parent, index):
            if self.check_event(yaml.events.AliasEvent):
                raise CatalogError("no aliases in a catalog")
            return super().compose_node(parent, index)

        def construct_mapping(self, node, deep=False):
            return _unique([(self.construct_object(k, deep=True), self.construct_object(v, deep=True)) for k, v in node.value])

    Loader.add_constructor("tag:yaml.org,2002:map", Loader.construct_mapping)
    try:
        return yaml.load(text, Loader)  # a safe loader
    except yaml.YAMLError as e:
        raise CatalogError(f"no YAML: {str(e).splitlines()[0]}") from None


def load_catalog(text: str) -> Catalog:
    """A catalog from JSON or YAML: version and metrics; repeated keys and names, and aliases, are refused."""
    if len(text.encode()) > 1 << 20:
        raise CatalogError("a catalog has 1 MiB at most")
    spec = json.loads(text, object_pairs_hook=_unique) if text.lstrip().startswith("{") else _yaml(text)
    if not isinstance(spec, dict) or not {"version", "metrics"} <= set(spec):
        raise CatalogError("a catalog has a version and metrics")
    metrics = []
    for m in spec["metrics"]:
        if m["aggregation"] not in AGGREGATIONS:
            raise CatalogError(f"unknown aggregation: {m['aggregation']}")
        if m["column"] == "*" and m["aggregation"] != "count":
            raise CatalogError("only count takes *")
        look = m.get("lookup")
        metrics.append(
            Metric(
                m["name"], m["table"], m["column"], m["aggregation"], tuple(m.get("dimensions", ())), m.get("date_column"),
                Lookup(look["fact_key"], look["table"], look["key"], tuple(sorted(look["dimensions"].items()))) if look else None,
            )
        )
    if len({m.name for m in metrics}) < len(metrics):
        raise CatalogError("metric names repeat")
    return Catalog(spec["version"], tuple(metrics))


@dataclass(frozen=True)
class Selection:
    """What to compute; ``check`` refuses what can't be."""

    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[tuple[str, object], ...] = field(default=())
    grain: str | None = None
    start: date | None = None
    end: date | None = None


def check(catalog: Catalog, s: Selection) -> list[Metric]:
    """The selected metrics, if the selection follows all rules."""
    for kind, names, most in (("metrics", s.metrics, MOST_METRICS), ("dimensions", s.dimensions, MOST_DIMENSIONS), ("filters", [k for k, _ in s.filters], MOST_FILTERS)):
        if len(names) > most:
            raise CatalogError(f"at most {most} {kind}")
        if len(set(names)) < len(names):
            raise CatalogError(f"{kind} repeat")
    if not s.metrics:
        raise CatalogError("name a metric")
    found = [catalog.metric(n) for n in s.metrics]
    if len({(m.table, m.lookup) for m in found}) > 1:
        raise CatalogError("metrics of one selection share a fact table and lookup")
    for name in (*s.dimensions, *(k for k, _ in s.filters)):
        if any(name not in m.dimension_names() for m in found):
            raise CatalogError(f"unknown dimension: {name}")
    if s.grain is not None:
        if s.grain not in GRAINS:
            raise CatalogError(f"unknown grain: {s.grain}")
        if len({m.date_column for m in found}) > 1 or not found[0].date_column:
            raise CatalogError("a grain needs one date column")
    return found


def period(day: Column, grain: str) -> Column:
    """First day of the calendar period; weeks begin on Monday."""
    return F.to_date(F.date_trunc(grain, day))


def compile_selection(catalog: Catalog, s: Selection, tables: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of a selection: period, dimensions, metrics, ordered by its groups."""
    found = check(catalog, s)
    first, fact = found[0], tables[found[0].table]
    own = {d: F.col(d) for d in first.dimensions}
    looked = {a: c for a, c in first.lookup.dimensions} if first.lookup else {}
    wanted = {*s.dimensions, *(k for k, _ in s.filters)}
    if wanted & set(looked):
        fact = fact.join(_lookup(first.lookup, fact, tables, wanted), fact[first.lookup.fact_key] == F.col("lookup_key"), "left")
        own |= {a: F.col(f"lookup_{a}") for a in looked if a in wanted}
    for name, value in s.filters:
        fact = fact.where(own[name] == F.lit(value))
    keys = [own[d].alias(d) for d in s.dimensions]
    if s.grain:
        if not isinstance(fact.schema[first.date_column].dataType, T.DateType):
            raise CatalogError("a grain needs a DATE column")
        keys.insert(0, period(F.col(first.date_column), s.grain).alias("period_start"))
    values = [_aggregate(m).alias(m.name) for m in found]
    out = fact.groupBy(*keys).agg(*values) if keys else fact.agg(*values)
    groups = (["period_start"] if s.grain else []) + list(s.dimensions)
    return out.orderBy(*(F.col(g).asc_nulls_first() for g in groups)) if groups else out


def _lookup(look: Lookup, fact: DataFrame, tables: dict[str, DataFrame], wanted: set[str]) -> DataFrame:
    """The dimension table by its key. Keys are whole numbers, and one that repeats fails the query: it would multiply sums."""
    dim = tables[look.table]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not isinstance(fact.schema[look.fact_key].dataType, whole) or not isinstance(dim.schema[look.key].dataType, whole):
        raise CatalogError("a lookup needs whole-number keys")
    once = lambda c: F.when(F.count("*") > 1, F.raise_error(F.lit(f"lookup key repeats: {look.table}.{look.key}"))).otherwise(F.first(c))
    keyed = dim.where(F.col(look.key).isNotNull()).groupBy(F.col(look.key).alias("lookup_key"))
    return keyed.agg(*(once(c).alias(f"lookup_{a}") for a, c in look.dimensions if a in wanted))


def _aggregate(m: Metric) -> Column:
    return F.count(F.lit(1) if m.column == "*" else F.col(m.column)) if m.aggregation == "count" else getattr(F, m.aggregation)(m.column)


def accept(result: DataFrame, columns: list[str], rows: list[tuple]) -> bool:
    """Whether a result has exactly these columns and these rows in this order."""
    got = result.limit(len(rows) + 1).collect()
    return result.columns == columns and [tuple(r) for r in got] == rows
