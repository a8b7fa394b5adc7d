"""The fluent query of a declared table. Each call returns a new builder; df() gives a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from keyloom.plans.planner import Route, key_bounds, plan
from keyloom.plans.predicates import Pred, QueryError, conjunction, from_specs, resolve
from keyloom.plans.schema import VERSION, CompiledTable, TableSchema, compile_table


class Columns:
    """Handles of a table's columns by attribute."""

    def __init__(self, table: CompiledTable):
        self._table = table

    def __getattr__(self, name: str) -> Column:
        return F.col(resolve(self._table, name))


@dataclass(frozen=True)
class Table:
    """A declared table over a DataFrame, with the layouts built from it by name."""

    schema: TableSchema
    data: DataFrame
    layouts: Mapping[str, DataFrame] = field(default_factory=dict)

    @property
    def compiled(self) -> CompiledTable:
        return compile_table(self.schema)

    @property
    def c(self) -> Columns:
        return Columns(self.compiled)

    def query(self) -> Query:
        return Query(self)

    def via(self, data: DataFrame) -> Table:
        """The same table over another DataFrame."""
        return replace(self, data=data, layouts={})

    def with_layouts(self, layouts: Mapping[str, DataFrame]) -> Table:
        return replace(self, layouts={**self.layouts, **layouts})


@dataclass(frozen=True)
class Aggregate:
    fn: str
    column: str
    same_type: bool = False


def sum_(column: str, same_type: bool = False) -> Aggregate:
    return Aggregate("sum", column, same_type)


def avg(column: str) -> Aggregate:
    return Aggregate("avg", column)


def max_(column: str) -> Aggregate:
    return Aggregate("max", column)


@dataclass(frozen=True)
class Query:
    table: Table
    preds: tuple[Pred, ...] = ()
    selected: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    aggregates: tuple[tuple[str, Aggregate], ...] = ()
    descending: bool = False
    most: int | None = None
    scan: bool = True
    zeros: bool = False

    def where(self, column: str, op: str, *values: Any) -> Query:
        return replace(self, preds=(*self.preds, Pred(resolve(self.table.compiled, column), op, tuple(values))))

    def eq(self, column: str, v: Any) -> Query:
        return self.where(column, "=", v)

    def ne(self, column: str, v: Any) -> Query:
        return self.where(column, "!=", v)

    def gt(self, column: str, v: Any) -> Query:
        return self.where(column, ">", v)

    def ge(self, column: str, v: Any) -> Query:
        return self.where(column, ">=", v)

    def lt(self, column: str, v: Any) -> Query:
        return self.where(column, "<", v)

    def le(self, column: str, v: Any) -> Query:
        return self.where(column, "<=", v)

    def isin(self, column: str, values: Sequence) -> Query:
        return self.where(column, "IN", *values)

    def between(self, column: str, low: Any, high: Any) -> Query:
        return self.where(column, "BETWEEN", low, high)

    def contains(self, column: str, v: Any) -> Query:
        return self.where(column, "CONTAINS", v)

    def begins_with(self, column: str, prefix: str) -> Query:
        return self.where(column, "BEGINS_WITH", prefix)

    def where_spec(self, specs: Sequence[dict]) -> Query:
        return replace(self, preds=(*self.preds, *from_specs(self.table.compiled, specs)))

    def select(self, *columns: str) -> Query:
        return replace(self, selected=tuple(resolve(self.table.compiled, c) for c in columns))

    def exclude(self, *columns: str) -> Query:
        """All visible columns but these; a selection wins over it."""
        return replace(self, excluded=tuple(resolve(self.table.compiled, c) for c in columns))

    def group_by(self, *columns: str, **aggregates: Aggregate) -> Query:
        if not columns:
            raise QueryError("a grouping needs a column")
        return replace(self, groups=tuple(resolve(self.table.compiled, c) for c in columns), aggregates=tuple(aggregates.items()))

    def order_desc(self) -> Query:
        return replace(self, descending=True)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def allow_scan(self, allowed: bool = True) -> Query:
        return replace(self, scan=allowed)

    def coalesce_zero(self) -> Query:
        """Nulls read as zero values, as of records without pointers."""
        return replace(self, zeros=True)

    def delta(self, since: int, *values: int) -> Query:
        """Rows changed after version `since`. The first time with the values asked for; later with every declared value
        of that column, since a row may have left them. Call it last: the other predicates tell which column it is."""
        from keyloom.operators.incremental import delta_column

        out = self.where(VERSION, ">=", since + 1)
        if not values:
            return out
        column = delta_column(self.table.compiled, self.preds)
        if since > 0:
            domain = self.table.compiled.fixed.get(column)
            values = domain.enumerated() if domain else ()
            if not values:
                raise QueryError(f"column {column} has no declared values")
        return out.eq(column, values[0]) if len(values) == 1 else out.isin(column, values)

    # ---------------------------------------------------------------------------------------------------------------

    @property
    def output(self) -> tuple[str, ...]:
        if self.groups:
            return self.groups
        visible = self.table.compiled.visible
        return self.selected or tuple(c for c in visible if c not in self.excluded and c in self.table.data.columns)

    def _wanted(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.output, *[a.column for _, a in self.aggregates], *[p.column for p in self.preds if p.op != "CONTAINS"])))

    def route(self) -> Route:
        return plan(self.table.compiled, self.preds, self._wanted(), set(self.table.layouts), self.scan)

    def explain_route(self) -> str:
        r = self.route()
        return f"{r}{'' if r.source.kind == 'base' or r.source.name in self.table.layouts else '; not built, so the base table is read'}"

    def _filtered(self) -> tuple[DataFrame, Route]:
        route, t = self.route(), self.table.compiled
        layout = self.table.layouts.get(route.source.name)
        preds: list[Pred] = [*self.preds, *route.redundant]
        if layout is None:
            df = self.table.data
            preds += key_bounds(t, self.preds)
        else:
            df = layout
            if route.source.exploded:
                preds = [Pred(p.column, "=", p.values) if p.op == "CONTAINS" and p.column == route.source.exploded else p for p in preds]
        df = df.where(conjunction(preds)) if preds else df
        if layout is not None and route.source.kind == "group" and any(t.columns[k].spec.is_collection for k in route.source.keys):
            df = df.dropDuplicates([k for k in t.primary_key if k in df.columns])  # a row stands once for each combination
        return df, route

    def df(self) -> DataFrame:
        t = self.table.compiled
        if self.groups and (self.selected or self.excluded):
            raise QueryError("a grouping takes no selection")
        df, route = self._filtered()
        if self.groups:
            aggs = []
            for name, a in self.aggregates:
                column = resolve(t, a.column)
                spec = t.columns[column].spec
                if a.fn == "avg" and spec.spark not in ("float", "double"):
                    raise QueryError(f"avg requires a float column, and {column} is {spec.spark}")
                c = {"sum": F.sum, "avg": F.avg, "max": F.max}[a.fn](column)
                aggs.append((c.cast(spec.spark) if a.same_type else c).alias(name))
            df = df.groupBy(*self.groups).agg(*aggs) if aggs else df.select(*self.groups).distinct()
            key = self.groups[0]
        else:
            if self.aggregates:
                raise QueryError("aggregates need a grouping")
            keys = [k for k in route.source.keys if k in df.columns]
            key = keys[0] if keys else t.schema.keys[0]
        if self.descending:
            df = df.orderBy(F.col(key).desc())
        if self.most is not None:
            df = df.limit(self.most)
        if self.groups:
            return df
        df = df.select(*self.output)
        return reduce(lambda d, c: d.withColumn(c, _zero(c, t)), self.output, df) if self.zeros else df

    def rows(self, handler: Callable[[Row], bool] | None = None) -> Iterator[Row]:
        """Rows one partition at a time; those for which the handler is true are not passed on."""
        for row in self.df().toLocalIterator(prefetchPartitions=True):
            if handler is None or not handler(row):
                yield row

    def json(self) -> DataFrame:
        return self.df().select(F.to_json(F.struct("*")).alias("value"))


def _zero(name: str, t: CompiledTable) -> Column:
    spec = t.columns[name].spec
    if spec.nullable or spec.is_collection or spec.spark == "binary":
        return F.col(name)
    return F.coalesce(F.col(name), F.lit("" if spec.spark == "string" else False if spec.spark == "boolean" else 0).cast(spec.spark))


def page(table: Table, partition: Any, limit: int, after: Any = None) -> DataFrame:
    """A page of a partition in key order: at most `limit` rows with keys beyond `after`."""
    q, key = table.query().eq(table.schema.partition, partition), table.schema.keys[0]
    if after is not None:
        q = q.gt(key, after)
    return q.df().orderBy(*table.schema.keys).limit(limit)
