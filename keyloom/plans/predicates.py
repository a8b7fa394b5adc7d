"""Predicates of a query, as data: a list of them is a conjunction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.types import TypeSpec
from keyloom.plans.schema import CompiledTable

#: Those that a query given as data may use, then those of the fluent form and of plans; RANGES is an OR of bounds.
SPEC_OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "IN", "BETWEEN", "CONTAINS")
OPERATORS = (*SPEC_OPERATORS, "BEGINS_WITH", "RANGES")


class QueryError(ValueError):
    """A query that cannot be answered as it is asked."""


@dataclass(frozen=True)
class Pred:
    column: str
    op: str
    values: tuple = ()

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise QueryError(f"unknown operator {self.op}")
        if self.op == "IN" and not self.values:
            raise QueryError(f"IN of {self.column} needs values")
        if self.op == "BETWEEN" and len(self.values) != 2:
            raise QueryError(f"BETWEEN of {self.column} needs two bounds")

    @property
    def op_class(self) -> str:
        """What a source must offer: equality, a range, or membership. An inequality is served by no key."""
        return {"CONTAINS": "@", "!=": "!"}.get(self.op, "=" if self.op in ("=", "IN") else "~")

    def column_expr(self, c: Column | None = None) -> Column:
        c = F.col(self.column) if c is None else c
        v = self.values
        match self.op:
            case "=":
                return c == F.lit(v[0])
            case "!=":
                return c != F.lit(v[0])
            case ">":
                return c > F.lit(v[0])
            case ">=":
                return c >= F.lit(v[0])
            case "<":
                return c < F.lit(v[0])
            case "<=":
                return c <= F.lit(v[0])
            case "IN":
                return c.isin(*v)
            case "BETWEEN":
                return c.between(F.lit(v[0]), F.lit(v[1]))
            case "RANGES":
                return reduce(Column.__or__, [c.between(F.lit(a), F.lit(b)) for a, b in v]) if v else F.lit(False)
            case "CONTAINS":
                return F.array_contains(c, v[0])
            case _:
                return F.startswith(c, F.lit(v[0]))


def conjunction(preds: Sequence[Pred]) -> Column:
    out = F.lit(True)
    for k, p in enumerate(preds):
        out = p.column_expr() if not k else out & p.column_expr()
    return out


def resolve(table: CompiledTable, name: str) -> str:
    """A column by its stored name or its field name, whatever its case."""
    wanted = name.strip().lower()
    for c in table.columns:
        if wanted in (c.lower(), c.lower().replace("_", "")):
            return c
    raise QueryError(f"table {table.schema.name} has no column {name}")


def coerce(value: Any, spec: TypeSpec) -> Any:
    """A value of JSON as one of a column's element type, exactly: fractions do not become integers."""
    kind = spec.element
    if kind in ("bigint", "int", "smallint", "tinyint"):
        if isinstance(value, bool):
            raise QueryError(f"{value!r} is no {kind}")
        try:
            out = int(value) if isinstance(value, (int, str)) else int(value) if isinstance(value, float) and value.is_integer() else None
        except ValueError:
            out = None
        bits = {"bigint": 63, "int": 31, "smallint": 15, "tinyint": 7}[kind]
        if out is None or not -(1 << bits) <= out < 1 << bits:
            raise QueryError(f"{value!r} is no {kind}")
        return out
    if kind in ("float", "double"):
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            raise QueryError(f"{value!r} is no {kind}")
        try:
            return float(value)
        except ValueError:
            raise QueryError(f"{value!r} is no {kind}") from None
    if kind == "boolean":
        if not isinstance(value, bool):
            raise QueryError(f"{value!r} is no {kind}")
        return value
    if kind == "string":
        if not isinstance(value, str):
            raise QueryError(f"{value!r} is no {kind}")
        return value
    raise QueryError(f"columns of type {kind} cannot be filtered")


def from_specs(table: CompiledTable, specs: Sequence[dict]) -> list[Pred]:
    """Predicates of dicts with column, op and value, values, or from and to."""
    out = []
    for s in specs:
        column = resolve(table, s["column"])
        spec = table.columns[column].spec
        op = str(s.get("op", "=")).strip().upper() or "="
        op = {"==": "=", "<>": "!="}.get(op, op)
        if op not in SPEC_OPERATORS:
            raise QueryError(f"unknown operator {op}")
        if op == "IN":
            values = tuple(coerce(v, spec) for v in s.get("values") or ())
        elif op == "BETWEEN":
            if s.get("from") is None or s.get("to") is None:
                raise QueryError(f"BETWEEN of {column} needs from and to")
            values = coerce(s["from"], spec), coerce(s["to"], spec)
        else:
            if s.get("value") is None:
                raise QueryError(f"{op} of {column} needs a value")
            values = (coerce(s["value"], spec),)
        if spec.is_collection != (op == "CONTAINS"):
            raise QueryError(f"{op} does not fit column {column}")
        out.append(Pred(column, op, values))
    return out
