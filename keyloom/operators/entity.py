"""Entities of one key-value table: a partition key, a sort key and up to five secondary keys, made from columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.encode import composite_key, ordered64, ordered64_value
from keyloom.operators.write import autoincrement, last_of
from keyloom.plans.predicates import Pred, QueryError, conjunction
from keyloom.plans.schema import Col, SchemaError

# The names of operators, and the most rows of a dynamic query.
TOKENS = {"": "=", "=": "=", "==": "=", "eq": "=", ">": ">", "gt": ">", ">=": ">=", "gte": ">=", "<": "<", "lt": "<", "<=": "<=", "lte": "<=", "between": "BETWEEN", "begins_with": "BEGINS_WITH", "beginswith": "BEGINS_WITH", "prefix": "BEGINS_WITH"}
DYNAMIC_LIMIT = 400
SLOTS = ("n1", "n2", "s1", "s2", "s3")


@dataclass(frozen=True)
class EntitySchema:
    name: str
    columns: tuple[Col, ...]
    partition: tuple[Col, ...]
    sort: tuple[Col, ...] = ()
    secondary: dict[str, tuple[Col, ...]] = field(default_factory=dict, hash=False)
    autoincrement: bool = False
    padding: int = 0

    def __post_init__(self) -> None:
        names = {c.name: c for c in self.columns}
        if not self.partition:
            raise SchemaError(f"entity {self.name}: a partition is needed")
        if len(names) != len(self.columns):
            raise SchemaError(f"entity {self.name}: a column is repeated")
        if set(self.secondary) - set(SLOTS):
            raise SchemaError(f"entity {self.name}: secondary keys are {SLOTS}")
        for c in (*self.partition, *self.sort, *[c for keys in self.secondary.values() for c in keys]):
            if c.name not in names:
                raise SchemaError(f"entity {self.name}: key column {c.name} is not declared")
            kind = names[c.name].spec
            if kind.is_collection or kind.spark not in ("string", "bigint", "int", "smallint", "tinyint"):
                raise SchemaError(f"entity {self.name}: key column {c.name} must be text or an integer")
            if kind.spark != "string" and c in self.sort and not c.width:
                raise SchemaError(f"entity {self.name}: integer sort column {c.name} needs a width")
        if self.autoincrement and names[self.partition[-1].name].spec.spark == "string":
            raise SchemaError(f"entity {self.name}: autoincrement needs an integer partition column")

    def col(self, name: str) -> Col:
        for c in self.columns:
            if c.name == name:
                return c
        raise QueryError(f"entity {self.name} has no column {name}")


def _part(c: Col, kind: str) -> Column:
    if kind == "string":
        return F.col(c.name)
    return ordered64(F.col(c.name), c.width) if c.width else F.col(c.name).cast("string")


def key_columns(df: DataFrame, schema: EntitySchema) -> DataFrame:
    """df with pk, sk and the declared secondary keys as columns."""
    part = lambda keys: [_part(k, schema.col(k.name).spec.spark) for k in keys]
    out = {"pk": composite_key([F.lit(schema.name), *part(schema.partition)]), "sk": composite_key(part(schema.sort)) if schema.sort else F.lit("")}
    out |= {slot: composite_key([F.lit(schema.name), *part(keys)]) for slot, keys in schema.secondary.items()}
    return df.withColumns(out)


def key_value(schema: EntitySchema, keys: Sequence[Col], values: Sequence[Any]) -> str:
    parts = []
    for c, v in zip(keys, values, strict=True):
        if isinstance(v, str) and "#" in v:
            raise QueryError("a key part holds a number sign")
        parts.append(v if isinstance(v, str) else ordered64_value(v, c.width) if c.width else str(v))
    return "#".join(parts)


def coerce(value: Any, kind: str) -> Any:
    """A JSON value as one of a column; here numbers with a fraction lose it."""
    try:
        if kind in ("bigint", "int", "smallint", "tinyint"):
            return int(value) if not isinstance(value, bool) else int("no")
        if kind in ("float", "double"):
            return float(value)
        if kind == "boolean":
            if isinstance(value, bool):
                return value
            raise ValueError
        if kind == "string" and isinstance(value, str):
            return value
        raise ValueError
    except (TypeError, ValueError):
        raise QueryError(f"{value!r} is no {kind}") from None


@dataclass(frozen=True)
class Plan:
    """How a query is served: by which key, which predicates bind it, and which are left."""

    source: str
    bound: tuple[Pred, ...]
    residual: tuple[Pred, ...]


@dataclass(frozen=True)
class Entity:
    schema: EntitySchema
    data: DataFrame

    def query(self) -> EntityQuery:
        return EntityQuery(self)

    def _keys(self) -> list[str]:
        return [c.name for c in (*self.schema.partition, *self.schema.sort)]

    def get(self, *values: Any) -> DataFrame:
        keys = self._keys()
        return self.data.where(conjunction([Pred(k, "=", (v,)) for k, v in zip(keys, values, strict=True)])).limit(1)

    def put(self, rows: DataFrame, starts: DataFrame | None = None, order: Sequence[str] = (), last: str | None = None) -> Entity:
        """The entity with rows put in by key; ids that are 0 are drawn from the sequence. Of rows that repeat a key the one
        that is last by the column `last` counts; without it they must be equal."""
        if self.schema.autoincrement:
            column = self.schema.partition[-1].name
            rest = [c.name for c in self.schema.partition[:-1]]
            rows = autoincrement(rows, column, rest, list(order) or [c for c in rows.columns if c != column], starts, self.schema.padding)
        keys = self._keys()
        rows = last_of(rows, keys, last)
        kept = self.data.join(rows.select(*keys), keys, "left_anti")
        return replace(self, data=kept.select(*self.data.columns).unionByName(rows.select(*[c for c in rows.columns if c in self.data.columns]), allowMissingColumns=True))

    put_many = put

    def delete(self, keys: DataFrame) -> Entity:
        return replace(self, data=self.data.join(keys, self._keys(), "left_anti").select(*self.data.columns))

    def delete_all(self) -> tuple[Entity, int]:
        return replace(self, data=self.data.limit(0)), self.data.count()

    def top_n(self, n: int, *values: Any) -> DataFrame:
        """The first rows of a partition in the order of the sort key."""
        if len(values) != len(self.schema.partition):
            raise QueryError(f"a partition of {self.schema.name} takes {len(self.schema.partition)} values")
        own = self.data.where(conjunction([Pred(c.name, "=", (v,)) for c, v in zip(self.schema.partition, values, strict=True)]))
        return own.orderBy(*[c.name for c in self.schema.sort]).limit(n)

    def take(self, limit: int) -> DataFrame:
        """Any rows of the entity."""
        return self.data.limit(limit)

    def query_records(self, predicates: Sequence[dict], limit: int = DYNAMIC_LIMIT, desc: bool = False) -> DataFrame:
        """A query given as data; it must be served by keys alone, and gives at most DYNAMIC_LIMIT rows."""
        q = self.query()
        for p in predicates:
            kind = self.schema.col(p["field"]).spec.spark
            op = TOKENS.get(str(p.get("op", "")).strip().lower())
            if op is None:
                raise QueryError(f"unknown operator {p.get('op')}")
            values = [p.get("value")] + ([p.get("value2")] if op == "BETWEEN" else [])
            q = q.where(p["field"], op, *[coerce(v, kind) for v in values])
        if left := q.plan().residual:
            raise QueryError(f"no key serves {[x.column for x in left]}")
        q = q.limit(min(limit, DYNAMIC_LIMIT) if limit > 0 else DYNAMIC_LIMIT)
        return (q.desc() if desc else q).df()

    def describe(self) -> dict:
        describe = lambda keys: [{"name": c.name, "type": self.schema.col(c.name).spec.name, **({"width": c.width} if c.width else {})} for c in keys]
        return {"entity": self.schema.name, "columns": [{"name": c.name, "type": c.spec.name} for c in sorted(self.schema.columns, key=lambda c: c.name)], "partition": describe(self.schema.partition), "sort": describe(self.schema.sort), "secondary": {k: describe(v) for k, v in sorted(self.schema.secondary.items())}}


@dataclass(frozen=True)
class EntityQuery:
    entity: Entity
    preds: tuple[Pred, ...] = ()
    most: int | None = None
    descending: bool = False

    def where(self, column: str, op: str, *values: Any) -> EntityQuery:
        kind = self.entity.schema.col(column).spec
        if op == "BEGINS_WITH" and kind.spark != "string":
            raise QueryError(f"begins_with needs text, and {column} is {kind.spark}")
        return replace(self, preds=(*self.preds, Pred(column, op, tuple(values))))

    def eq(self, c: str, v: Any) -> EntityQuery:
        return self.where(c, "=", v)

    def gt(self, c: str, v: Any) -> EntityQuery:
        return self.where(c, ">", v)

    def gte(self, c: str, v: Any) -> EntityQuery:
        return self.where(c, ">=", v)

    def lt(self, c: str, v: Any) -> EntityQuery:
        return self.where(c, "<", v)

    def lte(self, c: str, v: Any) -> EntityQuery:
        return self.where(c, "<=", v)

    def between(self, c: str, a: Any, b: Any) -> EntityQuery:
        return self.where(c, "BETWEEN", a, b)

    def begins_with(self, c: str, prefix: str) -> EntityQuery:
        return self.where(c, "BEGINS_WITH", prefix)

    def limit(self, n: int) -> EntityQuery:
        return replace(self, most=n)

    def desc(self) -> EntityQuery:
        return replace(self, descending=True)

    def plan(self) -> Plan:
        """The base partition if all its columns are equal, else the first secondary key that is; then the sort key's
        leading equalities and one range after them."""
        s = self.entity.schema
        equal = {p.column: p for p in self.preds if p.op == "="}
        choices = [("base", s.partition), *[(k, s.secondary[k]) for k in SLOTS if k in s.secondary]]
        source = next(((n, keys) for n, keys in choices if all(c.name in equal for c in keys)), None)
        if source is None:
            raise QueryError(f"a query of {s.name} needs all columns of a partition or of a secondary key")
        bound = [equal[c.name] for c in source[1]]
        for c in s.sort:
            own = [p for p in self.preds if p.column == c.name and p not in bound]
            bound += own
            if not any(p.op == "=" for p in own):
                break
        return Plan(source[0], tuple(bound), tuple(p for p in self.preds if p not in bound))

    def key_preds(self) -> list[Pred]:
        """Predicates on the stored keys (pk or a secondary slot, and sk) that the plan's bound ones imply."""
        s, plan = self.entity.schema, self.plan()
        equal = {p.column: p.values[0] for p in plan.bound if p.op == "="}
        keys = s.partition if plan.source == "base" else s.secondary[plan.source]
        out = [Pred("pk" if plan.source == "base" else plan.source, "=", (f"{s.name}#{key_value(s, keys, [equal[c.name] for c in keys])}",))]
        prefix: list[str] = []
        for c in s.sort:
            own = [p for p in plan.bound if p.column == c.name]
            if c.name in equal:
                prefix.append(key_value(s, [c], [equal[c.name]]))
                continue
            if c.width and own:  # digits of fixed width compare as the numbers do
                low = max([p.values[0] + (p.op == ">") for p in own if p.op in (">", ">=", "BETWEEN")], default=None)
                high = min([p.values[-1] - (p.op == "<") for p in own if p.op in ("<", "<=", "BETWEEN")], default=None)
                if low is not None and low > 0:
                    out.append(Pred("sk", ">=", ("#".join([*prefix, key_value(s, [c], [low])]),)))
                if high is not None and high >= 0:
                    out.append(Pred("sk", "<", ("#".join([*prefix, key_value(s, [c], [high])]) + "$",)))  # the sign after #
            elif own and own[0].op == "BEGINS_WITH":
                out.append(Pred("sk", "BEGINS_WITH", ("#".join([*prefix, own[0].values[0]]),)))
                prefix = []
            break
        if prefix:
            whole = "#".join(prefix)
            out.append(Pred("sk", "=", (whole,)) if len(prefix) == len(s.sort) else Pred("sk", "BEGINS_WITH", (whole + "#",)))
        return out

    def df(self) -> DataFrame:
        """The rows in the order of the sort key. Where the data have the stored keys, their ranges reach the scan too."""
        plan, data = self.plan(), self.entity.data
        stored = [p for p in self.key_preds() if p.column in data.columns] if {"pk", "sk"} & set(data.columns) else []
        out = data.where(conjunction([*plan.bound, *plan.residual, *stored]))
        if order := [c.name for c in self.entity.schema.sort]:
            out = out.orderBy(*[F.col(c).desc() if self.descending else F.col(c) for c in order])
        return out if self.most is None else out.limit(self.most)

    def first(self) -> DataFrame:
        return self.limit(1).df()
