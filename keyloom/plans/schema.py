"""Declared tables: columns, keys, access paths and closed value domains, checked when a table is compiled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import types as T

from keyloom.functions.encode import basic_hash
from keyloom.functions.types import INTEGERS, TypeSpec, type_of


class SchemaError(ValueError):
    """A declaration that breaks a rule."""


def _need(ok: bool, table: str, what: str) -> None:
    if not ok:
        raise SchemaError(f"table {table}: {what}")


@dataclass(frozen=True)
class Col:
    """A column; the modifiers return changed copies."""

    name: str
    type: str = "bigint"
    digits: int = 0
    as_int32: bool = False
    buckets: tuple[int, ...] = ()
    is_week: bool = False
    auto: int | None = None
    width: int = 0
    kind: str = "set"

    def decimal_size(self, n: int) -> Col:
        return replace(self, digits=n)

    def int32(self) -> Col:
        return replace(self, as_int32=True)

    def bucketing(self, *sizes: int) -> Col:
        return replace(self, buckets=tuple(sizes))

    def week(self) -> Col:
        return replace(self, is_week=True)

    def autoincrement(self, random_digits: int = 0) -> Col:
        return replace(self, auto=random_digits)

    def base(self, width: int) -> Col:
        return replace(self, width=width)

    def as_list(self) -> Col:
        return replace(self, kind="list")

    @property
    def spec(self) -> TypeSpec:
        return type_of(self.type)

    @property
    def is_int(self) -> bool:
        return self.spec.spark in INTEGERS


@dataclass(frozen=True)
class FixedValues:
    """A closed domain of an integer column: a list, or a range."""

    column: str
    values: tuple[int, ...] = ()
    min: int = 0
    max: int = 0

    @property
    def bounds(self) -> tuple[int, int] | None:
        if self.values:
            return min(self.values), max(self.values)
        return (self.min, self.max) if self.max else None

    def enumerated(self, most: int = 1 << 20) -> tuple[int, ...]:
        if self.values:
            return tuple(sorted(set(self.values)))
        return tuple(range(self.min, self.max + 1)) if self.bounds and self.max - self.min < most else ()


@dataclass(frozen=True)
class Index:
    """An access path. kind: local, global, view, view_table or delta; group: rows grouped by a hash of the keys."""

    keys: tuple[Col, ...] = ()
    kind: str = "local"
    cols: tuple[str, ...] = ()
    partition: str | None = None
    group: bool = False
    inherit: bool = False


@dataclass(frozen=True)
class GenericRecord:
    """Which columns the flat form of a record takes."""

    name: str
    s1: str | None = None
    s2: str | None = None
    n1: str | None = None
    n2: str | None = None


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Col, ...]
    keys: tuple[str, ...]
    partition: str | None = None
    table_id: int = 0
    indexes: tuple[Index, ...] = ()
    fixed: tuple[FixedValues, ...] = ()
    int_packing: tuple[Col, ...] = ()
    concat: tuple[str, ...] = ()
    save_version: bool = False
    managed: bool = True
    text: tuple[str, ...] = ()
    status: str | None = "status"
    generic: GenericRecord | None = None
    sequence_partition: str | None = None


@dataclass(frozen=True)
class Source:
    """Something rows can be read from: the base table or a layout."""

    kind: str  # base, local, global, packed_local, packed_global, view, packed, hash, exploded, group
    name: str
    keys: tuple[str, ...]
    partition: str | None
    slots: tuple[int, ...] = ()
    payload: tuple[str, ...] = ()
    int32: bool = False
    exploded: str | None = None

    @property
    def packed_column(self) -> str:
        return f"zz_{self.name}"


# Digits that a delta's version gets, and the most digits of a packed key.
VERSION_INT32, VERSION_ELASTIC, VERSION_INT64, MOST_DIGITS = 8, 9, 10, 18
MANAGED, VERSION = ("created", "updated"), "updated_version"


def digits_of(n: int) -> int:
    return len(str(n))


def delta_slots(table: str, keys: Sequence[Col], fixed: dict[str, FixedValues]) -> tuple[tuple[int, ...], bool]:
    """Slots of a delta layout, its version last, and whether a packed value fits into 32 bits.

    A key's width is its declared digits, else those of its domain; one key may have neither and takes what is left.
    """
    widths, most, elastic = [], [], None
    for k, c in enumerate(keys):
        _need(c.is_int, table, f"delta key {c.name} is no integer")
        bounds = fixed[c.name].bounds if c.name in fixed else None
        if c.digits or bounds:
            widths.append(c.digits or digits_of(bounds[1]))
            most.append(bounds[1] if bounds else 10 ** c.digits - 1)
        else:
            _need(elastic is None, table, "a delta may have one key without a domain or digits")
            elastic = k
            widths.append(0)
            most.append(0)
    forced = any(c.as_int32 for c in keys)
    if elastic is not None:
        _need(not forced, table, "a delta with an open key does not fit into 32 bits")
        widths[elastic] = MOST_DIGITS - VERSION_ELASTIC - sum(widths)
        _need(widths[elastic] >= 1, table, "a delta leaves no digits for its open key")
        return (*widths, VERSION_ELASTIC), False
    value = 0
    for w, m in zip((*widths, VERSION_INT32), (*most, 10**VERSION_INT32 - 1), strict=True):
        value = value * 10**w + m
    if sum(widths) + VERSION_INT32 <= MOST_DIGITS and value < 1 << 31:
        return (*widths, VERSION_INT32), True
    _need(not forced, table, "a delta's domains do not fit into 32 bits")
    _need(sum(widths) + VERSION_INT64 <= MOST_DIGITS, table, f"a delta needs {sum(widths) + VERSION_INT64} digits, over {MOST_DIGITS}")
    return (*widths, VERSION_INT64), False


class CompiledTable:
    """A checked schema with its sources."""

    def __init__(self, schema: TableSchema):
        self.schema, name = schema, schema.name
        self.columns: dict[str, Col] = {}
        for c in schema.columns:
            _need(c.name not in self.columns, name, f"column {c.name} is declared twice")
            self.columns[c.name] = c
        self.declared = tuple(self.columns)
        if schema.managed:
            for m in MANAGED:
                self.columns.setdefault(m, Col(m, "int"))
                _need(self.columns[m].is_int, name, f"managed column {m} must be an integer")
        _need(bool(schema.keys), name, "a key is needed")
        for c in (*schema.keys, *([schema.partition] if schema.partition else [])):
            _need(c in self.columns, name, f"key column {c} is not declared")
        _need(len(set(schema.keys)) == len(schema.keys), name, "a key column is repeated")
        self.fixed = self._fixed()
        autos = [c for c in self.columns.values() if c.auto is not None]
        _need(len(autos) <= 1, name, "one autoincrement column at most")
        self.auto = autos[0] if autos else None
        self.sources = [Source("base", name, schema.keys, schema.partition)]
        self.groups: list[Index] = []
        self.bucketed: list[Index] = []
        self._packing()
        self._uses_version = schema.save_version or any(i.kind == "delta" for i in schema.indexes)
        if self._uses_version:
            _need(VERSION in self.columns and self.columns[VERSION].is_int, name, "updated_version must be declared, as an integer")
        for k, index in enumerate(schema.indexes):
            self._index(k, index)
        self._records()

    def _fixed(self) -> dict[str, FixedValues]:
        out: dict[str, FixedValues] = {}
        for f in self.schema.fixed:
            name = self.schema.name
            _need(f.column in self.columns, name, f"domain of an unknown column {f.column}")
            _need(f.column not in out, name, f"domain of {f.column} is declared twice")
            _need(f.bounds is not None, name, f"domain of {f.column} needs values or a maximum")
            _need(f.bounds[0] >= 0, name, f"domain of {f.column} must not be negative")
            _need(f.bounds[1] >= f.bounds[0], name, f"domain of {f.column} ends before it begins")
            out[f.column] = f
        return out

    def _packing(self) -> None:
        s = self.schema
        if s.int_packing:
            _need(len(s.keys) == 1 and self.columns[s.keys[0]].type == "bigint", s.name, "integer packing needs one bigint key")
            for k, c in enumerate(s.int_packing):
                _need(c.is_int, s.name, f"packed column {c.name} is no integer")
                _need(c.digits > 0 or k == len(s.int_packing) - 1, s.name, f"packed column {c.name} needs digits")
            _need(sum(c.digits for c in s.int_packing) <= MOST_DIGITS, s.name, "a packed key has too many digits")
        if s.concat:
            _need(len(s.keys) == 1 and self.columns[s.keys[0]].spec.spark == "string", s.name, "concatenation needs one string key")
            _need(all(c in self.columns for c in s.concat), s.name, "concatenation of an unknown column")

    @property
    def key_slots(self) -> tuple[int, ...]:
        own = [c.digits for c in self.schema.int_packing]
        return (*own[:-1], own[-1] or MOST_DIGITS - sum(own[:-1])) if own else ()

    def _index(self, number: int, index: Index) -> None:
        s, name = self.schema, self.schema.name
        keys = tuple(k.name for k in index.keys)
        _need(bool(keys) or index.kind == "delta", name, "an index needs keys")
        _need(not index.inherit or index.group, name, "a group is needed to inherit from the key")
        _need(index.partition is None or index.kind in ("view", "delta"), name, "only views and deltas take another partition")
        _need(all(k in self.columns for k in (*keys, *index.cols)), name, f"index {keys} names an unknown column")
        _need(index.partition is None or index.partition in self.columns, name, "the partition of an index is unknown")
        title, part = f"{index.kind}_{'_'.join(keys) or VERSION}_{number}", index.partition or s.partition
        collections = [k for k in keys if self.columns[k].spec.is_collection]
        bucketed = [k for k in index.keys if k.buckets]
        if bucketed:
            _need(2 <= len(keys) <= 3, name, "bucketing takes two or three columns")
            _need(len(bucketed) == 1 and bucketed[0].name not in collections, name, "bucketing takes one bucketed scalar")
            _need(all(self.columns[k].spec.is_integer for k in keys), name, "bucketing takes integers")
            _need(all(b > 0 for b in bucketed[0].buckets), name, "bucket sizes must be positive")
            self.bucketed.append(index)
        elif index.group:
            _need(all(self.columns[k].spec.is_integer for k in keys), name, "groups take integers")
            if index.inherit:
                packed = tuple(c.name for c in s.int_packing)
                _need(packed[: len(keys)] == keys, name, "an inherited group must lead the packed key")
            self.groups.append(index)
            self.sources.append(Source("group", title, keys, part))
        elif index.kind == "delta":
            _need(VERSION in self.columns, name, "a delta needs updated_version")
            _need(len(set(keys)) == len(keys) and VERSION not in keys, name, "a delta's keys are wrong")
            slots, fits = delta_slots(name, index.keys, self.fixed)
            kind = "packed" if keys else "view"
            self.sources.append(Source(kind, title, (*keys, VERSION), part, slots if keys else (), self._payload(index), fits))
        elif index.kind == "view_table":
            _need(len(collections) <= 1, name, "a view table takes one collection at most")
            self.sources.append(Source("exploded", title, keys, s.partition, payload=self._payload(index), exploded=collections[0] if collections else None))
        elif index.kind == "view":
            _need(not collections, name, "a view's keys are scalars; use a view table")
            hinted = any(k.digits or k.as_int32 for k in index.keys)
            if len(keys) == 1:
                self.sources.append(Source("view", title, keys, part, payload=self._payload(index)))
            elif hinted:
                self.sources.append(Source("packed", title, keys, part, self._slots(index), self._payload(index), any(k.as_int32 for k in index.keys)))
            else:
                self.sources.append(Source("hash", title, keys, part, payload=self._payload(index)))
        elif index.kind in ("local", "global"):
            if len(keys) > 1 or any(k.digits or k.as_int32 for k in index.keys):
                _need(all(self.columns[k].is_int for k in keys), name, "packed indexes take integers")
                self.sources.append(Source(f"packed_{index.kind}", title, keys, s.partition if index.kind == "local" else None, self._slots(index), int32=any(k.as_int32 for k in index.keys)))
            else:
                self.sources.append(Source(index.kind, title, keys, s.partition if index.kind == "local" else None))
        else:
            raise SchemaError(f"table {name}: unknown kind of index {index.kind}")

    def _slots(self, index: Index) -> tuple[int, ...]:
        name, budget = self.schema.name, 9 if any(k.as_int32 for k in index.keys) else MOST_DIGITS
        _need(all(self.columns[k.name].is_int for k in index.keys), name, "packed keys are integers")
        _need(all(k.digits > 0 for k in index.keys[1:]), name, "packed keys after the first need digits")
        rest = sum(k.digits for k in index.keys[1:])
        first = index.keys[0].digits or budget + 1 * (budget == 9) - rest
        _need(first >= 1 and first + rest <= budget + 1 * (budget == 9), name, "packed keys have too many digits")
        return (first, *[k.digits for k in index.keys[1:]])

    def _payload(self, index: Index) -> tuple[str, ...]:
        base = index.cols or tuple(c for c in self.columns)
        own = (*([self.schema.partition] if self.schema.partition else []), *self.schema.keys, *[k.name for k in index.keys])
        return tuple(dict.fromkeys((*own, *base)))

    def _records(self) -> None:
        s, name = self.schema, self.schema.name
        if s.save_version:
            _need(1 <= s.table_id <= 16383, name, "a table id from 1 to 16383 is needed")
            _need(bool(s.partition) and self.columns[s.partition].is_int, name, "an integer partition is needed")
            _need(len(s.keys) == 1 and self.columns[s.keys[0]].is_int, name, "one integer key is needed")
        if s.generic:
            g = s.generic
            _need(s.save_version, name, "generic records need saved versions")
            for column, text in ((g.name, True), (g.s1, True), (g.s2, True), (g.n1, False), (g.n2, False)):
                if column:
                    _need(column in self.columns, name, f"generic column {column} is unknown")
                    c = self.columns[column]
                    _need(c.spec.spark == "string" if text else c.is_int, name, f"generic column {column} has the wrong type")
        if s.text:
            _need(bool(s.partition) and len(s.keys) == 1 and self.columns[s.keys[0]].is_int, name, "text search needs a partition and one integer key")
            _need(all(c in self.columns and self.columns[c].spec.spark == "string" for c in s.text), name, "text columns are strings")

    @cached_property
    def primary_key(self) -> tuple[str, ...]:
        return (*([self.schema.partition] if self.schema.partition else []), *self.schema.keys)

    def struct(self) -> T.StructType:
        fields = []
        for c in self.columns.values():
            kind = T._parse_datatype_string(c.spec.spark)
            fields.append(T.StructField(c.name, kind, True, {"type_id": c.spec.id, **({"collection": c.kind} if c.spec.is_collection else {})}))
        return T.StructType(fields)

    @cached_property
    def group_ids(self) -> dict[tuple[str, ...], int]:
        """A number of 16 bits for each group of columns: the hash of its name, or the next that is free and not 0."""
        taken: dict[int, str] = {}
        out = {}
        for g in self.groups:
            keys = tuple(k.name for k in g.keys)
            name = "_".join(keys)
            n = basic_hash(name) & 0xFFFF or 1
            while taken.get(n, name) != name:
                n = n % 0xFFFF + 1
            taken[n] = name
            out[keys] = n - (1 << 16) if n >= 1 << 15 else n
        return out

    @property
    def visible(self) -> tuple[str, ...]:
        """The columns of a default projection: declared ones."""
        return self.declared


_COMPILED: dict[TableSchema, CompiledTable] = {}


def compile_table(schema: TableSchema) -> CompiledTable:
    if schema not in _COMPILED:
        _COMPILED[schema] = CompiledTable(schema)
    return _COMPILED[schema]


def version_digits(table: CompiledTable) -> int:
    """The fewest digits that a packed layout of the table has for versions; 0 if none holds them."""
    return min((s.slots[-1] for s in table.sources if s.slots and s.keys[-1] == VERSION), default=0)


class Registry:
    """Tables by name; table ids are unique."""

    def __init__(self) -> None:
        self._tables: dict[str, TableSchema] = {}

    def register(self, schema: TableSchema) -> None:
        for other in self._tables.values():
            if other.name != schema.name and schema.table_id and other.table_id == schema.table_id:
                raise SchemaError(f"table id {schema.table_id} is that of {other.name}")
        compile_table(schema)
        self._tables[schema.name] = schema

    def resolve(self, name: str) -> TableSchema:
        if name not in self._tables:
            raise KeyError(f"no table {name}; there are {self.names()}")
        return self._tables[name]

    def names(self) -> list[str]:
        return sorted(self._tables)


__all__ = ["Col", "CompiledTable", "FixedValues", "GenericRecord", "Index", "Registry", "SchemaError", "Source", "TableSchema", "compile_table", "delta_slots", "version_digits"]
