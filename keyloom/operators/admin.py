"""Descriptions of tables, records as JSON, repairs of derived columns and sequences, and changes of schema."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators import write
from keyloom.operators.groups import group_freshness
from keyloom.operators.query import Query, Table
from keyloom.plans.planner import capabilities
from keyloom.plans.predicates import QueryError, coerce, resolve
from keyloom.plans.schema import CompiledTable, Registry


def describe(table: CompiledTable) -> dict:
    """Columns by name, keys and the shapes of queries that some source serves."""
    shapes = sorted({" ".join(f"{k}{op}" for k, op in c.signature) for c in capabilities(table)})
    columns = [{"name": c.name, "type": c.spec.name, "id": c.spec.id, **({"domain": list(table.fixed[c.name].bounds)} if c.name in table.fixed else {})} for c in sorted(table.columns.values(), key=lambda c: c.name)]
    return {"table": table.schema.name, "partition": table.schema.partition, "keys": list(table.schema.keys), "columns": columns, "queries": shapes, "sources": [f"{s.kind}:{s.name}" for s in table.sources]}


def query_json(table: Table, spec: dict) -> Query:
    """A query given as a dict: filters, select, exclude, limit, desc."""
    q = table.query().where_spec(spec.get("filters") or [])
    if spec.get("select"):
        q = q.select(*spec["select"])
    if spec.get("exclude"):
        q = q.exclude(*spec["exclude"])
    if spec.get("desc"):
        q = q.order_desc()
    return q.limit(int(spec["limit"])) if spec.get("limit") else q


def parse_records(table: Table, text: str) -> DataFrame:
    """Rows of a JSON array of objects; their values are checked against the columns' types. An empty array is an error."""
    records = json.loads(text)
    if not isinstance(records, list) or not records:
        raise QueryError("a non-empty array of records is needed")
    t, rows, names = table.compiled, [], []
    for r in records:
        row = {}
        for k, v in r.items():
            c = resolve(t, k)
            spec = t.columns[c].spec
            row[c] = None if v is None else [coerce(x, spec) for x in v] if spec.is_collection else coerce(v, spec)
            if c not in names:
                names.append(c)
        rows.append(row)
    schema = ", ".join(f"`{c}` {t.columns[c].spec.spark}" for c in names)
    return table.data.sparkSession.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def insert_json(table: Table, text: str, now: int, versions: DataFrame | None = None) -> DataFrame:
    rows = write.stamp(parse_records(table, text), table.compiled, now, versions=versions)
    return write.insert(table, rows.select(*[c for c in rows.columns if c in table.data.columns]))


def update_json(table: Table, text: str, columns: Sequence[str], now: int, versions: DataFrame | None = None) -> DataFrame:
    if not columns:
        raise QueryError("an update names its columns")
    rows = write.stamp(parse_records(table, text), table.compiled, now, inserting=False, versions=versions)
    return write.update(table, rows, [resolve(table.compiled, c) for c in columns])


def recalc_derived(table: Table, derived: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table with derived columns computed anew, and the rows in which one of them changed."""
    fresh = table.data.withColumns({f"_new_{c}": e for c, e in derived.items()})
    different = F.lit(False)
    for c in derived:
        different = different | (~F.col(f"_new_{c}").eqNullSafe(F.col(c)) if c in table.data.columns else F.lit(True))
    names = [*table.data.columns, *[c for c in derived if c not in table.data.columns]]
    renewed = [F.col(f"_new_{c}").alias(c) if c in derived else F.col(c) for c in names]
    return fresh.select(*renewed), fresh.where(different).select(*renewed)


def recalc_groups(table: Table, partition: Any, freshness: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The freshness table with a partition's groups computed anew."""
    own = Table(table.schema, table.data.where(F.col(table.schema.partition) == F.lit(partition)))
    kept = freshness.where(F.col("part") != F.lit(partition))
    return kept.unionByName(group_freshness(own.data, own.compiled, columns).select(*freshness.columns))


def reset_counter(table: Table) -> DataFrame:
    """current_value of each partition's sequence: its greatest key."""
    part = [table.schema.partition] if table.schema.partition else []
    return write.sequence_after(table.data, table.schema.keys[0], part)


def sequence_value(sequences: DataFrame, name: str) -> int:
    """The value of a sequence (name, current_value); 0 if there is none."""
    found = sequences.where(F.col("name") == F.lit(name)).select("current_value").head()
    return int(found[0]) if found else 0


def reload(table: Table, now: int) -> DataFrame:
    """All rows written again: derived values and managed columns as of now."""
    return write.insert(table, write.stamp(table.data, table.compiled, now).select(*table.data.columns))


def schema_diff(table: CompiledTable, data: DataFrame, layouts: Sequence[str] = ()) -> dict[str, list[str]]:
    """What is to be added to stored data, and what cannot be: nothing is ever dropped."""
    stored = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    wanted = {c.name: c.spec.spark for c in table.columns.values()}
    return {
        "add_columns": [c for c in wanted if c not in stored],
        "type_mismatch": [f"{c}: {stored[c]} is not {t}" for c, t in wanted.items() if c in stored and stored[c] != t],
        "unmapped": [c for c in stored if c not in wanted],
        "add_layouts": [s.name for s in table.sources if s.kind not in ("base", "local", "global", "group") and s.name not in layouts],
    }


def deploy(table: CompiledTable, data: DataFrame) -> DataFrame:
    """Stored data with the missing columns added, as nulls."""
    return data.withColumns({c: F.lit(None).cast(table.columns[c].spec.spark) for c in schema_diff(table, data)["add_columns"]})


def describe_all(registry: Registry) -> dict[str, dict]:
    from keyloom.plans.schema import compile_table

    return {n: describe(compile_table(registry.resolve(n))) for n in registry.names()}
