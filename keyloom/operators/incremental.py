"""Incremental reads: rows changed since a version, and records by id whose slot has changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.encode import slot_of, stored_version
from keyloom.operators.query import Table
from keyloom.operators.write import version_guard
from keyloom.plans.predicates import Pred, QueryError
from keyloom.plans.schema import VERSION, CompiledTable, SchemaError

#: Claims up to this number are broadcast; more are joined by exchange.
BROADCAST_CLAIMS = 100_000


def delta_column(table: CompiledTable, preds: Sequence[Pred]) -> str:
    """The column that a delta's values are of: the one key that is not pinned of the delta index with most pinned keys."""
    pinned = {p.column for p in preds if p.op in ("=", "IN")}
    found: dict[int, set[str]] = {}
    for index in table.schema.indexes:
        if index.kind == "delta":
            left = [k.name for k in index.keys if k.name not in pinned]
            if len(left) == 1:
                found.setdefault(len(index.keys) - 1, set()).add(left[0])
    if not found:
        raise QueryError(f"no delta of {table.schema.name} has exactly one key that is not pinned")
    best = found[max(found)]
    if len(best) > 1:
        raise QueryError(f"deltas of {table.schema.name} leave {sorted(best)}: pin one of them")
    return best.pop()


def slot_versions(written: DataFrame, partition: str, key: str, version: str = VERSION, known: DataFrame | None = None) -> DataFrame:
    """part, slot, ver: the greatest version written to each of 256 slots of ids, in 16 bits; known: slots so far."""
    new = written.groupBy(F.col(partition).alias("part"), slot_of(F.col(key)).alias("slot")).agg(F.max(version).alias("v")).select("part", "slot", stored_version(F.col("v")).alias("ver"))
    if known is None:
        return new
    return known.join(new, ["part", "slot"], "left_anti").select("part", "slot", "ver").unionByName(new)


def ids_to_fetch(claims: DataFrame, slots: DataFrame, order: str | None = None) -> DataFrame:
    """part, id, ver: the claims (part, id, ver) that are unknown or out of date.

    Of claims that repeat an id the last in the order column counts; without one, the least version claimed, which never
    takes an old record for a fresh one.
    """
    version = F.coalesce("ver", F.lit(0))
    last = claims.groupBy("part", "id").agg((F.max_by(version, order) if order else F.min(version)).alias("ver"))
    both = last.withColumn("slot", slot_of(F.col("id"))).join(slots.select("part", "slot", F.col("ver").alias("server")), ["part", "slot"], "left")
    server = F.coalesce("server", F.lit(0))
    return both.where((server == 0) | (F.coalesce("ver", F.lit(0)) != server)).select("part", "id", server.cast("int").alias("ver"))


def cached_ids(table: Table, claims: DataFrame, slots: DataFrame, columns: Sequence[str] = (), order: str | None = None, sort: bool = False) -> DataFrame:
    """The rows of the claims that are out of date, with their slot's version as updated_version; sort: by partition and id."""
    s = table.schema
    if not s.save_version:
        raise SchemaError(f"table {s.name} saves no versions")
    fetch = ids_to_fetch(claims, slots, order)
    small = claims.limit(BROADCAST_CLAIMS + 1).count() <= BROADCAST_CLAIMS  # counted by the executors
    fetch = fetch.withColumnsRenamed({"part": "_p", "id": "_k", "ver": "_v"})
    key, part = s.keys[0], s.partition
    data = table.data
    joined = data.join(F.broadcast(fetch) if small else fetch, (data[part] == fetch["_p"]) & (data[key] == fetch["_k"]))
    wanted = list(columns) or [c for c in table.compiled.visible if c != VERSION and c in data.columns]
    joined = joined.orderBy("_p", "_k") if sort else joined
    return joined.select(*[data[c] for c in wanted], F.col("_v").alias(VERSION))


def generic_records(table: Table, rows: DataFrame | None = None) -> DataFrame:
    """The flat form of a table's rows: ID, nm, s1, s2, n1, n2 and status, those that are declared."""
    g, df = table.schema.generic, table.data if rows is None else rows
    if g is None:
        raise SchemaError(f"table {table.schema.name} has no generic record")
    parts = [(table.schema.keys[0], "ID"), (g.name, "nm"), (g.s1, "s1"), (g.s2, "s2"), (g.n1, "n1"), (g.n2, "n2")]
    if table.schema.status and table.schema.status in table.compiled.columns:
        parts.append((table.schema.status, "status"))
    extra = [F.col(VERSION)] if rows is not None and VERSION in df.columns else []
    return df.select(*[F.col(c).alias(a) for c, a in parts if c], *extra)


def cached_generic(table: Table, claims: DataFrame, slots: DataFrame, order: str | None = None) -> DataFrame:
    return generic_records(table, cached_ids(table, claims, slots, order=order))


__all__ = ["cached_generic", "cached_ids", "delta_column", "generic_records", "ids_to_fetch", "slot_versions", "version_guard"]
