"""Grouped reads: rows in groups by a hash of some columns, with a counter that says whether a group has changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.encode import hash_tuple
from keyloom.operators.query import Query, Table
from keyloom.plans.planner import group_hashes, key_bounds, plan_group
from keyloom.plans.predicates import QueryError, conjunction
from keyloom.plans.schema import VERSION, CompiledTable


def with_hashes(df: DataFrame, table: CompiledTable, columns: Sequence[str], out: str = "ig") -> DataFrame:
    """df with one row per combination of the columns' values and its hash; a row with an empty collection has none."""
    for c in columns:
        if table.columns[c].spec.is_collection:
            df = df.withColumn(f"_{c}", F.explode(F.array_distinct(c)))
        else:
            df = df.withColumn(f"_{c}", F.col(c))
    df = df.where(conjunction_not_null([F.col(f"_{c}") for c in columns]))
    return df.withColumn(out, hash_tuple([F.col(f"_{c}") for c in columns]))


def conjunction_not_null(columns: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def hash_set(df: DataFrame, table: CompiledTable, columns: Sequence[str], out: str) -> DataFrame:
    """df with the sorted distinct hashes of each row, as a stored column; 0 or none where a column is empty."""
    items = F.array(F.array().cast("array<bigint>"))
    for c in columns:
        values = F.array_distinct(F.col(c)) if table.columns[c].spec.is_collection else F.array(F.col(c))
        values = F.filter(F.coalesce(values, F.array().cast(f"array<{table.columns[c].spec.element}>")), lambda v: v.isNotNull())
        items = _crossed(items, values)
    hashes = F.transform(items, lambda p: hash_tuple([F.element_at(p, k + 1) for k in range(len(columns))]))
    if any(table.columns[c].spec.is_collection for c in columns):
        return df.withColumn(out, F.array_sort(F.array_distinct(hashes)))
    return df.withColumn(out, F.coalesce(F.get(hashes, 0), F.lit(0)))


def _crossed(items: Column, values: Column) -> Column:
    return F.flatten(F.transform(items, lambda p: F.transform(values, lambda v: F.concat(p, F.array(v.cast("bigint"))))))


def group_freshness(written: DataFrame, table: CompiledTable, columns: Sequence[str], version: str = VERSION, known: DataFrame | None = None) -> DataFrame:
    """part, the group's values, id (its hash) and upc: the greatest version written to each group. known: so far."""
    rows = with_hashes(written, table, columns, "id")
    part = table.schema.partition
    new = rows.groupBy(F.col(part).alias("part"), "id", *[F.col(f"_{c}").alias(f"v_{c}") for c in columns]).agg(F.max(version).alias("upc"))
    if known is None:
        return new
    return known.unionByName(new).groupBy("part", "id", *[f"v_{c}" for c in columns]).agg(F.max("upc").alias("upc"))


def query_group(query: Query, freshness: DataFrame, cached: Mapping[int, int] | None = None) -> DataFrame:
    """id, values, upc and records of the groups that the query's predicates name, in the order of their hash.

    A group that the freshness table does not know is left out; one whose counter the caller has gets empty records. The
    records are those of the group that fulfil every predicate, so equal hashes of different values do no harm. Predicates
    on columns that lead a packed key, as of a group that inherits from it, range over the key too.
    """
    if query.selected or query.excluded or query.groups or query.descending or query.most is not None:
        raise QueryError("a grouped read takes neither selection, grouping, order nor limit")
    t: Table = query.table
    index = plan_group(t.compiled, query.preds)
    names = [k.name for k in index.keys]
    spark = t.data.sparkSession
    wanted = group_hashes(names, query.preds)
    part_value = next(p.values[0] for p in query.preds if p.column == t.schema.partition)
    asked = spark.createDataFrame([(h, list(v), (cached or {}).get(h)) for h, v in wanted.items()], "id int, values array<bigint>, claimed bigint")
    known = freshness.where(F.col("part") == F.lit(part_value)).groupBy("id").agg(F.max("upc").alias("upc"))
    split = known.join(F.broadcast(asked), "id").withColumn("fresh", F.coalesce(F.col("claimed") == F.col("upc"), F.lit(False)))  # the combinations of one query
    rows = with_hashes(t.data.where(conjunction([*query.preds, *key_bounds(t.compiled, query.preds)])), t.compiled, names, "_group")
    own = [c for c in t.compiled.visible if c in t.data.columns]
    wanted_groups = F.broadcast(split.where("NOT fresh").select(F.col("id").alias("_group")))
    changed = rows.join(wanted_groups, "_group", "left_semi").dropDuplicates(["_group", *[c for c in t.compiled.primary_key if c in rows.columns]])
    records = changed.groupBy(F.col("_group").alias("id")).agg(F.collect_list(F.struct(*own)).alias("records"))
    empty = F.array().cast(records.schema["records"].dataType)
    return split.join(records, "id", "left").select("id", "values", "upc", F.coalesce("records", empty).alias("records")).orderBy("id")
