"""Writes as snapshots: each returns the new state of a table as a lazy DataFrame; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators.query import Table
from keyloom.plans.schema import VERSION, CompiledTable, SchemaError, version_digits


def empty_to_null(df: DataFrame, table: CompiledTable) -> DataFrame:
    """Empty strings of columns that are no keys become null."""
    keys = set(table.primary_key)
    names = [c for c in df.columns if c in table.columns and c not in keys and table.columns[c].spec.spark == "string"]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in names}) if names else df


def as_sets(df: DataFrame, table: CompiledTable) -> DataFrame:
    """Collections that are sets lose repetitions and order."""
    names = [c for c in df.columns if c in table.columns and table.columns[c].spec.is_collection and table.columns[c].kind == "set"]
    return df.withColumns({c: F.array_sort(F.array_distinct(c)) for c in names}) if names else df


def _now(column: str, now: int, force: bool) -> Column:
    kept = F.when(F.col(column) > 0, F.col(column)) if not force else F.lit(None)
    return F.coalesce(kept, F.lit(now)).cast("int")


def version_guard(df: DataFrame, digits: int) -> DataFrame:
    """df; a version that a slot of so many digits cannot hold raises."""
    over = F.col(VERSION) > F.lit(10**digits - 1)
    return df.withColumn(VERSION, F.when(over, F.raise_error(F.lit("the version does not fit into its slot")).cast("bigint")).otherwise(F.col(VERSION)))


def last_of(rows: DataFrame, keys: Sequence[str], order: str | Column | None = None) -> DataFrame:
    """One row for each key: the last one in the order given; without an order, rows that repeat a key must be equal.

    The aggregate runs before the exchange too, so a key that repeats very often reaches its task as a few rows.
    """
    names = [c for c in rows.columns if c not in keys]
    if not names:
        return rows.select(*keys).distinct()
    whole = F.struct(*names)
    if order is not None:
        last = rows.groupBy(*keys).agg(F.max_by(whole, order).alias("_row"))
    else:
        same = rows.withColumn("_hash", F.xxhash64(*names))
        last = same.groupBy(*keys).agg(F.max_by(whole, "_hash").alias("_row"), F.min("_hash").alias("_a"), F.max("_hash").alias("_b"))
        differ = F.raise_error(F.lit("a key is repeated by different rows of one write: an order is needed")).cast(last.schema["_row"].dataType)
        last = last.withColumn("_row", F.when(F.col("_a") == F.col("_b"), F.col("_row")).otherwise(differ))
    return last.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])


def stamp(df: DataFrame, table: CompiledTable, now: int, inserting: bool = True, versions: DataFrame | None = None, force_now: bool = False) -> DataFrame:
    """df with managed columns: created and updated unless they are set, and the version of this write by partition.

    versions (part, ver): the counter of each partition before this write; a table without one has a single counter. All
    rows of a write share the next one. A version that the slot of a delta layout cannot hold raises.
    """
    if table.schema.managed:
        for c in ("created", "updated") if inserting else ("updated",):
            df = df.withColumn(c, _now(c, now, force_now) if c in df.columns else F.lit(now).cast("int"))
    if VERSION in table.columns:
        kind, part = table.columns[VERSION].spec.spark, table.schema.partition
        df = df.drop(VERSION)
        if versions is None:
            df = df.withColumn(VERSION, F.lit(1).cast("bigint"))
        else:
            own = F.col("part") if part else F.lit(0)  # without a partition there is one counter, of all rows
            counters = versions.groupBy(own.alias("_part")).agg(F.greatest(F.max("ver"), F.lit(0)).alias("_ver"))
            df = df.withColumn("_own", F.col(part) if part else F.lit(0))
            df = df.join(counters, F.col("_own").eqNullSafe(F.col("_part")), "left").withColumn(VERSION, F.coalesce("_ver", F.lit(0)).cast("bigint") + 1).drop("_own", "_part", "_ver")
        if digits := version_digits(table):
            df = version_guard(df, digits)
        return df.withColumn(VERSION, F.col(VERSION).cast(kind))
    return df


def next_versions(written: DataFrame, table: CompiledTable, versions: DataFrame | None = None) -> DataFrame:
    """part, ver: the counters after a write of these rows."""
    part = F.col(table.schema.partition) if table.schema.partition else F.lit(0)
    new = written.groupBy(part.alias("part")).agg(F.max(VERSION).alias("ver"))
    return new if versions is None else versions.join(new, "part", "left_anti").unionByName(new)


#: Rows whose order values cut the rows of a sequence into ranges.
RANGES = 64


def autoincrement(df: DataFrame, column: str, partition: Sequence[str], order: Sequence[str], starts: DataFrame | None = None, random_digits: int = 0, seed: int = 0) -> DataFrame:
    """df with ids for the rows whose column is null or not above 0: contiguous in each partition, in the given order.

    starts (the partition's columns, current_value): the sequences so far; one that is not above 0 starts at 1. Rows are
    numbered within ranges of the first order column, cut at the values of RANGES rows, and the ranges' counts are added
    up, so that a partition of very many rows, or a table without one, is not numbered by one task.
    """
    unset = F.coalesce(F.col(column) <= 0, F.lit(True))
    first = order[0]
    cuts = sorted({r[0] for r in df.where(unset & F.col(first).isNotNull()).select(first).orderBy(F.xxhash64(first)).limit(RANGES).collect()})  # RANGES values
    kind = df.schema[first].dataType
    at = F.size(F.filter(F.array(*[F.lit(v).cast(kind) for v in cuts]), lambda v: v <= F.col(first))) if cuts else F.lit(0)
    spread = df.withColumns({"_unset": unset, "_range": F.coalesce(F.when(F.col(first).isNull(), F.lit(-1)).otherwise(at), F.lit(-1))})
    keys = [*partition, "_unset", "_range"]
    counts = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition, "_unset").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES ranges
    bases = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = spread.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & numbered[k].eqNullSafe(bases[f"_k{i}"])
    out = numbered.join(bases, on).withColumn("_start", F.lit(0).cast("bigint"))
    if starts is not None:
        known = starts.groupBy(*[F.col(p).alias(f"_s{i}") for i, p in enumerate(partition)], F.lit(0).alias("_one")).agg(F.greatest(F.max("current_value"), F.lit(0)).alias("_from"))
        on = F.col("_zero") == F.col("_one")
        for i, p in enumerate(partition):
            on = on & F.col(p).eqNullSafe(F.col(f"_s{i}"))
        out = out.withColumn("_zero", F.lit(0)).join(known, on, "left").withColumn("_start", F.coalesce("_from", F.lit(0)).cast("bigint"))
    sequence = F.col("_start") + F.col("_base") + F.col("_rank")
    if random_digits:
        sequence = sequence * F.lit(10**random_digits) + F.floor(F.rand(seed) * F.lit(10**random_digits)).cast("bigint")
    value = F.when(F.col("_unset"), sequence).otherwise(F.col(column)).cast(df.schema[column].dataType)
    return out.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])


def sequence_after(df: DataFrame, column: str, partition: Sequence[str]) -> DataFrame:
    """The partition's columns and current_value: sequences repaired to the greatest key."""
    return df.groupBy(*partition).agg(F.max(column).alias("current_value"))


def _keys_match(table: Table, keys: Sequence[str] | None) -> list[str]:
    return list(keys or table.compiled.primary_key)


def insert(table: Table, rows: DataFrame, exclude: Sequence[str] = (), parse: Callable[[DataFrame], DataFrame] | None = None, keys: Sequence[str] | None = None, order: str | Column | None = None) -> DataFrame:
    """The table with rows put in; one whose key is there replaces it, and of rows that repeat a key the last one counts,
    see last_of."""
    rows = last_of(rows.transform(parse) if parse else rows, _keys_match(table, keys), order)
    rows = as_sets(empty_to_null(rows, table.compiled), table.compiled).drop(*exclude)
    own = table.data
    return own.join(rows.select(*_keys_match(table, keys)), _keys_match(table, keys), "left_anti").select(*own.columns).unionByName(rows.select(*[c for c in rows.columns if c in own.columns]), allowMissingColumns=True)


def update(table: Table, rows: DataFrame, include: Sequence[str], strict: bool = False, parse: Callable[[DataFrame], DataFrame] | None = None, keys: Sequence[str] | None = None, order: str | Column | None = None) -> DataFrame:
    """The table with the listed columns of rows by key, and the managed ones that rows has; a new key is put in.

    Of rows that repeat a key the last one counts, see last_of. strict: refuse to change part of the columns of an index that combines several.
    """
    by = _keys_match(table, keys)
    if not include:
        raise SchemaError("an update names its columns")
    if set(include) & set(by):
        raise SchemaError(f"key columns {sorted(set(include) & set(by))} cannot be updated")
    if strict:
        for index in table.schema.indexes:
            names = {k.name for k in index.keys}
            if len(names) > 1 and names & set(include) and not names <= {*include, *by}:
                raise SchemaError(f"columns {sorted(names)} are indexed together and must be updated together")
    rows = last_of(rows.transform(parse) if parse else rows, by, order)
    rows = as_sets(empty_to_null(rows, table.compiled), table.compiled)
    managed = [c for c in ("updated", VERSION) if c in rows.columns and c in table.data.columns and c not in include]
    changed = [*include, *managed]
    new = rows.select(*by, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in changed])
    both = table.data.withColumn("_old", F.lit(True)).join(new, by, "full")
    return both.select(*[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in table.data.columns])


def update_exclude(table: Table, rows: DataFrame, exclude: Sequence[str], **options) -> DataFrame:
    """An update of all columns of rows but these and the keys."""
    by = set(_keys_match(table, options.get("keys")))
    return update(table, rows, [c for c in rows.columns if c in table.data.columns and c not in exclude and c not in by], **options)


def insert_update(table: Table, rows: DataFrame, is_insert: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), keys: Sequence[str] | None = None, order: str | Column | None = None) -> DataFrame:
    """Rows for which is_insert holds are put in, the others update: the columns to include, or all but those to exclude."""
    by = _keys_match(table, keys)
    chosen = list(include) or [c for c in rows.columns if c in table.data.columns and c not in by and c not in exclude]
    changed = update(table, rows.where(~F.coalesce(is_insert, F.lit(False))), chosen, keys=by, order=order)
    return insert(Table(table.schema, changed), rows.where(is_insert), keys=by, order=order)


def insert_or_update(table: Table, rows: DataFrame, is_insert: Column, exclude: Sequence[str] = (), keys: Sequence[str] | None = None, order: str | Column | None = None) -> DataFrame:
    return insert_update(table, rows, is_insert, exclude=exclude, keys=keys, order=order)


def merge(table: Table, rows: DataFrame, changed: Column, on_insert: Callable[[DataFrame], DataFrame], columns: Sequence[str] = (), keys: Sequence[str] | None = None, order: str | Column | None = None) -> DataFrame:
    """The table with rows merged by key: where `changed`, an expression over prev.* and cur.*, holds, the columns are
    updated; rows without a match, or with a key that is null or not above 0, pass through on_insert and are put in. Of
    rows that repeat a known key the last one counts, see last_of."""
    by = _keys_match(table, keys)
    last, data = by[-1], table.data
    known = F.coalesce(F.col(last) > 0, F.lit(False))
    rows = last_of(rows.where(known), by, order).unionByName(rows.where(~known))
    cur, prev = rows.where(known).alias("cur"), data.alias("prev")
    on = F.lit(True)
    for k in by:
        on = on & (F.col(f"cur.{k}") == F.col(f"prev.{k}"))
    chosen = list(columns) or [c for c in rows.columns if c in data.columns and c not in by]
    updated = prev.join(cur.withColumn("_in", F.lit(True)).alias("cur"), on, "left").select(
        *[F.when(F.col("cur._in") & F.coalesce(changed, F.lit(False)), F.col(f"cur.{c}")).otherwise(F.col(f"prev.{c}")).alias(c) if c in chosen else F.col(f"prev.{c}").alias(c) for c in data.columns]
    )
    fresh = rows.where(known).join(data.select(*by), by, "left_anti").unionByName(rows.where(~known))
    new = as_sets(empty_to_null(on_insert(fresh), table.compiled), table.compiled)
    return updated.unionByName(new.select(*[c for c in new.columns if c in data.columns]), allowMissingColumns=True)


def delete(table: Table, keys: DataFrame) -> DataFrame:
    return table.data.join(keys, list(keys.columns), "left_anti")


def preview(table: Table, df: DataFrame, options: Mapping[str, str] | None = None) -> str:
    """The plan of a write, as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), (options or {}).get("mode", "formatted"))
