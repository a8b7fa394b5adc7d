"""Derived copies of a table: sorted by other keys, under another partition, with packed or hashed keys, or exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.encode import hash_tuple, hash_values, pack
from keyloom.operators.groups import with_hashes
from keyloom.operators.query import Table
from keyloom.plans.planner import plan_buckets
from keyloom.plans.schema import CompiledTable, Index, SchemaError, Source

DERIVED = ("view", "packed", "hash", "exploded", "local", "global", "packed_local", "packed_global", "group")
#: Bytes that a table reads that make a file of a layout, and its fewest files.
FILE_BYTES, FEWEST = 256 << 20, 4
#: Sizes of a Bloom filter that are tried, each half of the last, from 1 MB on.
BLOOM_SIZES = 12


def layout(table: Table, source: Source) -> DataFrame:
    """The rows of a layout, not sorted yet. Rows with a null key are in no view; an empty collection gives no rows."""
    t, df = table.compiled, table.data
    keys = [k for k in source.keys if k in df.columns]
    df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)) if keys else df
    if source.exploded:
        df = df.withColumn(source.exploded, F.explode(F.array_distinct(source.exploded)))
    names = [c for c in (source.payload or t.columns) if c in df.columns]
    if source.kind == "group":
        return with_hashes(df, t, source.keys, source.packed_column).select(*names, source.packed_column)
    if source.slots:
        packed = pack([F.col(k) for k in source.keys], source.slots)
        return df.select(*names, packed.alias(source.packed_column))
    if source.kind == "hash":
        return df.select(*names, hash_values([(F.col(k), t.columns[k].spec.spark) for k in source.keys]).alias(source.packed_column))
    return df.select(*names)


def write_layout(table: Table, source: Source, root: str, files: int | None = None) -> DataFrame:
    """The layout as files: ranges of (partition, key), sorted, so that a query skips files and row groups by their bounds.

    The number of files follows the size of what the table reads; a partition value with very many rows is cut by its keys.
    Equalities on a hash, or on a key, also meet a Bloom filter of each row group, as large as its distinct values ask for.
    """
    spark, path = table.data.sparkSession, f"{root}/{source.name}"
    df = layout(table, source)
    key = source.packed_column if source.slots or source.kind in ("hash", "group") else None
    order = [*([source.partition] if source.partition else []), *([key] if key else [k for k in source.keys if k in df.columns])]
    size = bytes_read(table.data)
    n = files or (None if size is None else min(100_000, max(FEWEST, -(-size // FILE_BYTES))))
    ranges = df.repartitionByRange(*order) if n is None else df.repartitionByRange(n, *order)
    bloom = {f"parquet.bloom.filter.enabled#{order[-1]}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number": BLOOM_SIZES}
    ranges.sortWithinPartitions(*order).write.mode("overwrite").options(**bloom).parquet(path)
    return spark.read.parquet(path)


def bytes_read(df: DataFrame) -> int | None:
    """The bytes of all that a DataFrame reads; None where Spark does not know them. Spark's own figure for a join is the
    product of its sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    unknown = int(df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes())
    return None if any(x >= unknown for x in sizes) else sum(sizes)


def build_layouts(table: Table, root: str, names: Sequence[str] = ()) -> Table:
    """The table with all its layouts written, or those named."""
    columns = table.compiled.columns
    plain = lambda s: s.kind in DERIVED and not (s.kind in ("local", "global") and columns[s.keys[0]].spec.is_collection)
    made = {s.name: write_layout(table, s, root) for s in table.compiled.sources if plain(s) and (not names or s.name in names)}
    return table.with_layouts(made)


def drop_layouts(table: Table, root: str) -> Table:
    spark: SparkSession = table.data.sparkSession
    for name in table.layouts:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return Table(table.schema, table.data)


def sync_exploded(old: DataFrame, source: Source, changed: Table) -> DataFrame:
    """An exploded layout after a write: rows of the written keys go, their present ones come in."""
    keys = list(changed.compiled.primary_key)
    gone = changed.data.select(*keys).distinct()
    return old.join(gone, keys, "left_anti").select(*old.columns).unionByName(layout(changed, source).select(*old.columns))


def bucket_hashes(df: DataFrame, table: CompiledTable, index: Index, out: str = "zz_buckets") -> DataFrame:
    """df with the hashes of (size, other keys, value of the bucketed one divided by size), one for each size and element."""
    bucketed = next(k for k in index.keys if k.buckets)
    others = [k.name for k in index.keys if k is not bucketed]
    if any(table.columns[k].spec.is_collection for k in others) and len(others) != 1:
        raise SchemaError("bucketing takes one collection at most, and then no other column")
    hashes = []
    for size in sorted(set(bucketed.buckets)):
        bucket = F.call_function("div", F.col(bucketed.name).cast("bigint"), F.lit(size).cast("bigint"))
        if others and table.columns[others[0]].spec.is_collection:
            hashes.append(_per_element(others[0], size, bucket))
        else:
            hashes.append(F.array(hash_tuple([F.lit(size), *[F.col(k) for k in others], bucket])))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.flatten(F.array(*hashes)))))


def _per_element(column: str, size: int, bucket):
    return F.transform(column, lambda v: hash_tuple([F.lit(size), v, bucket]))


def bucket_filter(index: Index, low: int, high: int, others: dict[str, int], out: str = "zz_buckets"):
    """A condition on the bucket column that every row of [low, high] fulfils; None if no cover is close enough."""
    from keyloom.functions.encode import hash_tuple_value

    bucketed = next(k for k in index.keys if k.buckets)
    names = [k.name for k in index.keys if k is not bucketed]
    cover = plan_buckets(low, high, bucketed.buckets)
    if not cover:
        return None
    wanted = [hash_tuple_value([size, *[others[k] for k in names], b]) for size, b in cover]
    return F.arrays_overlap(out, F.array(*map(F.lit, wanted)))


