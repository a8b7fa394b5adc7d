"""Text files with typed columns: a header of name:type-number, fields cut by bars, integers in base 64.

The partition column is not in the file; it is given when the file is read. Line ends and bars in texts are escaped.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.encode import csv64, from_csv64
from keyloom.functions.types import BY_ID, INTEGERS
from keyloom.operators.query import Table
from keyloom.plans.schema import CompiledTable, SchemaError

# What stands for a back slash, a bar, a comma and line ends within texts, for null, and for an empty text
# in a list, where nothing stands for no element.
ESCAPES = (("\\", "\\b"), ("|", "\\p"), (",", "\\c"), ("\n", "\\n"), ("\r", "\\r"))
NULL, EMPTY = "\\0", "\\e"
KINDS = {*range(1, 9), 10, *range(11, 18), *range(21, 29), *range(31, 38)}


def _escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _unescape(c: Column) -> Column:
    for raw, code in ESCAPES[:0:-1]:
        c = F.replace(c, F.lit(code), F.lit(raw))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def _write(c: Column, spark_type: str) -> Column:
    if spark_type.startswith("array"):
        element = spark_type[6:-1]
        item = lambda x: F.coalesce(F.when(_write(x, element) == "", F.lit(EMPTY)).otherwise(_write(x, element)), F.lit(NULL))
        return F.concat(F.lit("["), F.array_join(F.transform(c, item), ","))
    if spark_type in INTEGERS:
        return csv64(c)
    return _escape(c.cast("string"))


def _read(c: Column, spark_type: str) -> Column:
    if spark_type.startswith("array"):
        element, body = spark_type[6:-1], F.substring(c, 2, 1 << 30)
        parts = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, ","))
        return F.transform(parts, lambda x: F.when(x != NULL, _read(F.when(x == EMPTY, F.lit("")).otherwise(x), element))).cast(spark_type)
    if spark_type in INTEGERS:
        return from_csv64(c).cast(spark_type)
    return _unescape(c).cast(spark_type)


def _columns(table: CompiledTable) -> list[str]:
    s = table.schema
    own = [*s.keys, *[c for c in table.declared if c not in s.keys]]
    return [c for c in own if c != s.partition]


def export_csv(table: Table, partition: Any, path: str) -> None:
    """Writes the rows of a partition; every part file begins with the header."""
    t = table.compiled
    names = [c for c in _columns(t) if c in table.data.columns]
    if bad := [c for c in names if t.columns[c].spec.id not in KINDS]:
        raise SchemaError(f"columns {bad} have no form in these files")
    rows = table.data.where(F.col(t.schema.partition) == F.lit(partition))
    fields = [F.coalesce(_write(F.col(c), t.columns[c].spec.spark), F.lit(NULL)).alias(f"{c}:{t.columns[c].spec.id}") for c in names]
    header = "|".join(f"{c}:{t.columns[c].spec.id}" for c in names)
    rows.select(F.concat_ws("|", *fields).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/rows")
    table.data.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_csv(spark: SparkSession, table: CompiledTable, partition: Any, path: str) -> DataFrame:
    header = [h.rsplit(":", 1) for h in spark.read.text(f"{path}/header").first()[0].split("|")]
    parts = F.split(F.col("value"), r"\|", -1)
    columns = []
    for k, (name, number) in enumerate(header):
        if name not in table.columns or table.columns[name].spec.id != int(number):
            raise SchemaError(f"column {name}:{number} is not one of table {table.schema.name}")
        c = F.get(parts, k)
        columns.append(F.when(c != NULL, _read(c, BY_ID[int(number)].spark)).alias(name))
    part = table.schema.partition
    return spark.read.text(f"{path}/rows").select(F.lit(partition).cast(table.columns[part].spec.spark).alias(part), *columns)


def restore_csv(table: Table, partition: Any, path: str) -> DataFrame:
    """The table with a partition replaced by what the file holds."""
    rows = read_csv(table.data.sparkSession, table.compiled, partition, path)
    kept = table.data.where(~F.coalesce(F.col(table.schema.partition) == F.lit(partition), F.lit(False)))
    return kept.unionByName(rows.select(*[c for c in rows.columns if c in table.data.columns]), allowMissingColumns=True)
