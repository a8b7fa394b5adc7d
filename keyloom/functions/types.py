"""The stable type numbers of columns and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass

# Type number, name, Spark type. 21-28 and 31-37 are the nullable forms of 1-7, 10 and 11-17.
_TYPES = [
    (1, "string", "string"), (2, "int64", "bigint"), (3, "int32", "int"), (4, "int16", "smallint"), (5, "int8", "tinyint"),
    (6, "float32", "float"), (7, "float64", "double"), (8, "bool", "boolean"), (9, "bytes", "binary"), (10, "int", "bigint"),
    (11, "[]string", "array<string>"), (12, "[]int64", "array<bigint>"), (13, "[]int32", "array<int>"), (14, "[]int16", "array<smallint>"),
    (15, "[]int8", "array<tinyint>"), (16, "[]float32", "array<float>"), (17, "[]float64", "array<double>"),
]
NULLABLE = {**{i: i + 20 for i in (*range(1, 8),)}, 10: 28, **{i: i + 20 for i in range(11, 18)}}


@dataclass(frozen=True)
class TypeSpec:
    id: int
    name: str
    spark: str
    nullable: bool = False

    @property
    def is_collection(self) -> bool:
        return self.spark.startswith("array")

    @property
    def element(self) -> str:
        return self.spark[6:-1] if self.is_collection else self.spark

    @property
    def is_integer(self) -> bool:
        return self.element in INTEGERS


INTEGERS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}
BY_ID = {i: TypeSpec(i, n, s) for i, n, s in _TYPES}
BY_ID |= {NULLABLE[i]: TypeSpec(NULLABLE[i], "*" + n, s, True) for i, n, s in _TYPES if i in NULLABLE}
BY_NAME = {t.name: t for t in BY_ID.values()} | {t.spark: t for t in reversed([BY_ID[i] for i in range(1, 18) if i != 10])}
#: Unsigned columns are widened.
BY_NAME |= {"uint8": BY_ID[4], "uint16": BY_ID[3], "uint32": BY_ID[2]}


def type_of(name: str) -> TypeSpec:
    """The type of a name of either kind; anything else is kept as binary, as an opaque value."""
    return BY_NAME.get(name, BY_ID[9])
