"""Shards of near equal bytes by a histogram sort, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.common import persisted

SHARDS, PARTS, TOLERANCE, PER_ROW = 40, 16, 0.002, 16
#: Bits of the key that the rounds of probes take: the first one TOP, each later one STEP, of three words of 64: the hash of
#: the text, that of the id, and a number that tells equal rows apart.
TOP, STEP, KEY = 12, 8, ("_h", "_d", "_r")
WORDS = 64 * len(KEY)


def _digit(done: int, bits: int) -> Column:
    """The next `bits` bits of the key after the first `done`, as a number from 0; they lie in one word."""
    return F.shiftrightunsigned(F.shiftleft(F.col(KEY[done // 64]), done % 64), 64 - bits)


def splitters(rows: DataFrame, parts: int, slack: float) -> list[int]:
    """Boundaries (keys of 192 bits, ascending) of `parts` ranges of equal bytes.

    rows: _h, _d, _r (bigint, in unsigned order) and size. Each round counts the exact bytes below candidate boundaries over
    all partitions; each splitter takes the nearest candidate. One that misses its target by more than `slack` times all
    bytes is probed again within its bin, at the next bits, unless the bin has a single row. The driver gets at most
    2^TOP, then (parts - 1) * 2^STEP counts, whatever the input.
    """
    marks: dict[int, int] = {}
    total = 0

    def settle(base: int, prefix: int, bits: int, counts: list, wanted: list[int], shift: int) -> dict:
        """prefix: the key's bits before these; base: bytes below the bin that it names; shift: bits after these."""
        more: dict = {}
        ends, below = [], base
        for b, size, n in sorted(counts):
            ends.append((b, below, below + size, n))
            below += size
        k = 0
        for i in wanted:
            target = total * i / parts
            while k < len(ends) - 1 and ends[k][2] < target:
                k += 1
            b, low, high, n = ends[k]
            key, at = (b, low) if target - low <= high - target else (b + 1, high)
            if abs(at - target) <= slack * total or n == 1 or not shift:
                marks[i] = ((prefix << bits) + key) << shift
            else:
                more.setdefault((prefix << bits) + b, (low, []))[1].append(i)
        return more

    def counts(df: DataFrame, *by: Column) -> list:
        return df.groupBy(*by).agg(F.sum("size"), F.count(F.lit(1))).collect()

    first = [tuple(r) for r in counts(rows, _digit(0, TOP).alias("bin"))]
    total = sum(r[1] for r in first)
    left = settle(0, 0, TOP, first, list(range(1, parts)), WORDS - TOP) if total else {}
    done = TOP
    while left:
        bits = min(STEP, 64 - done % 64)
        names = _named(rows, sorted(left), done)
        by: dict[int, list] = {}
        for prefix, b, size, n in counts(names, F.col("_name"), _digit(done, bits).alias("bin")):
            by.setdefault(sorted(left)[prefix], []).append((b, size, n))
        further: dict = {}
        for prefix, (base, wanted) in left.items():
            further |= settle(base, prefix, bits, by[prefix], wanted, WORDS - done - bits)
        done, left = done + bits, further
    return [marks[i] for i in sorted(marks)]


def _named(rows: DataFrame, prefixes: list[int], done: int) -> DataFrame:
    """The rows whose first `done` bits are one of the prefixes, and its number as _name."""
    keys, table = [], [[k] for k in range(len(prefixes))]
    for w, word in enumerate(KEY[: -(-done // 64)]):
        left = min(64, done - 64 * w)  # bits of this word
        keys.append(F.shiftrightunsigned(word, 64 - left) if left < 64 else F.col(word))
        for row, p in zip(table, prefixes, strict=True):
            row.append(_signed((p >> (done - 64 * w - left)) & ((1 << left) - 1)))
    columns = [f"_k{w}" for w in range(len(keys))]
    names = rows.sparkSession.createDataFrame(list(map(tuple, table)), ", ".join(["_name int", *[f"{c} bigint" for c in columns]]))
    return rows.withColumns(dict(zip(columns, keys, strict=True))).join(F.broadcast(names), columns)  # a row for each splitter


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _place(rows: DataFrame, marks: list[int]) -> DataFrame:
    """rows with the column _place: how many marks (keys of 192 bits) are at or below the row's key.

    The marks are dealt to the 2^TOP bins of the key's first bits; a row only meets those of its own bin.
    """
    flip, own = 1 << 63, {}
    for m in marks:
        own.setdefault(m >> (WORDS - TOP), []).append(tuple(_signed((m >> at) ^ flip) for at in range(WORDS - 64, -1, -64)))
    below, bins = 0, []
    for b in range(1 << TOP):
        bins.append((b, below, own.get(b, [])))
        below += len(own.get(b, []))
    table = rows.sparkSession.createDataFrame(bins, "_bin int, _below int, _own array<struct<h: bigint, d: bigint, r: bigint>>")
    key = F.struct(*[F.col(w).bitwiseXOR(F.lit(_signed(flip))).alias(w[1:]) for w in KEY])
    joined = rows.withColumn("_bin", _digit(0, TOP).cast("int")).join(F.broadcast(table), "_bin")  # 2^TOP rows, and a mark for each splitter
    return joined.withColumn("_place", (F.col("_below") + F.size(F.filter("_own", lambda m: m <= key))).cast("int")).drop("_bin", "_below", "_own")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, parts: int = PARTS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with the columns size, shard and slot: shards of near equal bytes, each row in a place of its own.

    size: the UTF-8 bytes of the text (null: none) plus 16 for the row. Rows are ordered by the hash of the text, then that
    of the id, so equal texts are neighbours; a group of copies is only cut where its shard would else miss its size.
    Splitters are found for `shards * parts` ranges, each within `tolerance` of a shard's bytes or at the nearest row;
    the ranges keep the numbering within a shard in many tasks, and the rows are exchanged once. slot: gapless from 0 in
    each shard. Null ids and texts are ordered like a fixed value. If rows repeat in id and text, docs is written once with
    row numbers, and these tell them apart, so that a row that repeats very often is dealt to many shards. Other columns
    stay; those named size, shard or slot are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]

    def keys(df: DataFrame, number: Column) -> DataFrame:
        return df.withColumns({
            "_h": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
            "_d": F.xxhash64(F.col(id_col)),
            "_r": number.cast("bigint"),
            "size": F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")) + F.lit(PER_ROW),
        })

    keyed = keys(docs.select(*own), F.lit(0))
    rows, _ = persisted(keyed.select(*KEY, "size"), "sizes")
    if not rows.groupBy("_h", "_d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        numbered, _ = persisted(docs.select(*own, F.monotonically_increasing_id().alias("_number")), "rows")
        keyed = keys(numbered, F.xxhash64("_number")).drop("_number")
        rows, _ = persisted(keyed.select(*KEY, "size"), "sizes")
    n = shards * parts
    marks = splitters(rows, n, tolerance / shards)
    counts = {r["_place"]: r["n"] for r in _place(rows, marks).groupBy("_place").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    first, at = [], 0
    for p in range(n):
        at = at if p % parts else 0
        first.append((p, at))
        at += counts.get(p, 0)
    offsets = spark.createDataFrame(first, "_place int, _first bigint")
    order = Window.partitionBy("_place").orderBy(*KEY, "size")
    placed = _place(keyed, marks).withColumn("_row", F.row_number().over(order)).join(F.broadcast(offsets), "_place")
    return placed.select(*own, "size", F.floor(F.col("_place") / F.lit(parts)).cast("int").alias("shard"), (F.col("_first") + F.col("_row") - 1).alias("slot"))
