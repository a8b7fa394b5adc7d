"""Pairs within runs of equal keys, worked out in numpy over sorted Arrow batches, and links between them.

Candidate pairs live only inside a task, in bounded chunks; what leaves it is one row per linked item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs held at once.
CHUNK = 1 << 20


def in_blocks(df: DataFrame, keys: list[str], item: Column, block: int, shared: bool = False) -> DataFrame:
    """df with the columns run, side and cross: rows of one run are to be compared.

    A bucket (equal keys) of at most `block` rows is one run. A larger one is dealt into blocks by item, and each pair of
    blocks is a run of its own, so that no task gets a whole bucket and no pair is missed. cross: only pairs of
    different sides count, the others have a run of their own. shared: leave out buckets of one row.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    if shared:
        joined = df.join(counts.where("_n > 1").withColumn("_n", F.when(F.col("_n") > block, F.col("_n"))), keys)
    else:
        joined = df.join(counts.where(F.col("_n") > block), keys, "left")
    dealt = joined.withColumn("_b", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(item), parts)).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))))
    low, high = F.least("_b", "_o"), F.greatest("_b", "_o")
    return dealt.select(
        *[c for c in df.columns],
        F.xxhash64(*keys, low, high).alias("run"),
        (F.col("_b") > F.col("_o")).alias("side"),
        (F.col("_b") != F.col("_o")).alias("cross"),
    )


def sorted_runs(df: DataFrame) -> DataFrame:
    return df.repartition("run").sortWithinPartitions("run")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task, cut anew so that no run is split."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column("run").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(run, run[-1]))
        if cut == 0 and (not kept or kept[-1].column("run")[-1].as_py() == run[-1]):
            kept.append(batch)
            continue
        if done := [*kept, *([batch.slice(0, cut)] if cut else [])]:
            yield pa.Table.from_batches(done)
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def pairs(rows: pa.Table, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i < j, of the pairs to compare, in chunks."""
    run = rows["run"].to_numpy()
    side, cross = rows["side"].to_numpy(), rows["cross"].to_numpy()
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    ends = np.repeat(np.r_[starts[1:], len(run)], np.diff(np.r_[starts, len(run)]))
    at = np.arange(len(run))
    kept_i, kept_j, held, step = [], [], 0, 1
    while len(at := at[ends[at] > at + step]):
        good = ~cross[at] | (side[at] != side[at + step])
        kept_i.append(at[good])
        kept_j.append(at[good] + step)
        held += int(good.sum())
        if held >= chunk:
            yield np.concatenate(kept_i), np.concatenate(kept_j)
            kept_i, kept_j, held = [], [], 0
        step += 1
    if held:
        yield np.concatenate(kept_i), np.concatenate(kept_j)


class Links:
    """Union-find over numbered nodes, for arrays of links at a time; the root is the smallest number."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        up = self.parent[of]
        while not np.array_equal(up, further := self.parent[up]):
            up = further
        self.parent[of] = up
        return up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
