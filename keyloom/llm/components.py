"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import persisted, remove


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for each node of edges (a, b: bigint): root is the smallest node that links reach.

    Each round is written to the shared folder, which cuts the lineage; the rounds end when the links no longer change.
    Nodes that only link with themselves, and null ends, have no row. The minimum is taken in a partial aggregate before
    the exchange; the joins are on one unique side, so adaptive execution can split a node with very many links.
    """
    spark = edges.sparkSession
    ends = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, path = persisted(ends, "links")
    before = None
    for _ in range(max_rounds):
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links, new = persisted(small, "links")
        remove(spark, path)
        path, before = new, state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
