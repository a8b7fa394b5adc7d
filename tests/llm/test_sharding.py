import random
from collections import Counter, defaultdict

import pytest

from keyloom.llm.sharding import shard_documents

SCHEMA = "doc_id bigint, text string, shard string, _n int"


def check(rows, got, shards, slack):
    assert len(got) == len(rows)
    slots = defaultdict(list)
    sizes = Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r.size == len((r.text or "").encode()) + 16 and 0 <= r.shard < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[k] - mean) <= slack for k in range(shards))


@pytest.mark.parametrize("copies", [0, 2000])
def test_shards_have_near_equal_bytes(spark, copies):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randrange(60), "x", 1) for i in range(4000)] + [(10_000 + i, "the same text", "x", 1) for i in range(copies)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = shard_documents(df, shards=8, parts=3).collect()
    check(rows, got, 8, 2 * 140)
    again = shard_documents(df.repartition(3), shards=8, parts=3).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_a_row_that_repeats_is_dealt_out(spark):
    rows = [(i, "é" * (i % 60), "x", 1) for i in range(500)] + [(7, "the same row", "y", 2)] * 3000
    check(rows, shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=8, parts=3).collect(), 8, 2 * 140)


def test_equal_texts_stay_together_where_sizes_allow(spark):
    rows = [(i, f"text {i % 800}", None, 0) for i in range(4000)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), shards=4, parts=2, tolerance=0.05).collect()
    where = defaultdict(set)
    for r in got:
        where[r.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_edge_cases(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None), (1, "", "a", 1), (1, "", "a", 1), (1, "", "b", 2), (None, "x" * 100_000, "c", 3)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA))
    assert set(out.columns) == {"doc_id", "text", "_n", "size", "shard", "slot"}
    check(rows, out.collect(), 40, 200_000)
