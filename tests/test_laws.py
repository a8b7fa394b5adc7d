"""Laws of writes, snapshots, plans over several ranges, and files."""

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyloom import catalog
from keyloom import catalog_stored as stored
from keyloom.operators import write
from keyloom.operators.query import Table
from keyloom.plans.planner import ranges_of
from keyloom.plans.predicates import Pred, conjunction
from keyloom.plans.schema import Col, FixedValues, Index, TableSchema, compile_table
from keyloom.sources import layouts, typed_csv
from keyloom.sources.store import SnapshotStore

PLAIN = TableSchema("t", (Col("id"), Col("x", "int"), Col("updated_version")), keys=("id",), managed=False)
SLOTTED = TableSchema("t", (Col("id"), Col("part"), Col("x", "int"), Col("updated_version")), keys=("id",), partition="part", managed=False, fixed=(FixedValues("x", values=(0, 1)),), indexes=(Index((Col("x", "int"),), "delta"),))


def test_repeated_keys(spark):
    t = Table(TableSchema("t", (Col("id"), Col("x", "int")), keys=("id",), managed=False), spark.createDataFrame([(1, 5), (2, 6)], "id bigint, x int"))
    rows = spark.createDataFrame([(1, 7, 2), (1, 8, 3), (1, 9, 1), (3, 1, 1)], "id bigint, x int, at int")
    got = {tuple(r) for r in write.insert(t, rows, order="at").select("id", "x").collect()}
    assert got == {(1, 8), (2, 6), (3, 1)}
    assert {tuple(r) for r in write.update(t, rows.where("id = 1"), ["x"], order="at").collect()} == {(1, 8), (2, 6)}
    with pytest.raises(PySparkException, match="an order is needed"):
        write.insert(t, rows.drop("at")).collect()
    same = spark.createDataFrame([(1, 7), (1, 7)], "id bigint, x int")
    assert {tuple(r) for r in write.insert(t, same).collect()} == {(1, 7), (2, 6)}
    keys = spark.createDataFrame([(9,), (9,)], "id bigint")
    assert write.insert(t, keys).where("id = 9").count() == 1
    merged = write.merge(t, rows.where("id = 1"), F.lit(True), lambda df: df, ["x"], order="at")
    assert {tuple(r) for r in merged.select("id", "x").collect()} == {(1, 8), (2, 6)}


def test_versions_without_a_partition_and_beyond_the_slot(spark):
    t = compile_table(PLAIN)
    df = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, x int")
    empty = spark.createDataFrame([], "part bigint, ver bigint")
    assert [r.updated_version for r in write.stamp(df, t, 0, versions=empty).collect()] == [1, 1]
    counters = spark.createDataFrame([(0, 4), (0, 6)], "part bigint, ver bigint")
    assert [r.updated_version for r in write.stamp(df, t, 0, versions=counters).collect()] == [7, 7]
    slotted = compile_table(SLOTTED)
    rows = spark.createDataFrame([(1, 1, 0), (2, 2, 1)], "id bigint, part bigint, x int")
    full = spark.createDataFrame([(1, 10**8 - 1)], "part bigint, ver bigint")
    assert write.stamp(rows.where("part = 2"), slotted, 0, versions=full).first().updated_version == 1
    with pytest.raises(PySparkException, match="does not fit"):
        write.stamp(rows, slotted, 0, versions=full).collect()


@pytest.mark.parametrize("order", [["k"], ["name", "k"]])
def test_autoincrement_is_gapless_in_ranges(spark, order):
    rows = [(i, ["b", "a", None, "c"][i % 4], i % 3 if i % 7 else 50 + i) for i in range(700)]
    df = spark.createDataFrame(rows, "k bigint, name string, id bigint").withColumn("id", F.when(F.col("id") >= 50, F.col("id"))).repartition(5)
    got = {r.k: r.id for r in write.autoincrement(df, "id", [], order, spark.createDataFrame([(1000,)], "current_value bigint")).collect()}
    new = [(tuple((x is not None, x) for x in ((r[1], r[0]) if order[0] == "name" else (r[0],))), r[0]) for r in rows if r[2] < 50]
    assert [got[k] for _, k in sorted(new)] == list(range(1001, 1001 + len(new)))
    assert all(got[r[0]] == r[2] for r in rows if r[2] >= 50)


def test_ranges_are_joined_and_bounded(spark):
    assert ranges_of("k", [(5, 9), (1, 3), (3, 4), (8, 12), (20, 20)]) == Pred("k", "RANGES", ((1, 3), (5, 11)))
    many = ranges_of("k", [(10 * i, 10 * i + 2) for i in range(100)])
    assert len(many.values) == 32 and many.values[0][0] == 0 and many.values[-1][1] == 991
    df = spark.range(30).withColumnRenamed("id", "k")
    assert [r.k for r in df.where(conjunction([Pred("k", "RANGES", ((1, 2), (7, 7)))])).collect()] == [1, 2, 7]


def test_stored_packed_view_prunes_by_each_range(spark, tmp_path):
    t = stored.orders(spark, "/root/testdata/sf0.001", stored.stored_schema(stored.PACKED))
    built = layouts.build_layouts(t, str(tmp_path))
    q = built.query().eq("part", 3).isin("status_no", [0, 2]).between("prio", 2, 3).select("o_orderkey")
    assert [p.values for p in q.route().redundant] == [((2, 3), (202, 203))]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    pushed = q.df()._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "zz_" in pushed and "Or(" in pushed


def test_layouts_of_a_join_take_few_small_files(spark, tmp_path):
    """Spark's size of a join is the product of its sides, and a Bloom filter has 1 MB unless it is fitted."""
    layouts.build_layouts(catalog.baskets(spark, "/root/testdata/sf0.01"), str(tmp_path))
    files = list(tmp_path.glob("*/*.parquet"))
    assert len(files) == layouts.FEWEST and sum(f.stat().st_size for f in files) < 2 << 20


def test_group_layout_of_a_join_takes_few_small_files(spark):
    files = [f.removeprefix("file://") for f in stored.q_layout_group_fanout(spark, "/root/testdata/sf0.01").inputFiles()]
    assert len(files) == layouts.FEWEST and sum(Path(f).stat().st_size for f in files) < 3 << 20


def test_bytes_read(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    one = sum(f.stat().st_size for f in (tmp_path / "a").glob("*.parquet"))
    assert layouts.bytes_read(a) == one and layouts.bytes_read(a.join(a.withColumnRenamed("id", "j"), F.col("id") < F.col("j"))) == 2 * one
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "id int")
    assert layouts.bytes_read(unknown) is None


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.version == 0
    with pytest.raises(KeyError):
        store.read()
    store.publish(spark.range(3))
    boom = spark.range(2).select(F.raise_error(F.lit("boom")).cast("bigint").alias("id"))
    with pytest.raises(PySparkException):
        store.publish(spark.range(9), markers={"marks": boom})
    assert store.version == 1 and store.read().count() == 3
    (tmp_path / "s" / "draft-2.json").write_text("{}")  # a writer that died before its rename
    assert store.version == 1 and store.publish(spark.range(5)) == 2 and store.read().count() == 5 and store.read("data", 1).count() == 3
    store.drop_before(2)
    assert store.versions() == [2] and store.read().count() == 5


def test_lists_keep_nulls_and_empty_texts(spark, tmp_path):
    schema = TableSchema("t", (Col("part"), Col("id"), Col("s", "[]string"), Col("n", "[]int64")), keys=("id",), partition="part", managed=False)
    rows = [(1, 1, ["", "a,b", None, "\\e"], [1, None, -5]), (1, 2, [], []), (1, 3, None, None), (1, 4, [""], [None]), (1, 5, [None], [0])]
    t = Table(schema, spark.createDataFrame(rows, "part bigint, id bigint, s array<string>, n array<bigint>"))
    typed_csv.export_csv(t, 1, str(tmp_path / "f"))
    back = typed_csv.read_csv(spark, t.compiled, 1, str(tmp_path / "f"))
    assert sorted((tuple(r[c] for c in ("part", "id", "s", "n")) for r in back.collect()), key=lambda r: r[1]) == rows


def test_group_numbers_probe_past_each_other():
    schema = TableSchema("t", (Col("a"), Col("b", "int"), Col("c", "int")), keys=("a",), managed=False, indexes=(Index((Col("b", "int"), Col("c", "int")), group=True), Index((Col("c", "int"),), group=True)))
    ids = compile_table(schema).group_ids
    assert len(set(ids.values())) == 2 and all(-32768 <= v <= 32767 and v for v in ids.values())
