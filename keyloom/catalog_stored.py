"""Queries over stored layouts, stored keys, files and snapshots: each writes what it reads in the shared folder first."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.catalog import PO, baskets, day_of, events, read, sql_fnv
from keyloom.functions import encode
from keyloom.operators import admin, groups
from keyloom.operators.entity import Entity, EntitySchema, key_columns
from keyloom.operators.query import Query, Table, max_, sum_
from keyloom.plans.schema import Col, FixedValues, Index, TableSchema
from keyloom.sources import layouts, typed_csv
from keyloom.sources.store import SnapshotStore

COLUMNS = (
    Col("o_orderkey"), Col("o_custkey"), Col("part", "int"), Col("status_no", "int"), Col("prio", "int"), Col("day", "int"),
    Col("o_orderstatus", "string"), Col("o_orderpriority", "string"), Col("o_totalprice", "double"), Col("updated_version", "int"),
)


def stored_schema(*indexes: Index, fixed: bool = True) -> TableSchema:
    domain = (FixedValues("status_no", values=(0, 1, 2)),) if fixed else ()
    return TableSchema("orders", COLUMNS, keys=("o_orderkey",), partition="part", managed=False, fixed=domain, indexes=indexes)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local session without spark.checkpoint.dir gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    uri = f"{root.rstrip('/')}/keyloom/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


def orders(spark: SparkSession, d: str, schema: TableSchema) -> Table:
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    own = read(spark, d, "orders").withColumns({
        "part": (F.col("o_custkey") % 10).cast("int"), "status_no": status, "prio": F.substring("o_orderpriority", 1, 1).cast("int"),
        "day": day_of("o_orderdate"), "updated_version": (F.col("o_orderkey") % 1000 + 1).cast("int"),
    })
    return Table(schema, own.select(*[c.name for c in COLUMNS]))


OS = """WITH os AS (SELECT o_orderkey, o_custkey, o_custkey % 10 AS part, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status_no,
 substr(o_orderpriority, 1, 1)::INT AS prio, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, o_orderstatus, o_orderpriority, o_totalprice,
 o_orderkey % 1000 + 1 AS upv FROM orders) """


def through(spark: SparkSession, d: str, index: Index, ask: Callable[[Query], Query], *, fixed: bool = True) -> DataFrame:
    """The query over a table whose one layout is stored; it must be read, with a condition on its keys in the scan."""
    built = layouts.build_layouts(orders(spark, d, stored_schema(index, fixed=fixed)), folder(spark, "layout"))
    q = ask(built.query())
    route = q.route()
    if route.source.name not in built.layouts:
        raise RuntimeError(f"the stored layout is not read: {q.explain_route()}")
    return q.df()


VIEW = Index((Col("prio", "int"),), "view", cols=("o_totalprice",))
PACKED = Index((Col("status_no", "int"), Col("prio", "int").decimal_size(2)), "view")
HASH = Index((Col("o_orderstatus", "string"), Col("o_orderpriority", "string")), "view")
OTHER = Index((Col("day", "int"),), "view", partition="prio")
DELTA, KEYLESS = Index((Col("status_no", "int"),), "delta"), Index((), "delta")
LOCAL, GLOBAL = Index((Col("day", "int"),), "local"), Index((Col("o_custkey"),), "global")
GROUP = Index((Col("day", "int"), Col("status_no", "int")), group=True)


def q_layout_view(s, d):
    return through(s, d, VIEW, lambda q: q.eq("part", 3).eq("prio", 2).select("o_orderkey", "o_totalprice"))


def q_layout_packed(s, d):
    """Two values and a range: a range of the packed key for each value."""
    return through(s, d, PACKED, lambda q: q.eq("part", 3).isin("status_no", [0, 2]).between("prio", 2, 3).select("o_orderkey", "status_no", "prio"))


def q_layout_packed_group(s, d):
    """A grouping whose rows come through a packed view."""
    return through(s, d, PACKED, lambda q: q.eq("part", 3).eq("status_no", 1).ge("prio", 2).group_by("status_no", "prio", n=sum_("part"), m=max_("o_orderkey")))


def q_fixed_value_fanout(s, d):
    """No condition on the first key of the packed view: its declared domain is added."""
    out = through(s, d, PACKED, lambda q: q.eq("part", 3).eq("prio", 2).select("o_orderkey"))
    return out


def q_layout_hash(s, d):
    return through(s, d, HASH, lambda q: q.eq("part", 3).eq("o_orderstatus", "F").isin("o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey"))


def q_layout_other_partition(s, d):
    return through(s, d, OTHER, lambda q: q.eq("prio", 2).between("day", 9000, 9400).select("o_orderkey", "day"))


def q_layout_local(s, d):
    return through(s, d, LOCAL, lambda q: q.eq("part", 3).between("day", 9000, 9400).select("o_orderkey"))


def q_layout_global(s, d):
    return through(s, d, GLOBAL, lambda q: q.eq("o_custkey", 7).select("o_orderkey"))


def q_layout_delta(s, d):
    out = through(s, d, DELTA, lambda q: q.eq("part", 3).select("o_orderkey", "status_no", "updated_version").delta(500, 1))
    return out.withColumnRenamed("updated_version", "upv")


def q_layout_delta_first(s, d):
    out = through(s, d, DELTA, lambda q: q.eq("part", 3).select("o_orderkey", "status_no", "updated_version").delta(0, 1))
    return out.withColumnRenamed("updated_version", "upv")


def q_keyless_delta(s, d):
    out = through(s, d, KEYLESS, lambda q: q.eq("part", 3).select("o_orderkey", "updated_version").delta(500))
    return out.withColumnRenamed("updated_version", "upv")


def q_layout_group(s, d):
    return through(s, d, GROUP, lambda q: q.eq("part", 3).eq("status_no", 1).between("day", 9000, 9400).select("o_orderkey", "day"))


def q_layout_group_fanout(s, d):
    """Through a group of a collection: a row stands once for each element and is read once."""
    own = baskets(s, d)
    wide = TableSchema("baskets", (*own.schema.columns, Col("size", "int")), keys=own.schema.keys, partition=own.schema.partition, managed=False, indexes=(Index((Col("parts", "array<bigint>"), Col("size", "int")), group=True),))
    built = layouts.build_layouts(Table(wide, own.data.withColumn("size", F.size("parts"))), folder(s, "layout"))
    return built.query().isin("o_custkey", list(range(20))).contains("parts", 5).between("size", 1, 9).select("o_orderkey").df()


def q_layout_exploded(s, d):
    built = layouts.build_layouts(baskets(s, d), folder(s, "layout"))
    return built.query().contains("parts", 5).eq("o_custkey", 7).select("o_orderkey").df().unionByName(built.query().contains("parts", 6).select("o_orderkey").df())


def q_drop_layouts(s, d):
    """After its layouts are dropped, the base table answers alike."""
    root = folder(s, "layout")
    built = layouts.build_layouts(orders(s, d, stored_schema(PACKED)), root)
    return layouts.drop_layouts(built, root).query().eq("part", 3).eq("status_no", 0).eq("prio", 2).select("o_orderkey").df()


def q_view_table_sync(s, d):
    """Odd parts leave the baskets of some customers; their rows in the exploded layout are put right."""
    t = baskets(s, d)
    source = next(x for x in t.compiled.sources if x.kind == "exploded")
    changed = t.via(t.data.where("o_custkey % 10 = 3").withColumn("parts", F.filter("parts", lambda p: p % 2 == 0)))
    return layouts.sync_exploded(layouts.layout(t, source), source, changed).select("o_custkey", F.col("parts").alias("part"), "o_orderkey")


KEYED = TableSchema("keyed", (Col("k"), Col("o_custkey"), Col("o_orderkey"), Col("o_totalprice", "double")), keys=("k",), int_packing=(Col("o_custkey").decimal_size(8), Col("o_orderkey").decimal_size(10)), managed=False)
JOINED = TableSchema("joined", (Col("k", "string"), Col("o_custkey"), Col("o_orderkey"), Col("o_totalprice", "double")), keys=("k",), concat=("o_custkey", "o_orderkey"), managed=False)


def q_key_packing(s, d):
    """Conditions on the parts of a packed key become ranges of the key, one for each customer."""
    key = encode.pack([F.col("o_custkey"), F.col("o_orderkey")], [8, 10])
    t = Table(KEYED, read(s, d, "orders").select(key.alias("k"), "o_custkey", "o_orderkey", "o_totalprice"))
    return t.query().isin("o_custkey", [3, 7]).between("o_orderkey", 100, 9000).select("k", "o_orderkey").df()


def q_key_concat(s, d):
    key = encode.concat_key([(F.col("o_custkey"), "bigint"), (F.col("o_orderkey"), "bigint")])
    t = Table(JOINED, read(s, d, "orders").select(key.alias("k"), "o_custkey", "o_orderkey", "o_totalprice"))
    return t.query().eq("o_custkey", 7).select("k", "o_orderkey").df()


INHERITED = TableSchema("keyed", (Col("k"), Col("bucket", "int"), Col("day", "int"), Col("n"), Col("part", "int"), Col("updated_version", "int")), keys=("k",), partition="part", int_packing=(Col("day", "int").decimal_size(6), Col("bucket", "int").decimal_size(2), Col("n").decimal_size(10)), managed=False, indexes=(Index((Col("day", "int"), Col("bucket", "int")), group=True, inherit=True),))


def q_group_inherit(s, d):
    """A group that leads the packed key: its read also ranges over the key."""
    own = read(s, d, "events").select(day_of("ts").alias("day"), (F.col("user_id") % 7).cast("int").alias("bucket"), F.col("event_id").alias("n"), F.lit(1).alias("part"), (F.col("event_id") % 900 + 1).cast("int").alias("updated_version"))
    t = Table(INHERITED, own.withColumn("k", encode.pack([F.col("day"), F.col("bucket"), F.col("n")], [6, 2, 10])))
    fresh = groups.group_freshness(t.data, t.compiled, ["day", "bucket"])
    found = groups.query_group(t.query().eq("part", 1).eq("bucket", 3).between("day", 19725, 19734), fresh)
    return found.select(F.get("values", 0).alias("d"), "upc", F.size("records").cast("bigint").alias("n"))


def q_group_cached(s, d):
    """Of the groups that the caller has (those of even days), the records are not sent again."""
    t = events(s, d)
    fresh = groups.group_freshness(t.data, t.compiled, ["day", "is_click"])
    own = fresh.where("part = 7 AND v_is_click = 1 AND v_day BETWEEN 19725 AND 19734 AND v_day % 2 = 0").select("id", "upc").collect()  # ten groups at most
    found = groups.query_group(t.query().eq("user_id", 7).eq("is_click", 1).between("day", 19725, 19734), fresh, {r["id"]: r["upc"] for r in own})
    return found.select(F.get("values", 0).alias("d"), F.col("upc").cast("bigint").alias("upc"), F.size("records").cast("bigint").alias("n"))


def q_group_hash_values(s, d):
    t = events(s, d)
    both = groups.with_hashes(t.data, t.compiled, ["day", "is_click"], "ig")
    return groups.hash_set(both, t.compiled, ["day", "is_click"], "stored").select("event_id", "ig", "stored")


def q_recalc_groups(s, d):
    """A partition whose freshness has gone astray is computed anew."""
    t = events(s, d)
    fresh = groups.group_freshness(t.data, t.compiled, ["day", "is_click"])
    astray = fresh.withColumn("upc", F.when(F.col("part") == 7, F.lit(-1)).otherwise(F.col("upc")))
    out = admin.recalc_groups(t, 7, astray, ["day", "is_click"])
    return out.select(F.col("part").alias("user_id"), F.col("v_day").cast("bigint").alias("d"), F.col("v_is_click").alias("k"), F.col("upc").cast("bigint").alias("upc"))


def q_csv_roundtrip(s, d):
    """A partition goes to a file and comes back; the others stay."""
    t, path = baskets(s, d), folder(s, "csv")
    typed_csv.export_csv(t, 7, path)
    back = typed_csv.restore_csv(t.via(t.data.where("o_custkey <> 7")), 7, path)
    return back.select("o_orderkey", "o_custkey", F.size("parts").cast("bigint").alias("n"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def q_snapshot_versions(s, d):
    """Two versions; the reader gets the last, and the first by its number."""
    store = SnapshotStore(s, folder(s, "store"))
    own = read(s, d, "nation")
    store.publish(own)
    store.publish(own.where("n_regionkey <> 2"), {"by_region": own.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))})
    last = store.read().select("n_nationkey", F.lit(2).alias("version"))
    return last.unionByName(store.read("data", 1).select("n_nationkey", F.lit(1).alias("version")))


PARTS = EntitySchema("part", (Col("p_partkey"), Col("p_name", "string"), Col("p_brand", "string"), Col("p_type", "string"), Col("p_size", "int")), partition=(Col("p_type", "string"),), sort=(Col("p_size", "int").base(4), Col("p_partkey").base(8)))


def q_entity_sort_range(s, d):
    """Entities stored with their keys: the sort key's range is a condition on the stored key."""
    path = folder(s, "entity")
    key_columns(read(s, d, "part"), PARTS).repartitionByRange(4, "pk", "sk").sortWithinPartitions("pk", "sk").write.parquet(path)
    q = Entity(PARTS, s.read.parquet(path)).query()
    return q.eq("p_type", "ECONOMY").between("p_size", 5, 20).df().select("p_partkey", "sk")


def in_os(columns: str, where: str) -> str:
    return f"{OS}SELECT {columns} FROM os WHERE {where}"


EVENT_GROUPS = "SELECT user_id, datediff('day', DATE '1970-01-01', ts::DATE) AS d, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS v, event_id FROM events"
HASHED = sql_fnv("d", "k")
SIGNED = f"(CASE WHEN {HASHED} >= 2147483648 THEN {HASHED} - 4294967296 ELSE {HASHED} END)::INTEGER"
SQL = {
    "q_layout_view": in_os("o_orderkey, o_totalprice", "part = 3 AND prio = 2"),
    "q_layout_packed": in_os("o_orderkey, status_no, prio", "part = 3 AND status_no IN (0, 2) AND prio BETWEEN 2 AND 3"),
    "q_layout_packed_group": f"{OS}SELECT status_no, prio, sum(part)::BIGINT AS n, max(o_orderkey) AS m FROM os WHERE part = 3 AND status_no = 1 AND prio >= 2 GROUP BY 1, 2",
    "q_fixed_value_fanout": in_os("o_orderkey", "part = 3 AND prio = 2"),
    "q_layout_hash": in_os("o_orderkey", "part = 3 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "q_layout_other_partition": in_os("o_orderkey, day::INTEGER AS day", "prio = 2 AND day BETWEEN 9000 AND 9400"),
    "q_layout_local": in_os("o_orderkey", "part = 3 AND day BETWEEN 9000 AND 9400"),
    "q_layout_global": in_os("o_orderkey", "o_custkey = 7"),
    "q_layout_delta": in_os("o_orderkey, status_no, upv::INTEGER AS upv", "part = 3 AND upv >= 501"),
    "q_layout_delta_first": in_os("o_orderkey, status_no, upv::INTEGER AS upv", "part = 3 AND status_no = 1"),
    "q_keyless_delta": in_os("o_orderkey, upv::INTEGER AS upv", "part = 3 AND upv >= 501"),
    "q_layout_group": in_os("o_orderkey, day::INTEGER AS day", "part = 3 AND status_no = 1 AND day BETWEEN 9000 AND 9400"),
    "q_layout_group_fanout": PO + "SELECT o_orderkey FROM po WHERE o_custkey < 20 AND list_contains(parts, 5) AND len(parts) BETWEEN 1 AND 9",
    "q_layout_exploded": PO + "SELECT o_orderkey FROM po WHERE list_contains(parts, 5) AND o_custkey = 7 UNION ALL SELECT o_orderkey FROM po WHERE list_contains(parts, 6)",
    "q_drop_layouts": in_os("o_orderkey", "part = 3 AND status_no = 0 AND prio = 2"),
    "q_view_table_sync": "SELECT DISTINCT o.o_custkey, l.l_partkey AS part, o.o_orderkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey % 10 <> 3 OR l.l_partkey % 2 = 0",
    "q_key_packing": "SELECT o_custkey * 10000000000 + o_orderkey AS k, o_orderkey FROM orders WHERE o_custkey IN (3, 7) AND o_orderkey BETWEEN 100 AND 9000",
    "q_key_concat": None,
    "q_group_inherit": f"SELECT d, max(event_id % 900 + 1)::INTEGER AS upc, count(*) AS n FROM ({EVENT_GROUPS}) WHERE user_id % 7 = 3 AND d BETWEEN 19725 AND 19734 GROUP BY 1",
    "q_group_cached": f"SELECT d, max(v) AS upc, CASE WHEN d % 2 = 0 THEN 0 ELSE count(*) END AS n FROM ({EVENT_GROUPS}) WHERE user_id = 7 AND k = 1 AND d BETWEEN 19725 AND 19734 GROUP BY 1",
    "q_group_hash_values": f"SELECT event_id, {SIGNED} AS ig, {SIGNED} AS stored FROM ({EVENT_GROUPS})",
    "q_recalc_groups": f"SELECT user_id, d, k, max(v) AS upc FROM ({EVENT_GROUPS}) GROUP BY ALL",
    "q_csv_roundtrip": PO + "SELECT o_orderkey, o_custkey, len(parts) AS n, list_sum(parts)::BIGINT AS total FROM po",
    "q_snapshot_versions": "SELECT n_nationkey, 1 AS version FROM nation UNION ALL SELECT n_nationkey, 2 FROM nation WHERE n_regionkey <> 2",
    "q_entity_sort_range": None,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    from keyloom.catalog import sql_base62, sql_ordered64

    concat = f"SELECT rtrim({sql_base62('o_custkey')} || '_' || {sql_base62('o_orderkey')}, '_') AS k, o_orderkey FROM orders WHERE o_custkey = 7"
    sort = f"SELECT p_partkey, {sql_ordered64('p_size', 4)} || '#' || {sql_ordered64('p_partkey', 8)} AS sk FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 20"
    return {**SQL, "q_key_concat": concat, "q_entity_sort_range": sort}
