"""The queries over the supplied tables: each runs an operator of the engine on a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions import encode, text
from keyloom.operators import admin, groups, incremental, search, write
from keyloom.operators.entity import Entity, EntitySchema
from keyloom.operators.query import Table, avg, max_, sum_
from keyloom.plans.schema import Col, FixedValues, GenericRecord, Index, TableSchema
from keyloom.sources import layouts

ORDERS = TableSchema(
    "orders",
    (Col("o_orderkey"), Col("o_custkey"), Col("o_orderstatus", "string"), Col("o_totalprice", "double"), Col("o_orderdate", "timestamp"), Col("o_orderpriority", "string")),
    keys=("o_orderkey",),
    partition="o_custkey",
    table_id=1,
    managed=False,
    indexes=(Index((Col("o_orderkey").decimal_size(9),), "local"), Index((Col("o_orderstatus", "string"), Col("o_orderpriority", "string")), "view")),
)
LINEITEM = TableSchema(
    "lineitem",
    (Col("l_orderkey"), Col("l_partkey"), Col("l_suppkey"), Col("l_linenumber", "int"), Col("l_quantity", "double"), Col("l_returnflag", "string")),
    keys=("l_orderkey", "l_linenumber"),
    partition="l_suppkey",
    managed=False,
    indexes=(Index((Col("l_linenumber", "int"), Col("l_orderkey").decimal_size(10)), "view"),),
)
BASKETS = TableSchema(
    "baskets",
    (Col("o_orderkey"), Col("o_custkey"), Col("parts", "array<bigint>")),
    keys=("o_orderkey",),
    partition="o_custkey",
    managed=False,
    indexes=(Index((Col("parts", "array<bigint>"),), "view_table"),),
)
EVENTS = TableSchema(
    "events",
    (Col("event_id"), Col("user_id"), Col("status", "int"), Col("updated_version", "int"), Col("day", "int"), Col("is_click", "int")),
    keys=("event_id",),
    partition="user_id",
    table_id=2,
    managed=False,
    fixed=(FixedValues("status", values=(0, 1, 2, 3, 4)),),
    indexes=(Index((Col("status", "int"),), "delta"), Index((Col("day", "int"), Col("is_click", "int")), group=True), Index((Col("is_click", "int"), Col("day", "int").bucketing(4, 8)))),
)
PART = TableSchema(
    "part",
    (Col("p_partkey"), Col("p_name", "string"), Col("p_brand", "string"), Col("p_type", "string"), Col("p_size", "int"), Col("p_retailprice", "double"), Col("part", "int"), Col("updated_version", "int")),
    keys=("p_partkey",),
    partition="part",
    table_id=3,
    managed=False,
    save_version=True,
    text=("p_name",),
    generic=GenericRecord("p_name", s1="p_brand", s2="p_type", n1="p_size"),
)
CUSTOMER = TableSchema("customer", (Col("c_custkey"), Col("c_name", "string"), Col("c_nationkey", "int"), Col("c_acctbal", "double"), Col("c_mktsegment", "string")), keys=("c_custkey",), managed=False)
SUPPLIER = TableSchema("supplier", (Col("s_suppkey"), Col("s_name", "string"), Col("s_nationkey", "int"), Col("s_acctbal", "double")), keys=("s_suppkey",), managed=False)
NATION = TableSchema("nation", (Col("n_nationkey", "int"), Col("n_name", "string"), Col("n_regionkey", "int"), Col("updated_version", "bigint")), keys=("n_nationkey",), partition="n_regionkey", managed=False)
TALK = TableSchema("conversations", (Col("conv_id"), Col("turn"), Col("role", "string")), keys=("conv_id", "turn"), managed=False)
PARTS = EntitySchema("part", (Col("p_partkey"), Col("p_name", "string"), Col("p_brand", "string"), Col("p_type", "string"), Col("p_size", "int"), Col("p_retailprice", "double")), partition=(Col("p_type", "string"),), sort=(Col("p_size", "int").base(4), Col("p_partkey").base(8)), secondary={"s1": (Col("p_brand", "string"),)})

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> Table:
    return Table(ORDERS, read(spark, d, "orders"))


def baskets(spark: SparkSession, d: str) -> Table:
    own = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    return Table(BASKETS, own.groupBy("o_orderkey", "o_custkey").agg(F.collect_set("l_partkey").alias("parts")))


def day_of(ts: str):
    return F.unix_date(F.col(ts).cast("date"))


def events(spark: SparkSession, d: str) -> Table:
    kind = F.col("event_type")
    status = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(0)
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return Table(EVENTS, read(spark, d, "events").select("event_id", "user_id", status.alias("status"), version.alias("updated_version"), day_of("ts").alias("day"), (kind == "click").cast("int").alias("is_click")))


def versioned_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its number within its customer, as if every order had been a write of its own."""
    return read(spark, d, "orders").withColumn("updated_version", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))


def parts(spark: SparkSession, d: str) -> Table:
    return Table(PART, read(spark, d, "part").withColumns({"part": F.lit(1), "updated_version": F.lit(1)}))


def entity(spark: SparkSession, d: str) -> Entity:
    return Entity(PARTS, read(spark, d, "part"))


# The orders of SURVEY's operators: reads ------------------------------------------------------------------------


def q_filter_eq(s, d):
    return orders(s, d).query().eq("o_custkey", 7).select("o_orderkey", "o_totalprice").df()


def q_filter_ranges(s, d):
    q = orders(s, d).query().ge("o_custkey", 10).lt("o_custkey", 20).gt("o_totalprice", 1000).le("o_totalprice", 200000)
    return q.select("o_orderkey").df()


def q_filter_in_between(s, d):
    return orders(s, d).query().isin("o_custkey", [1, 2, 3]).between("o_orderkey", 100, 9000).select("o_orderkey", "o_custkey").df()


def q_filter_ne(s, d):
    specs = [{"column": "o_orderstatus", "op": "!=", "value": "F"}, {"column": "o_custkey", "op": "=", "value": 7}]
    return orders(s, d).query().where_spec(specs).select("o_orderkey").df()


def q_contains(s, d):
    return baskets(s, d).query().contains("parts", 5).select("o_orderkey").df()


def q_begins_with(s, d):
    return parts(s, d).query().begins_with("p_name", "blue").select("p_partkey", "p_name").df()


def q_select_exclude(s, d):
    return orders(s, d).query().eq("o_custkey", 7).exclude("o_totalprice", "o_orderdate").df()


def q_order_desc_limit(s, d):
    return orders(s, d).query().eq("o_custkey", 7).select("o_orderkey").order_desc().limit(5).df()


def q_groupby_single(s, d):
    return Table(LINEITEM, read(s, d, "lineitem")).query().eq("l_suppkey", 3).group_by("l_returnflag", qty=sum_("l_linenumber")).df()


def q_groupby_multi(s, d):
    q = Table(LINEITEM, read(s, d, "lineitem")).query().isin("l_suppkey", [1, 2]).gt("l_linenumber", 3)
    out = q.group_by("l_suppkey", "l_linenumber", s=sum_("l_partkey"), m=max_("l_orderkey"), a=avg("l_quantity")).df()
    return out.withColumn("a", F.round("a", 6))


def q_packed_roundtrip(s, d):
    packed = encode.pack([F.col("o_custkey"), F.col("o_orderkey")], [6, 9])
    c0, c1 = encode.unpack(F.col("packed"), [6, 9])
    return read(s, d, "orders").select(packed.alias("packed")).select("packed", c0.alias("c0"), c1.alias("c1"))


def q_packed_range(s, d):
    """Through a layout that is packed by order key: the exact predicate and its range on the stored key."""
    t = orders(s, d)
    source = next(x for x in t.compiled.sources if x.kind == "packed_local")
    return t.with_layouts({source.name: layouts.layout(t, source)}).query().eq("o_custkey", 7).ge("o_orderkey", 100).select("o_orderkey").df()


def q_fnv_hash(s, d):
    return read(s, d, "orders").select("o_orderkey", encode.hash_tuple([F.col("o_custkey"), F.col("o_orderkey")]).alias("h"))


def q_ordered_base64(s, d):
    return read(s, d, "orders").select("o_orderkey", encode.ordered64(F.col("o_orderkey"), 8).alias("k"))


def q_base62(s, d):
    return read(s, d, "orders").select("o_custkey").distinct().select("o_custkey", encode.base62(F.col("o_custkey")).alias("tok"))


def q_week_code(s, d):
    """The code has two digits for the year; its Monday is that of the century from 2000 on."""
    code = encode.week_code(F.col("o_orderdate")).cast("bigint")
    return read(s, d, "orders").select(code.alias("wk")).distinct().select("wk", encode.week_monday(F.col("wk")).cast("bigint").alias("monday"))


def q_view_explode(s, d):
    t = baskets(s, d)
    source = next(x for x in t.compiled.sources if x.kind == "exploded")
    return layouts.layout(t, source).select("o_custkey", F.col("parts").alias("part"), "o_orderkey")


def q_view_explode_eq(s, d):
    t = baskets(s, d)
    source = next(x for x in t.compiled.sources if x.kind == "exploded")
    return t.with_layouts({source.name: layouts.layout(t, source)}).query().contains("parts", 5).lt("o_custkey", 500).select("o_orderkey").df()


def q_bucket_range(s, d):
    """A range of days through buckets of days: a close cover first, then the exact range."""
    kinds = events(s, d)
    low, high = 19725, 19734
    index = kinds.compiled.bucketed[0]
    per_kind = [layouts.bucket_filter(index, low, high, {"is_click": k}) for k in (0, 1)]
    hashed = layouts.bucket_hashes(kinds.data, kinds.compiled, index).where(per_kind[0] | per_kind[1])
    return kinds.via(hashed).query().eq("user_id", 7).between("day", low, high).select("event_id").df()


def q_delta_first(s, d):
    out = events(s, d).query().eq("user_id", 7).select("user_id", "event_id", "status", "updated_version").delta(0, 1).df()
    return out.withColumnRenamed("updated_version", "upv")


def q_delta_next(s, d):
    out = events(s, d).query().eq("user_id", 7).select("user_id", "event_id", "status", "updated_version").delta(10, 1).df()
    return out.withColumnRenamed("updated_version", "upv")


def q_slot_versions(s, d):
    out = incremental.slot_versions(versioned_orders(s, d), "o_custkey", "o_orderkey")
    return out.select("part", F.col("slot").cast("bigint").alias("slot"), F.col("ver").cast("bigint").alias("ver"))


CACHED = TableSchema("orders", (Col("o_orderkey"), Col("o_custkey"), Col("updated_version", "int")), keys=("o_orderkey",), partition="o_custkey", table_id=1, managed=False, save_version=True)


def q_cached_ids(s, d):
    """Even ids claim the version that their slot has, odd ones claim none."""
    own = versioned_orders(s, d).select("o_orderkey", "o_custkey", "updated_version")
    slots = incremental.slot_versions(own, "o_custkey", "o_orderkey")
    claims = own.select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("id"), encode.slot_of(F.col("o_orderkey")).alias("slot")).join(slots, ["part", "slot"])
    claims = claims.select("part", "id", F.when(F.col("id") % 2 == 0, F.col("ver")).otherwise(F.lit(0)).alias("ver"))
    out = incremental.cached_ids(Table(CACHED, own), claims, slots, ["o_orderkey"])
    return out.select("o_orderkey", F.col("updated_version").cast("bigint").alias("upv"))


def q_generic_records(s, d):
    return incremental.generic_records(parts(s, d))


def q_group_hashes(s, d):
    t = events(s, d)
    found = groups.group_freshness(t.data, t.compiled, ["day", "is_click"])
    return found.select(F.col("part").alias("user_id"), F.col("v_day").cast("bigint").alias("d"), F.col("v_is_click").alias("k"), F.col("upc").cast("bigint").alias("upc"))


def q_index_group(s, d):
    t = events(s, d)
    freshness = groups.group_freshness(t.data, t.compiled, ["day", "is_click"])
    query = t.query().eq("user_id", 7).eq("is_click", 1).between("day", 19725, 19734)
    found = groups.query_group(query, freshness).where(F.size("records") > 0)
    return found.select(F.get("values", 0).alias("d"), F.size("records").cast("bigint").alias("n"))


# Writes ----------------------------------------------------------------------------------------------------------


def q_insert_upsert(s, d):
    t = Table(CUSTOMER, read(s, d, "customer"))
    rows = t.data.where("c_custkey < 10").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    return write.insert(t, rows).select("c_custkey", "c_acctbal")


def q_update_include(s, d):
    t = Table(CUSTOMER, read(s, d, "customer"))
    rows = t.data.where("c_nationkey = 3").select("c_custkey", F.lit("GOV").alias("c_mktsegment"), F.lit("ignored").alias("c_name"))
    return write.update(t, rows, ["c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


def q_merge(s, d):
    """Known keys are updated where a condition on the old row holds; rows without a key get one and are put in."""
    t = Table(CUSTOMER, read(s, d, "customer").withColumn("c_custkey", F.col("c_custkey") + 1))  # a key of 0 counts as unset
    known = t.data.where("c_custkey < 10").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit(None).cast("bigint").alias("s_suppkey"))
    fresh = read(s, d, "supplier").select(F.lit(0).cast("bigint").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), "s_suppkey")
    start = write.sequence_after(t.data, "c_custkey", []).select("current_value")
    number = lambda df: write.autoincrement(df, "c_custkey", [], ["s_suppkey"], start)
    return write.merge(t, known.unionByName(fresh), F.col("prev.c_acctbal") < 5000, number, ["c_acctbal"]).select("c_custkey", "c_acctbal")


def q_autoincrement(s, d):
    rows = read(s, d, "nation").withColumn("id", F.lit(0).cast("bigint"))
    return write.autoincrement(rows, "id", ["n_regionkey"], ["n_nationkey"]).select("n_nationkey", "n_regionkey", "id")


def q_updated_version(s, d):
    t = Table(NATION, read(s, d, "nation"))
    empty = s.createDataFrame([], "part int, ver bigint")
    return write.stamp(t.data, t.compiled, 0, versions=empty).select("n_nationkey", "n_regionkey", F.col("updated_version").cast("int").alias("upv"))


def q_empty_to_null(s, d):
    own = read(s, d, "conversations").select("conv_id", "turn", "role")
    return write.insert(Table(TALK, own), own.where("turn = 0").withColumn("role", F.lit("")))


def q_delete(s, d):
    t = Table(SUPPLIER, read(s, d, "supplier"))
    return write.delete(t, t.data.where("s_nationkey = 3").select("s_suppkey")).select("s_suppkey")


def q_reset_counter(s, d):
    return admin.reset_counter(orders(s, d))


# Text, entities, queries as data -----------------------------------------------------------------------------------


def q_normalize_text(s, d):
    return read(s, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))


def q_text_search(s, d):
    index = search.postings(search.search_text(parts(s, d)))
    return search.search_ids(index, 1, "Blue bolt")


def q_single_table_query(s, d):
    return entity(s, d).query().eq("p_type", "ECONOMY").between("p_size", 5, 20).gte("p_retailprice", 910).df().select("p_partkey")


def q_single_table_gsi(s, d):
    return entity(s, d).query().eq("p_brand", "Brand#2").df().select("p_partkey")


def q_topn(s, d):
    return entity(s, d).top_n(10, "ECONOMY").select("p_partkey")


def q_dynamic_json(s, d):
    spec = {"filters": [{"column": "OCustkey", "op": "between", "from": 1, "to": 3}, {"column": "o_orderstatus", "op": "=", "value": "O"}], "select": ["o_orderkey"]}
    return admin.query_json(orders(s, d), spec).df()


PO = "WITH po AS (SELECT o.o_orderkey, o.o_custkey, list(DISTINCT l.l_partkey) AS parts FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL) "
EV = """WITH ev AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
 WHEN 'signup' THEN 4 ELSE 0 END AS status, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS upv FROM events) """
OV = "WITH ov AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)"
SL = "SELECT o_custkey AS part, o_orderkey % 256 AS slot, max(rn) AS ver FROM ov GROUP BY ALL"


def sql_fnv(*columns: str) -> str:
    octets = ", ".join(", ".join([f"({c} >> {8 * i}) & 255" for i in range(8)] + ["0"]) for c in columns)
    return f"list_reduce([2166136261::BIGINT, {octets}], lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


def sql_ordered64(c: str, width: int) -> str:
    return " || ".join(f"substr('{encode.ORDERED64}', (({c} >> {6 * i}) & 63)::INT + 1, 1)" for i in range(width - 1, -1, -1))


def sql_base62(c: str) -> str:
    digits = " || ".join(f"substr('{encode.BASE62}', (({c} // {62**i}) % 62)::INT + 1, 1)" for i in range(3, -1, -1))
    return f"CASE WHEN {c} <= 0 THEN '' ELSE ltrim({digits}, '0') END"


def sql_normalize(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({x}), 'áàäâéèëêíìïîóòöôúùüûñ', 'aaaaeeeeiiiioooouuuun'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


DAY = "datediff('day', DATE '1970-01-01', ts::DATE)"
SQL = {
    "q_filter_eq": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7",
    "q_filter_ranges": "SELECT o_orderkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 20 AND o_totalprice > 1000 AND o_totalprice <= 200000",
    "q_filter_in_between": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 3) AND o_orderkey BETWEEN 100 AND 9000",
    "q_filter_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey = 7",
    "q_contains": PO + "SELECT o_orderkey FROM po WHERE list_contains(parts, 5)",
    "q_begins_with": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%'",
    "q_select_exclude": "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders WHERE o_custkey = 7",
    "q_order_desc_limit": "SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 5",
    "q_groupby_single": "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS qty FROM lineitem WHERE l_suppkey = 3 GROUP BY 1",
    "q_groupby_multi": "SELECT l_suppkey, l_linenumber, sum(l_partkey)::BIGINT AS s, max(l_orderkey) AS m, round(avg(l_quantity), 6) AS a FROM lineitem WHERE l_suppkey IN (1, 2) AND l_linenumber > 3 GROUP BY 1, 2",
    "q_packed_roundtrip": "SELECT o_custkey * 1000000000 + o_orderkey AS packed, o_custkey AS c0, o_orderkey AS c1 FROM orders",
    "q_packed_range": "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderkey >= 100",
    "q_fnv_hash": f"SELECT o_orderkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END::INTEGER AS h FROM (SELECT o_orderkey, {sql_fnv('o_custkey', 'o_orderkey')} AS h FROM orders)",
    "q_ordered_base64": f"SELECT o_orderkey, {sql_ordered64('o_orderkey', 8)} AS k FROM orders",
    "q_base62": f"SELECT o_custkey, {sql_base62('o_custkey')} AS tok FROM (SELECT DISTINCT o_custkey FROM orders)",
    "q_week_code": "SELECT wk, datediff('day', DATE '1970-01-01', date_trunc('week', make_date(2000 + wk // 100, 1, 4))::DATE) + (wk % 100 - 1) * 7 AS monday FROM (SELECT DISTINCT (isoyear(o_orderdate) % 100) * 100 + week(o_orderdate) AS wk FROM orders)",
    "q_view_explode": "SELECT DISTINCT o.o_custkey, l.l_partkey AS part, o.o_orderkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey",
    "q_view_explode_eq": PO + "SELECT o_orderkey FROM po WHERE list_contains(parts, 5) AND o_custkey < 500",
    "q_bucket_range": "SELECT event_id FROM events WHERE user_id = 7 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-12'",
    "q_delta_first": EV + "SELECT user_id, event_id, status, upv FROM ev WHERE user_id = 7 AND status IN (1) AND upv >= 1",
    "q_delta_next": EV + "SELECT user_id, event_id, status, upv FROM ev WHERE user_id = 7 AND status IN (0, 1, 2, 3, 4) AND upv >= 11",
    "q_slot_versions": f"{OV} SELECT part, slot, CASE WHEN ver % 65536 = 0 THEN 1 ELSE ver % 65536 END AS ver FROM ({SL})",
    "q_cached_ids": f"{OV}, s AS ({SL}) SELECT o.o_orderkey, s.ver AS upv FROM ov o JOIN s ON s.part = o.o_custkey AND s.slot = o.o_orderkey % 256 WHERE o.o_orderkey % 2 = 1",
    "q_generic_records": 'SELECT p_partkey AS "ID", p_name AS nm, p_brand AS s1, p_type AS s2, p_size AS n1 FROM part',
    "q_group_hashes": f"WITH e AS (SELECT user_id, {DAY} AS d, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events) SELECT user_id, d, k, max(v) AS upc FROM e GROUP BY ALL",
    "q_index_group": f"SELECT {DAY} AS d, count(*) AS n FROM events WHERE user_id = 7 AND event_type = 'click' AND ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' GROUP BY 1",
    "q_insert_upsert": "SELECT c_custkey, CASE WHEN c_custkey < 10 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer",
    "q_update_include": "SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN 'GOV' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "q_merge": "SELECT c_custkey + 1 AS c_custkey, CASE WHEN c_custkey + 1 < 10 AND c_acctbal < 5000 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT (SELECT max(c_custkey) + 1 FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_acctbal FROM supplier",
    "q_autoincrement": "SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS id FROM nation",
    "q_updated_version": "SELECT n_nationkey, n_regionkey, 1 AS upv FROM nation",
    "q_empty_to_null": "SELECT conv_id, turn, CASE WHEN turn <> 0 THEN role END AS role FROM conversations",
    "q_normalize_text": f"SELECT doc_id, {sql_normalize('text')} AS t FROM documents",
    "q_text_search": f"WITH tok AS (SELECT p_partkey, unnest(string_split({sql_normalize('p_name')}, ' ')) AS w FROM part) SELECT p_partkey AS id, count(DISTINCT w)::DOUBLE AS weight FROM tok WHERE w IN ('blue', 'bolt') GROUP BY 1 HAVING count(DISTINCT w) = 2",
    "q_single_table_query": "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 20 AND p_retailprice >= 910",
    "q_single_table_gsi": "SELECT p_partkey FROM part WHERE p_brand = 'Brand#2'",
    "q_topn": "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' ORDER BY p_size, p_partkey LIMIT 10",
    "q_dynamic_json": "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 1 AND 3 AND o_orderstatus = 'O'",
    "q_delete": "SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3",
    "q_reset_counter": "SELECT o_custkey, max(o_orderkey) AS current_value FROM orders GROUP BY 1",
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).query().eq("o_custkey", 7).between("o_orderkey", 100, 9000).select("o_orderkey", "o_totalprice", "o_orderstatus").order_desc().limit(5).df()
