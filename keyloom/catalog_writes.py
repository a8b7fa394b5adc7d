"""Queries over writes, entities, text search and administration."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.catalog import CACHED, CUSTOMER, LINEITEM, OV, PART, SL, entity, parts, read, sql_normalize, sql_ordered64, versioned_orders
from keyloom.catalog import orders as orders_table
from keyloom.functions import encode
from keyloom.operators import admin, incremental, search, write
from keyloom.operators.entity import Entity, EntitySchema
from keyloom.operators.query import Table, page
from keyloom.plans.predicates import QueryError
from keyloom.plans.schema import Col, FixedValues, Index, TableSchema, compile_table

NAMED = EntitySchema("part", (Col("p_partkey"), Col("p_name", "string"), Col("p_type", "string")), partition=(Col("p_type", "string"),), sort=(Col("p_name", "string"), Col("p_partkey").base(8)))
PEOPLE = EntitySchema("customer", (Col("c_custkey"), Col("c_name", "string"), Col("c_acctbal", "double")), partition=(Col("c_custkey"),))
SELLERS = EntitySchema("supplier", (Col("s_suppkey"), Col("s_name", "string"), Col("s_nationkey", "int")), partition=(Col("s_suppkey"),), autoincrement=True)
TIMED = TableSchema("region", (Col("r_regionkey", "int"), Col("r_name", "string")), keys=("r_regionkey",))
PLAIN_VERSION = TableSchema("region", (Col("r_regionkey", "int"), Col("r_name", "string"), Col("updated_version", "bigint")), keys=("r_regionkey",), managed=False)
GUARDED = TableSchema("orders", (Col("o_orderkey"), Col("o_custkey"), Col("kind", "int"), Col("updated_version", "bigint")), keys=("o_orderkey",), partition="o_custkey", managed=False, fixed=(FixedValues("kind", values=(0, 1)),), indexes=(Index((Col("kind", "int"),), "delta"),))


def customers(s: SparkSession, d: str) -> Table:
    return Table(CUSTOMER, read(s, d, "customer"))


# Reads -----------------------------------------------------------------------------------------------------------


def q_page(s, d):
    """A page of a partition in key order, after a key."""
    return page(orders_table(s, d), 7, 5, 1000).select("o_orderkey")


def q_point_get(s, d):
    return Entity(PEOPLE, read(s, d, "customer")).get(7).select("c_custkey", "c_name", "c_acctbal")


def q_first(s, d):
    return entity(s, d).query().eq("p_type", "ECONOMY").first().select("p_partkey", "p_size")


def q_scan_limit(s, d):
    return entity(s, d).take(10).agg(F.count(F.lit(1)).alias("n"))


def q_strict_dynamic(s, d):
    asked = [{"field": "p_type", "op": "eq", "value": "ECONOMY"}, {"field": "p_size", "op": "gte", "value": "20"}]
    return entity(s, d).query_records(asked, 50).select("p_partkey")


def q_entity_begins_with(s, d):
    return Entity(NAMED, read(s, d, "part")).query_records([{"field": "p_type", "op": "==", "value": "ECONOMY"}, {"field": "p_name", "op": "prefix", "value": "blue"}]).select("p_partkey", "p_name")


def q_entity_desc_limit(s, d):
    return entity(s, d).query().eq("p_type", "ECONOMY").gt("p_size", 10).desc().limit(7).df().select("p_partkey", "p_size")


def q_default_projection(s, d):
    return Table(LINEITEM, read(s, d, "lineitem")).query().eq("l_suppkey", 3).df()


def q_allow_scan(s, d):
    """A condition that no source binds is refused unless a scan is allowed."""
    q = orders_table(s, d).query().gt("o_totalprice", 400000).select("o_orderkey")
    try:
        q.allow_scan(False).df()
    except QueryError:
        return q.df()
    raise RuntimeError("the query was not refused")


def q_stream_rows(s, d):
    """Rows handed over one by one; a handler keeps those that it deals with itself."""
    q = orders_table(s, d).query().eq("o_custkey", 7).select("o_orderkey", "o_orderstatus")
    kept = [tuple(r) for r in q.rows(lambda r: r["o_orderstatus"] == "F")]
    return s.createDataFrame(kept, "o_orderkey bigint, o_orderstatus string")


def q_fetch_generic(s, d):
    """The flat records of the ids claimed at an old version."""
    t = parts(s, d)
    slots = incremental.slot_versions(t.data, "part", "p_partkey")
    claims = t.data.select("part", F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(9).alias("ver"))
    out = incremental.cached_generic(t, claims, slots)
    return out.select("ID", "nm", "s1", "s2", "n1", F.col("updated_version").alias("upv"))


def q_claims_last(s, d):
    """Ids that are claimed twice: the later claim counts; the records come in the order of their ids."""
    own = versioned_orders(s, d).select("o_orderkey", "o_custkey", "updated_version")
    slots = incremental.slot_versions(own, "o_custkey", "o_orderkey")
    known = own.select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("id"), encode.slot_of(F.col("o_orderkey")).alias("slot")).join(slots, ["part", "slot"])
    early = known.select("part", "id", F.lit(0).alias("ver"), F.lit(1).alias("at"))
    late = known.where("id % 5 <> 0").select("part", "id", "ver", F.lit(2).alias("at"))
    out = incremental.cached_ids(Table(CACHED, own), early.unionByName(late), slots, ["o_orderkey"], order="at", sort=True)
    return out.select("o_orderkey", F.col("updated_version").cast("bigint").alias("upv"))


# Writes ----------------------------------------------------------------------------------------------------------


def q_insert_repeated_key(s, d):
    """Each customer stands twice in one write: the row that is last in the order counts."""
    t = customers(s, d)
    rows = t.data.withColumn("at", F.lit(1)).unionByName(t.data.withColumn("c_acctbal", -F.col("c_acctbal")).withColumn("at", F.lit(2)))
    return write.insert(t, rows, order="at").select("c_custkey", "c_acctbal")


def q_insert_equal_rows(s, d):
    t = customers(s, d)
    fresh = t.data.withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return write.insert(t, fresh.unionByName(fresh)).select("c_custkey", "c_name")


def q_update_repeated_key(s, d):
    t = customers(s, d)
    rows = t.data.select("c_custkey", F.lit("A").alias("c_mktsegment"), F.lit(1).alias("at")).unionByName(t.data.where("c_custkey % 2 = 0").select("c_custkey", F.lit("B").alias("c_mktsegment"), F.lit(2).alias("at")))
    return write.update(t, rows, ["c_mktsegment"], order="at").select("c_custkey", "c_mktsegment")


def q_merge_repeated_key(s, d):
    t = customers(s, d)
    once = t.data.where("c_custkey BETWEEN 1 AND 99").select("c_custkey", F.lit(1.0).alias("c_acctbal"), F.lit(1).alias("at"))
    rows = once.unionByName(once.withColumns({"c_acctbal": F.lit(2.0), "at": F.lit(2)}))
    return write.merge(t, rows, F.col("prev.c_acctbal") < 5000, lambda df: df, ["c_acctbal"], order="at").select("c_custkey", "c_acctbal")


def q_update_exclude(s, d):
    t = customers(s, d)
    rows = t.data.where("c_custkey % 3 = 0").withColumns({"c_name": F.lit("x"), "c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("GOV")})
    return write.update_exclude(t, rows, ["c_name"]).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def q_insert_update(s, d):
    """Some rows are put in, the others change one column."""
    t = customers(s, d)
    new = t.data.where("c_custkey < 50").withColumns({"c_custkey": F.col("c_custkey") + 1_000_000, "fresh": F.lit(True)})
    old = t.data.where("c_custkey < 50").withColumns({"c_acctbal": F.lit(1.0), "c_name": F.lit("x"), "fresh": F.lit(False)})
    return write.insert_update(t, new.unionByName(old), F.col("fresh"), ["c_acctbal"]).select("c_custkey", "c_name", "c_acctbal")


def q_insert_or_update(s, d):
    t = customers(s, d)
    new = t.data.where("c_custkey < 50").withColumns({"c_custkey": F.col("c_custkey") + 1_000_000, "fresh": F.lit(True)})
    old = t.data.where("c_custkey < 50").withColumns({"c_acctbal": F.lit(1.0), "c_name": F.lit("x"), "fresh": F.lit(False)})
    return write.insert_or_update(t, new.unionByName(old), F.col("fresh"), ["c_name"]).select("c_custkey", "c_name", "c_acctbal")


def q_self_parse(s, d):
    """Rows are put right before they are written."""
    t = customers(s, d)
    return write.insert(t, t.data, parse=lambda df: df.withColumn("c_mktsegment", F.lower("c_mktsegment"))).select("c_custkey", "c_mktsegment")


def q_created_updated(s, d):
    """Rows that bring a time of creation keep it; all get the time of the write, which is an argument."""
    own = read(s, d, "region").withColumn("created", F.when(F.col("r_regionkey") < 2, 77).otherwise(0))
    return write.stamp(own, compile_table(TIMED), 4242).select("r_regionkey", "created", "updated")


def q_version_unpartitioned(s, d):
    """A table without a partition has one counter; the first write finds none."""
    t = Table(PLAIN_VERSION, read(s, d, "region"))
    first = write.stamp(t.data, t.compiled, 0, versions=s.createDataFrame([], "part int, ver bigint"))
    counters = write.next_versions(first, t.compiled)
    second = write.stamp(t.data.where("r_regionkey < 3"), t.compiled, 0, versions=counters)
    return first.unionByName(second).select("r_regionkey", "updated_version")


def q_next_versions(s, d):
    """Counters after a second write, to some partitions."""
    t = Table(GUARDED, read(s, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 2).cast("int").alias("kind")))
    first = write.next_versions(write.stamp(t.data, t.compiled, 0, versions=s.createDataFrame([], "part bigint, ver bigint")), t.compiled)
    again = write.stamp(t.data.where("o_custkey % 4 = 0"), t.compiled, 0, versions=first)
    return write.next_versions(again, t.compiled, first).select(F.col("part").alias("o_custkey"), "ver")


def q_autoincrement_global(s, d):
    """Numbers without gaps over a whole table, after those given out."""
    rows = read(s, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_id") + 1).otherwise(F.lit(0)).alias("id"))
    starts = s.createDataFrame([(1_000_000,)], "current_value bigint")
    return write.autoincrement(rows, "id", [], ["event_id"], starts).select("event_id", "id")


def q_autoincrement_suffix(s, d):
    """Numbers with random digits behind them; without these they are the sequence."""
    rows = read(s, d, "nation").withColumn("id", F.lit(None).cast("bigint"))
    out = write.autoincrement(rows, "id", ["n_regionkey"], ["n_nationkey"], random_digits=3, seed=5)
    both = out.withColumn("other", encode.with_suffix(F.col("n_nationkey"), 2, 9))
    return both.select("n_nationkey", F.floor(F.col("id") / 1000).cast("bigint").alias("sequence"), F.floor(F.col("other") / 100).cast("int").alias("other"))


def q_put_many(s, d):
    """New suppliers draw their keys from the sequence; one that is there is replaced."""
    t = Entity(SELLERS, read(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"))
    new = read(s, d, "nation").select(F.lit(0).cast("bigint").alias("s_suppkey"), F.col("n_name").alias("s_name"), F.col("n_nationkey").alias("s_nationkey"))
    old = t.data.where("s_suppkey = 5").withColumn("s_name", F.lit("renamed"))
    return t.put_many(new.unionByName(old), write.sequence_after(t.data, "s_suppkey", []), ["s_nationkey"]).data


def q_delete_all(s, d):
    kept, n = Entity(SELLERS, read(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")).delete_all()
    return kept.data.agg(F.count(F.lit(1)).alias("left")).withColumn("gone", F.lit(n).cast("bigint"))


def q_insert_json(s, d):
    records = [{"CCustkey": 1, "CName": "changed", "c_nationkey": 4, "CAcctbal": 1.5}, {"CCustkey": 9_000_001, "CName": "new", "c_nationkey": 4.0, "CAcctbal": 2}]
    return admin.insert_json(customers(s, d), json.dumps(records), 0).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


def q_update_json(s, d):
    records = [{"c_custkey": k, "c_name": "x", "c_acctbal": 0} for k in range(10)]
    return admin.update_json(customers(s, d), json.dumps(records), ["c_acctbal"], 0).select("c_custkey", "c_name", "c_acctbal")


# Administration --------------------------------------------------------------------------------------------------


def q_sequence_value(s, d):
    """Each table's counter, as the sequence reads back."""
    named = [("orders", "o_orderkey"), ("customer", "c_custkey")]
    kept = None
    for t, key in named:
        one = write.sequence_after(read(s, d, t), key, []).select(F.lit(t).alias("name"), "current_value")
        kept = one if kept is None else kept.unionByName(one)
    return s.createDataFrame([(t, admin.sequence_value(kept, t)) for t, _ in [*named, ("none", "")]], "name string, current_value bigint")


def q_describe(s, d):
    about = admin.describe(compile_table(PART))
    return s.createDataFrame([(c["name"], c["type"], c["id"]) for c in about["columns"]], "name string, type string, id int")


def q_entity_schema(s, d):
    about = entity(s, d).describe()
    rows = [(kind, k, c["name"]) for kind in ("partition", "sort") for k, c in enumerate(about[kind])] + [(slot, k, c["name"]) for slot, keys in about["secondary"].items() for k, c in enumerate(keys)]
    return s.createDataFrame(rows, "key string, place int, name string")


def q_deploy(s, d):
    """A column that is declared and not stored is added, as null; nothing goes."""
    t = compile_table(CUSTOMER)
    stored = read(s, d, "customer").drop("c_mktsegment").withColumn("extra", F.lit(1))
    return admin.deploy(t, stored).select("c_custkey", "c_mktsegment", "extra")


def q_reload(s, d):
    t = Table(TIMED, read(s, d, "region").withColumns({"created": F.lit(5), "updated": F.lit(5)}))
    return admin.reload(t, 99).select("r_regionkey", "r_name", "created")


def q_recalc_derived(s, d):
    """Derived columns computed anew; and the rows that had a wrong one."""
    t = Table(CUSTOMER, read(s, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "?").otherwise(F.lower("c_mktsegment"))))
    derived = {"c_mktsegment": F.when(F.col("c_nationkey") < 100, F.regexp_replace("c_name", "Customer", "C"))}
    every, changed = admin.recalc_derived(t, derived)
    return every.select("c_custkey", "c_mktsegment").join(changed.select("c_custkey", F.lit(True).alias("changed")), "c_custkey")


# Text ------------------------------------------------------------------------------------------------------------


def q_text_hydrate(s, d):
    """The records of a search, the heaviest first, then by id."""
    t = parts(s, d)
    index = search.postings(search.search_text(t))
    return search.search(t, index, 1, "blue bolt", limit=20, require_all=False).select("p_partkey", "p_name")


def _renamed(s: SparkSession, d: str) -> Table:
    t = parts(s, d)
    return t.via(t.data.where("p_partkey % 7 = 0").withColumn("p_name", F.lit("Écrou violet")))


def q_text_upsert(s, d):
    t = parts(s, d)
    index = search.upsert(search.postings(search.search_text(t)), _renamed(s, d))
    return search.search_ids(index, 1, "VIOLET").unionByName(search.search_ids(index, 1, "blue"))


def q_text_remove(s, d):
    t = parts(s, d)
    index = search.postings(search.search_text(t))
    return search.search_ids(search.remove(index, t.data.where("p_partkey % 2 = 0").select("part", F.col("p_partkey").alias("id"))), 1, "blue")


def q_text_flush(s, d):
    t = parts(s, d)
    halves = t.via(t.data.withColumn("part", (F.col("p_partkey") % 2).cast("int")))
    return search.search_ids(search.flush(search.postings(search.search_text(halves)), 1), None, "blue")


def q_text_changed(s, d):
    """Records whose normalised text is no longer the one indexed."""
    t = parts(s, d)
    later = t.via(t.data.withColumn("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.upper("p_name"))))
    return search.changed_texts(t, later).select(F.col("id").alias("p_partkey"))


def q_text_status_group(s, d):
    """Records of status 0 and the others are indexed in groups of their own."""
    t = parts(s, d)
    schema = TableSchema("part", (*PART.columns, Col("status", "int")), keys=PART.keys, partition=PART.partition, managed=False, text=PART.text)
    own = Table(schema, t.data.withColumn("status", (F.col("p_partkey") % 3).cast("int")))
    return search.search_ids(search.postings(search.search_text(own)), 1, "blue", group=1).select(F.col("id").alias("p_partkey"))


# Encodings -------------------------------------------------------------------------------------------------------


def q_hash_values(s, d):
    """The hash of an integer at its own width and a text."""
    return read(s, d, "supplier").select("s_suppkey", encode.hash_values([(F.col("s_nationkey"), "int"), (F.col("s_suppkey"), "bigint")]).alias("h"))


def q_composite_key(s, d):
    return read(s, d, "part").select("p_partkey", encode.composite_key([F.lit("part"), F.col("p_type"), encode.ordered64(F.col("p_size"), 4)]).alias("k"))


def q_csv64(s, d):
    coded = read(s, d, "orders").select("o_orderkey", encode.csv64(F.col("o_orderkey")).alias("k"))
    return coded.select("o_orderkey", "k", encode.from_csv64(F.col("k")).alias("back"))


def q_slot_keys(s, d):
    return read(s, d, "orders").select("o_orderkey", encode.slot_key(F.col("o_custkey"), 3).cast("bigint").alias("k"), encode.slot_of(F.col("o_orderkey")).cast("bigint").alias("slot"))


def q_half_seconds(s, d):
    return read(s, d, "events").select("event_id", encode.half_seconds(F.col("ts")).cast("bigint").alias("h"))


def q_group_ids(s, d):
    """Groups of columns get numbers of 16 bits from their names."""
    schema = TableSchema("t", (Col("a"), Col("b", "int"), Col("c", "int")), keys=("a",), managed=False, indexes=(Index((Col("b", "int"), Col("c", "int")), group=True), Index((Col("c", "int"),), group=True)))
    return s.createDataFrame([("_".join(k), v) for k, v in compile_table(schema).group_ids.items()], "name string, id int")


def octets(c: str, width: int) -> str:
    return ", ".join([f"({c} >> {8 * i}) & 255" for i in range(width)] + ["0"])


HASHED = f"list_reduce([2166136261::BIGINT, {octets('s_nationkey::BIGINT', 4)}, {octets('s_suppkey', 8)}], lambda h, x: (xor(h, x) * 16777619) & 4294967295)"
DIGITS = " || ".join(f"substr('{encode.CSV64}', ((o_orderkey >> {6 * i}) & 63)::INT + 1, 1)" for i in range(4, -1, -1))
WORDS = f"SELECT p_partkey, unnest(string_split({sql_normalize('p_name')}, ' ')) AS w FROM part"
BLUE = f"SELECT DISTINCT p_partkey FROM ({WORDS}) WHERE w = 'blue'"


def name_hash(name: str) -> int:
    n = encode.basic_hash(name) & 0xFFFF
    return n - 65536 if n >= 32768 else n


SQL = {
    "q_page": "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderkey > 1000 ORDER BY o_orderkey LIMIT 5",
    "q_point_get": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7",
    "q_first": "SELECT p_partkey, p_size FROM part WHERE p_type = 'ECONOMY' ORDER BY p_size, p_partkey LIMIT 1",
    "q_scan_limit": "SELECT least(10, count(*)) AS n FROM part",
    "q_strict_dynamic": "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size >= 20 ORDER BY p_size, p_partkey LIMIT 50",
    "q_entity_begins_with": "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_name LIKE 'blue%' ORDER BY p_name, p_partkey LIMIT 400",
    "q_entity_desc_limit": "SELECT p_partkey, p_size FROM part WHERE p_type = 'ECONOMY' AND p_size > 10 ORDER BY p_size DESC, p_partkey DESC LIMIT 7",
    "q_default_projection": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_suppkey = 3",
    "q_allow_scan": "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000",
    "q_stream_rows": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'",
    "q_fetch_generic": 'SELECT p_partkey AS "ID", p_name AS nm, p_brand AS s1, p_type AS s2, p_size AS n1, 1::INTEGER AS upv FROM part WHERE p_partkey % 3 <> 0',
    "q_claims_last": f"{OV}, s AS ({SL}) SELECT o.o_orderkey, s.ver AS upv FROM ov o JOIN s ON s.part = o.o_custkey AND s.slot = o.o_orderkey % 256 WHERE o.o_orderkey % 5 = 0",
    "q_insert_repeated_key": "SELECT c_custkey, -c_acctbal AS c_acctbal FROM customer",
    "q_insert_equal_rows": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, c_name FROM customer",
    "q_update_repeated_key": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'B' ELSE 'A' END AS c_mktsegment FROM customer",
    "q_merge_repeated_key": "SELECT c_custkey, CASE WHEN c_custkey BETWEEN 1 AND 99 AND c_acctbal < 5000 THEN 2.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "q_update_exclude": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'GOV' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "q_insert_update": "SELECT c_custkey, c_name, CASE WHEN c_custkey < 50 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey < 50",
    "q_insert_or_update": "SELECT c_custkey, c_name, CASE WHEN c_custkey < 50 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey < 50",
    "q_self_parse": "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer",
    "q_created_updated": "SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN 77 ELSE 4242 END::INTEGER AS created, 4242::INTEGER AS updated FROM region",
    "q_version_unpartitioned": "SELECT r_regionkey, 1::BIGINT AS updated_version FROM region UNION ALL SELECT r_regionkey, 2 FROM region WHERE r_regionkey < 3",
    "q_next_versions": "SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS ver FROM orders",
    "q_autoincrement_global": "SELECT event_id, event_id + 1 AS id FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 1000000 + row_number() OVER (ORDER BY event_id) FROM events WHERE event_id % 4 <> 0",
    "q_autoincrement_suffix": "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS sequence, n_nationkey AS other FROM nation",
    "q_put_many": "SELECT s_suppkey, CASE WHEN s_suppkey = 5 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_nationkey), n_name, n_nationkey FROM nation",
    "q_delete_all": "SELECT 0::BIGINT AS left, count(*) AS gone FROM supplier",
    "q_insert_json": "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'changed' ELSE c_name END AS c_name, CASE WHEN c_custkey = 1 THEN 4 ELSE c_nationkey END::INTEGER AS c_nationkey, CASE WHEN c_custkey = 1 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT 9000001, 'new', 4, 2.0",
    "q_update_json": "SELECT c_custkey, c_name, CASE WHEN c_custkey < 10 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "q_sequence_value": "SELECT 'orders' AS name, max(o_orderkey) AS current_value FROM orders UNION ALL SELECT 'customer', max(c_custkey) FROM customer UNION ALL SELECT 'none', 0",
    "q_describe": "SELECT * FROM (VALUES ('p_brand', 'string', 1), ('p_name', 'string', 1), ('p_partkey', 'int64', 2), ('p_retailprice', 'float64', 7), ('p_size', 'int32', 3), ('p_type', 'string', 1), ('part', 'int32', 3), ('updated_version', 'int32', 3)) AS v(name, type, id)",
    "q_entity_schema": "SELECT * FROM (VALUES ('partition', 0, 'p_type'), ('sort', 0, 'p_size'), ('sort', 1, 'p_partkey'), ('s1', 0, 'p_brand')) AS v(key, place, name)",
    "q_deploy": "SELECT c_custkey, NULL::VARCHAR AS c_mktsegment, 1::INTEGER AS extra FROM customer",
    "q_reload": "SELECT r_regionkey, r_name, 5::INTEGER AS created FROM region",
    "q_recalc_derived": "SELECT c_custkey, replace(c_name, 'Customer', 'C') AS c_mktsegment, true AS changed FROM customer",
    "q_text_hydrate": f"SELECT p.p_partkey, p.p_name FROM part p JOIN (SELECT p_partkey, count(DISTINCT w) AS n FROM ({WORDS}) WHERE w IN ('blue', 'bolt') GROUP BY 1 ORDER BY n DESC, p_partkey LIMIT 20) h USING (p_partkey)",
    "q_text_upsert": f"SELECT p_partkey AS id, 1.0::DOUBLE AS weight FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 1.0 FROM ({BLUE}) WHERE p_partkey % 7 <> 0",
    "q_text_remove": f"SELECT p_partkey AS id, 1.0::DOUBLE AS weight FROM ({BLUE}) WHERE p_partkey % 2 = 1",
    "q_text_flush": f"SELECT p_partkey AS id, 1.0::DOUBLE AS weight FROM ({BLUE}) WHERE p_partkey % 2 = 0",
    "q_text_changed": "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0",
    "q_text_status_group": f"SELECT p_partkey FROM ({BLUE}) WHERE p_partkey % 3 <> 0",
    "q_hash_values": f"SELECT s_suppkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END::INTEGER AS h FROM (SELECT s_suppkey, {HASHED} AS h FROM supplier)",
    "q_composite_key": f"SELECT p_partkey, 'part#' || p_type || '#' || {sql_ordered64('p_size', 4)} AS k FROM part",
    "q_csv64": f"SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '0' ELSE ltrim({DIGITS}, '0') END AS k, o_orderkey AS back FROM orders",
    "q_slot_keys": "SELECT o_orderkey, o_custkey * 16384 + 3 AS k, o_orderkey % 256 AS slot FROM orders",
    "q_half_seconds": "SELECT event_id, (floor(epoch(ts))::BIGINT - 1000000000) // 2 AS h FROM events",
    "q_group_ids": f"SELECT * FROM (VALUES ('b_c', {name_hash('b_c')}), ('c', {name_hash('c')})) AS v(name, id)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


