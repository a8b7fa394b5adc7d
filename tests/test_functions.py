import datetime
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import encode as E
from keyloom.functions import text
from keyloom.functions.types import BY_ID, type_of


def column(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_types():
    assert type_of("int32").spark == "int" and type_of("*int64").nullable and type_of("[]string").element == "string"
    assert type_of("map[string]int").id == 9 and type_of("uint16").spark == "int"
    assert BY_ID[33].spark == "array<int>" and BY_ID[33].nullable


def test_pack_and_unpack(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(100), rng.randrange(10**5), rng.randrange(10**9)) for _ in range(200)] + [(0, 0, 0), (123, 4, 1234567890)]
    c0, c1, c2 = E.unpack(F.col("p"), [2, 4, 8])
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").withColumn("p", E.pack([F.col("a"), F.col("b"), F.col("c")], [2, 4, 8]))
    for r in df.select("a", "b", "c", "p", c0.alias("x"), c1.alias("y"), c2.alias("z")).collect():
        assert r.p == E.pack_value((r.a, r.b, r.c), [2, 4, 8]) and [r.x, r.y, r.z] == E.unpack_value(r.p, [2, 4, 8])
    assert E.unpack_value(E.pack_value([31, 4567], [4, 10]), [4, 10]) == [31, 4567]
    assert E.pack_value([9, 38768176], [1, 8]) == 938768176
    assert E.key_slots([4, 6, 0]) == [4, 6, 8]
    with pytest.raises(Exception, match="negative"):
        column(spark, [(-1,)], "a bigint", E.pack([F.col("a")], [3]))
    with pytest.raises(E.EncodeError):
        E.pack([F.lit(1)], [19])


def test_text_keys(spark):
    rng = random.Random(42)
    values = [0, 1, 61, 62, 63, 3843, 3844, 2**40, 2**63 - 1] + [rng.randrange(2**63) for _ in range(200)]
    rows = column(spark, [(v,) for v in values], "v bigint", "v", E.base62(F.col("v")), E.ordered64(F.col("v"), 11), E.csv64(F.col("v")), E.from_csv64(E.csv64(-F.col("v"))))
    for v, b62, o64, c64, back in rows:
        assert b62 == E.base62_value(v) and o64 == E.ordered64_value(v, 11) and c64 == E.csv64_value(v) and back == -v
        assert E.ordered64_decode(o64) == v and E.csv64_decode(c64) == v
    assert [r[2] for r in sorted(rows)] == sorted(r[2] for r in rows)
    with pytest.raises(Exception, match="does not fit"):
        column(spark, [(4096,)], "v bigint", E.ordered64(F.col("v"), 1))
    with pytest.raises(E.EncodeError):
        E.ordered64_value(4096, 1)
    assert column(spark, [(5, "ab"), (0, "x"), (7, "")], "n bigint, s string", E.concat_key([(F.col("n"), "bigint"), (F.col("s"), "string")])) == [("5_ab",), ("_x",), ("7",)]
    key = E.composite_key([E.ordered64(F.lit(v), w) for v, w in ((5, 2), (300, 3), (70000, 6), (2**40, 11), (4000000000, 6))])
    assert column(spark, [(1,)], "i int", key)[0][0] == "#".join(E.ordered64_value(v, w) for v, w in ((5, 2), (300, 3), (70000, 6), (2**40, 11), (4000000000, 6)))
    with pytest.raises(Exception, match="number sign"):
        column(spark, [("a#b",)], "s string", E.composite_key([F.col("s")]))


def test_hashes(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**15), 2**15), rng.choice(["", "a", "é日"])) for _ in range(200)]
    got = column(spark, rows, "a bigint, b smallint, s string", "a", "b", "s", E.hash_tuple([F.col("a"), F.col("b")]), E.hash_values([(F.col("a"), "bigint"), (F.col("b"), "smallint"), (F.col("s"), "string")]))
    for a, b, s, h, g in got:
        assert h == E.hash_tuple_value([a, b]) and g == E.hash_values_value([(a, "bigint"), (b, "smallint"), (s, "string")])
    assert E.fnv(b"") == 2166136261 and E.fnv(b"a") == 0xE40C292C


def test_weeks_times_and_slots(spark):
    for year in (2015, 2020, 2024, 2026):
        for week in (1, 20, 52):
            monday = datetime.date.fromisocalendar(year, week, 1)
            code = (year - 2000) * 100 + week
            ((day, index, back),) = column(spark, [(code, monday)], "c int, d date", E.week_monday(F.col("c")), E.week_index(E.week_code(F.col("d"))), E.week_code(F.col("d")))
            assert day == (monday - datetime.date(1970, 1, 1)).days and back == code and index == day // 7
    assert column(spark, [(0,), (2499,)], "c int", E.week_monday(F.col("c"))) == [(0,), (0,)]
    ((half, key, slot, v0, v1),) = column(spark, [(1,)], "i int", E.half_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")), E.slot_key(F.lit(5), 7), E.slot_of(F.lit(513)), E.stored_version(F.lit(65536)), E.stored_version(F.lit(65537)))
    assert half == (1704067200 - 10**9) // 2 and key == (5 << 14) | 7 and (slot, v0, v1) == (1, 1, 1)


def test_slot_keys_of_wide_partitions(spark):
    parts = [0, 131071, 131072, 900000, 2**31, -131073]
    got = column(spark, [(p,) for p in parts], "p bigint", E.slot_key(F.col("p"), 3))
    assert [k for (k,) in got] == [p * 16384 + 3 for p in parts]


def test_normalize(spark):
    cases = {"": "", "Hello World": "hello world", "  Foo--Bar  baz!!  ": "foobar baz", "123-abc.DEF": "123abcdef", "   ": "", "only_letters": "onlyletters", "Marca Za&Co": "marca zaco", "Jamón": "jamon", "CAÑA 100LTS": "cana 100lts", "Pingüino Ñandú": "pinguino nandu", "a b\x0bc": "a b c", "a - b": "a b"}
    for raw, got in column(spark, [(c,) for c in cases], "t string", "t", text.normalize(F.col("t"))):
        assert got == cases[raw] == text.normalize_value(raw), raw
    groups = column(spark, [(0,), (1,), (-1,), (127,)], "s int", text.status_group(F.col("s")))
    assert [g for (g,) in groups] == [0, 1, 1, 1] and text.bucket_name(57, 1) == "p57_s1" and text.bucket_name(-57, 0) == "p57_s0"
    assert [text.snake_case(x) for x in ("CompanyID", "UpdatedVersion", "ID", "S1")] == ["company_id", "updated_version", "id", "s1"]
