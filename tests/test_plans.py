import random

import pytest

from keyloom.functions.encode import pack_value
from keyloom.plans import planner
from keyloom.plans.predicates import Pred, QueryError, from_specs
from keyloom.plans.schema import Col, FixedValues, GenericRecord, Index, Registry, SchemaError, TableSchema, compile_table, delta_slots

BASE = (Col("company_id", "int32"), Col("id", "int64"), Col("status", "int8"), Col("type", "int8"), Col("list_id", "int32"), Col("updated_version", "int32"), Col("name", "string"), Col("tags", "[]int32"), Col("price", "float64"), Col("date", "int16"))


def schema(**options):
    return TableSchema(**{"name": "t", "columns": BASE, "keys": ("id",), "partition": "company_id", "fixed": (FixedValues("status", values=(0, 1)), FixedValues("type", min=1, max=2)), **options})


C = {c.name: c for c in BASE}


@pytest.mark.parametrize(
    ("options", "said"),
    [
        ({"keys": ()}, "key is needed"),
        ({"columns": (*BASE, Col("id"))}, "declared twice"),
        ({"columns": (*BASE, Col("a").autoincrement(), Col("b").autoincrement(2))}, "one autoincrement"),
        ({"keys": ("name",), "int_packing": (C["status"].decimal_size(2), C["id"])}, "one bigint key"),
        ({"concat": ("status", "name")}, "one string key"),
        ({"indexes": (Index(),)}, "needs keys"),
        ({"indexes": (Index((C["date"],), inherit=True),)}, "group is needed"),
        ({"indexes": (Index((C["date"],), "local", partition="id"),)}, "another partition"),
        ({"indexes": (Index((C["date"].bucketing(2),),),)}, "two or three"),
        ({"indexes": (Index((C["date"].bucketing(2), C["status"].bucketing(3)),),)}, "one bucketed"),
        ({"indexes": (Index((C["name"], C["date"].bucketing(2)),),)}, "integers"),
        ({"indexes": (Index((C["status"], C["date"].bucketing(0)),),)}, "positive"),
        ({"indexes": (Index((C["tags"],), "view"),)}, "scalars"),
        ({"indexes": (Index((C["name"], C["date"].decimal_size(3)), "view"),)}, "integers"),
        ({"indexes": (Index((C["status"].int32(), C["date"].decimal_size(12)), "view"),)}, "too many digits"),
        ({"indexes": (Index((C["list_id"], Col("id")), "delta"),)}, "one key without"),
        ({"indexes": (Index((C["list_id"].int32(),), "delta"),)}, "32 bits"),
        ({"indexes": (Index((C["name"],), "delta"),)}, "no integer"),
        ({"fixed": (FixedValues("status"),)}, "needs values"),
        ({"fixed": (FixedValues("nope", max=3),)}, "unknown column"),
        ({"fixed": (FixedValues("status", max=3), FixedValues("status", max=2))}, "declared twice"),
        ({"fixed": (FixedValues("status", values=(-1, 2)),)}, "negative"),
        ({"fixed": (FixedValues("status", min=5, max=3),)}, "before it begins"),
        ({"save_version": True}, "table id"),
        ({"save_version": True, "table_id": 4, "columns": BASE[:5]}, "updated_version"),
        ({"generic": GenericRecord("name")}, "saved versions"),
        ({"generic": GenericRecord("price"), "save_version": True, "table_id": 4}, "wrong type"),
        ({"text": ("price",)}, "strings"),
    ],
)
def test_rules(options, said):
    with pytest.raises(SchemaError, match=said):
        compile_table(schema(**options))


def test_managed_columns_and_ids():
    t = compile_table(schema())
    assert {"created", "updated"} <= set(t.columns) and "created" not in t.visible
    assert "created" not in compile_table(schema(managed=False)).columns
    registry = Registry()
    registry.register(schema(table_id=9))
    with pytest.raises(SchemaError, match="table id 9"):
        registry.register(schema(name="u", table_id=9))
    assert registry.names() == ["t"]
    with pytest.raises(KeyError):
        registry.resolve("x")


def test_delta_slots():
    fixed = {f.column: f for f in schema().fixed}
    assert delta_slots("t", [C["status"], C["type"]], fixed) == ((1, 1, 8), True)
    assert delta_slots("t", [C["status"], C["list_id"]], fixed) == ((1, 8, 9), False)
    assert delta_slots("t", [C["type"], C["status"]], {**fixed, "type": FixedValues("type", max=30)}) == ((2, 1, 10), False)
    for s in (0, 1):
        preds = [Pred("status", "=", (s,)), Pred("type", "=", (1,))]
        assert planner.packed_bounds(["status", "type", "updated_version"], (1, 1, 8), preds) == [(s * 10**9 + 10**8, s * 10**9 + 2 * 10**8)]


def test_packed_bounds_hold_every_row():
    preds = [Pred("status", "=", (9,)), Pred("updated", ">=", (38768176,))]
    assert planner.packed_bounds(["status", "updated"], (2, 8), preds) == [(938768176, 1000000000)]
    assert planner.packed_bounds(["status", "updated"], (2, 8), [Pred("status", "=", (6,)), Pred("updated", ">=", (0,))]) == [(6 * 10**8, 7 * 10**8)]
    rng = random.Random(1)
    for _ in range(300):
        slots = (2, 3, 2)
        preds = []
        for k, c in enumerate("abc"[: rng.randint(1, 3)]):
            top = 10 ** slots[k] - 1
            op = rng.choice(["=", "IN", "<", "<=", ">", ">=", "BETWEEN"])
            n = {"IN": 2, "BETWEEN": 2}.get(op, 1)
            v = tuple(sorted(rng.randint(0, top) for _ in range(n)))
            preds.append(Pred(c, op, v))
        ranges = planner.packed_bounds("abc", slots, preds)
        hold = {"=": lambda x, v: x == v[0], "IN": lambda x, v: x in v, "<": lambda x, v: x < v[0], "<=": lambda x, v: x <= v[0], ">": lambda x, v: x > v[0], ">=": lambda x, v: x >= v[0], "BETWEEN": lambda x, v: v[0] <= x <= v[1]}
        for _ in range(60):
            row = {c: rng.choice([*(p.values[0] for p in preds if p.column == c), rng.randint(0, 10 ** slots[k] - 1)]) for k, c in enumerate("abc")}
            if all(hold[p.op](row[p.column], p.values) for p in preds):
                assert any(a <= pack_value([row[c] for c in "abc"], slots) < b for a, b in ranges)


def test_routes():
    t = compile_table(schema(indexes=(Index((C["status"], C["date"].decimal_size(5)), "view"), Index((C["name"],), "local"), Index((C["tags"],), "view_table"), Index((C["name"], C["price"]), "view"), Index((C["id"],), "view", partition="id"))))
    part = Pred("company_id", "=", (1,))
    route = lambda *p, wanted=("id",), **o: planner.plan(t, p, wanted, set(), **o)
    assert route(part).source.kind == "base"
    assert route(part, Pred("name", "=", ("x",))).source.kind == "local"
    r = route(part, Pred("status", "=", (1,)), Pred("date", ">", (3,)))
    assert r.source.kind == "packed" and r.priority == 399
    assert route(part, Pred("name", "=", ("x",)), Pred("price", "=", (1.0,))).source.kind == "hash"
    assert route(part, Pred("tags", "CONTAINS", (3,))).source.kind == "exploded"
    assert route(part, Pred("tags", "CONTAINS", (3,)), wanted=("tags",)).source.kind == "base"
    assert route(part, Pred("id", "=", (1,))).source.kind == "base"
    with pytest.raises(QueryError, match="allow a scan"):
        route(part, Pred("price", ">", (1.0,)), scan=False)
    with pytest.raises(QueryError, match="allow a scan"):
        route(Pred("status", "!=", (1,)), scan=False)
    fan = route(part, Pred("date", ">", (3,)))
    assert fan.source.kind == "packed" and fan.added == (Pred("status", "IN", (0, 1)),)
    assert route(part, Pred("date", ">", (3,)), Pred("id", "=", (7,))).source.kind == "base"


def test_specs():
    t = compile_table(schema())
    (p,) = from_specs(t, [{"column": "ListID", "op": " in ", "values": ["4", 5.0]}])
    assert p == Pred("list_id", "IN", (4, 5))
    for bad in ({"column": "list_id", "value": 1.5}, {"column": "status", "value": 300}, {"column": "list_id", "op": "in", "values": []}, {"column": "list_id", "op": "between", "from": 1}, {"column": "name", "value": 3}, {"column": "x", "value": 3}, {"column": "id", "op": "like", "value": 3}, {"column": "tags", "value": 3}, {"column": "id", "op": "contains", "value": 3}):
        with pytest.raises(QueryError):
            from_specs(t, [bad])


def test_buckets_cover_with_the_fewest():
    assert planner.plan_buckets(0, 7, [4, 8]) == [(8, 0)]
    assert planner.plan_buckets(4, 4, [1]) == [(1, 4)]
    assert planner.plan_buckets(5, 3, [2]) == [] and planner.plan_buckets(1, 3, []) == []
    rng = random.Random(3)
    for _ in range(200):
        low = rng.randrange(100)
        high, sizes = low + rng.randrange(30), rng.choice([[2, 6], [1, 4], [4, 8], [3]])
        cover = planner.plan_buckets(low, high, sizes)
        days = [d for size, b in cover for d in range(b * size, b * size + size)]
        if cover:
            assert set(range(low, high + 1)) <= set(days) and sum(d < low or d > high for d in days) <= sum(sizes) // len(sizes)


def test_group_plan():
    t = compile_table(schema(indexes=(Index((C["date"],), group=True), Index((C["date"], C["status"], C["tags"]), group=True))))
    part, span = Pred("company_id", "=", (1,)), Pred("date", "BETWEEN", (9, 7))
    assert len(planner.plan_group(t, [part, span]).keys) == 1
    preds = [part, span, Pred("status", "IN", (0, 1)), Pred("tags", "CONTAINS", (5,))]
    assert len(planner.plan_group(t, preds).keys) == 3
    assert len(planner.group_hashes(["date", "status", "tags"], preds)) == 6
    for bad in ([span], [part], [part, span, Pred("id", "BETWEEN", (1, 2))], [part, Pred("id", "BETWEEN", (1, 2))]):
        with pytest.raises(QueryError):
            planner.plan_group(t, bad)
