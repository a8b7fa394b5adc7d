import __spark_entry__ as entry
import duckdb
import pytest
from keyloom import catalog, catalog_stored, catalog_writes

DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice", "o_orderstatus"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [*catalog.SQL, *catalog_stored.SQL, *catalog_writes.SQL])
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN"}
    duck_kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: kinds[t] for c, t in df.dtypes} == duck_kinds
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted((tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall()), key=key)
