"""Every contract query of the library against its SQL in DuckDB."""

import os

import pytest

from tessera import contract

DIR = os.environ.get("TESSERA_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def clean(v):
    return round(v, 9) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(map(clean, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert cols
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.execute("select {} from ({}) q".format(", ".join(f'"{c}"' for c in cols), sql)).fetchall()
    assert sorted(map(str, got)) == sorted(str(tuple(map(clean, r))) for r in want)
