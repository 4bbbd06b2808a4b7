"""The contract queries of llm against their SQL in DuckDB, at sf0.001."""

import os

import pytest

from tessera.llm import contract

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = contract.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    sql = contract.oracle_sql()[name]
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql}) q").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
