"""Every registered query of the volume and table side runs, and equals its SQL on DuckDB."""

import os

import duckdb
import pytest

from lumenframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, tmp_path, name):
    out = str(tmp_path / "out")
    df = catalog.QUERIES[name](spark, SF)
    df.write.parquet(out)
    got = f"select {', '.join(sorted(df.columns))} from '{out}/*.parquet'"
    if name not in catalog.ORACLE_SQL:
        assert tables.sql(f"select count(*) from ({got})").fetchall()[0][0] > 0
        return
    tables.sql(f"create or replace table want as {catalog.ORACLE_SQL[name]}")
    want = f"select {', '.join(sorted(df.columns))} from want"
    assert sorted(df.columns) == sorted(c[0] for c in tables.sql("describe want").fetchall())
    assert tables.sql("select count(*) from want").fetchall()[0][0] > 0
    assert tables.sql(f"{want} except all {got}").fetchall() == []
    assert tables.sql(f"{got} except all {want}").fetchall() == []
