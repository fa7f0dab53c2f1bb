"""Registered queries of the training-data operators against their SQL."""

import duckdb
import pytest

from graphquarry.llm import queries

from test_queries import SF, TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())
