"""The registered queries against DuckDB SQL over the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm.queries import QUERIES, SQL

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS FROM '{TABLES}/{table}.parquet'")
    want = con.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = sorted(range(len(want.description)), key=lambda i: want.description[i][0])
    want = sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
    got = QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want
