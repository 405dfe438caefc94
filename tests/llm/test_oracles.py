"""Spark and DuckDB SQL side by side."""

import duckdb
import pytest

from wardlake.llm.oracles import ORACLES
from wardlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ", ".join(sorted(frame.columns))
    want = con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in frame.select(*sorted(frame.columns)).collect()]
    assert sorted(got) == sorted(want) and got
