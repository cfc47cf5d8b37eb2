"""Registered queries against their SQL in DuckDB on sf0.001; op1 and op3 are held against brute force in test_operators."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from floodplain.llm.queries import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op2_exact_topk", "op6_line_dedup", "op7_source_mixing", "op8_chat_rotation", "op10_html_text"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, str(SF))
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == sorted(map(str, found.fetchall()))
