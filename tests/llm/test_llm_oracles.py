"""Every query with SQL against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest
from conftest import DATA

from corpusdrift.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, expected = QUERIES[name](spark, DATA).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(expected.column_names)
    names = sorted(found.column_names)
    kinds = [[str(t.schema.field(n).type).replace("large_", "") for n in names] for t in (found, expected)]
    assert kinds[0] == kinds[1]
    values = [sorted(map(repr, zip(*(t.column(n).to_pylist() for n in names), strict=True))) for t in (found, expected)]
    assert values[0] == values[1]
    assert values[0]
