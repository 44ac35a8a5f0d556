"""Every named query against DuckDB on the same tables."""

import importlib.util
import re
from pathlib import Path

import duckdb
import pytest
from conftest import DATA, ROOT

_spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry_module)
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
CORE = entry_module.QUERIES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    return connection


def _canonical(table):
    names = sorted(table.column_names)
    values = sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names), strict=True)))
    types = [(n, str(table.schema.field(n).type).replace("large_", "")) for n in names]
    return types, values


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, duck, name):
    table = QUERIES[name](spark, DATA)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin|BatchEvalPython", plan)
    # Python is left to XML records and to the whole-number sums of part means.
    assert "MapInArrow" not in plan or name in {"extract_parts", "extract_sections"} or "section_embedding" in plan
    found = _canonical(table.toArrow())
    expected = _canonical(duck.sql(ORACLES[name]).to_arrow_table())
    assert found[0] == expected[0]
    assert found[1] == expected[1]
    assert found[1]


def test_every_query_has_sql():
    assert set(CORE) <= set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
