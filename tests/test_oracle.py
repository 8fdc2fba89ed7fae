"""Every registered query against DuckDB on the same parquet files."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import oracle
from footfall import queries as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(contract.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_oracle(spark, duck, name):
    ours = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(oracle.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(ours.columns) == sorted(columns)
    expected = Counter(tuple(row) for row in result.fetchall())
    actual = Counter(tuple(row) for row in ours.select(*columns).collect())
    assert sum(actual.values()) > 0
    assert actual == expected


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_types_match_oracle(spark, duck, name):
    ours = contract.queries()[name](spark, SF_DIR)
    described = duck.execute(f"describe {oracle.oracle_sql()[name]}").fetchall()
    assert {f.name: f.dataType.simpleString() for f in ours.schema.fields} == {r[0]: KINDS[r[1]] for r in described}
