"""The same oracle on data where one key holds a third of all rows, and keys are missing."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

BASE = "/root/testdata/sf0.001"
QUERIES = (
    "url_map_visitors",
    "return_bucket_detail_wide",
    "return_bucket_report",
    "visitor_cust_type",
    "customer_multi_type_audit",
    "person_cust_type",
    "repeat_visitors",
    "visitor_ita",
    "visitor_pq",
    "person_funnel_type",
    "person_pq",
    "person_ita_later",
    "visitor_cust_type_for",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="test data not present")


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A third of orders belong to one customer, of line items to one order, of events to one user."""
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    hot_order = f"(select min(o_orderkey) from '{BASE}/orders.parquet' where o_orderkey % 20 < 5 and o_orderkey % 53 <> 0 and o_orderdate >= '1996-03-01' and o_orderdate < '1996-06-01')"
    changed = {
        "orders": "* replace (case when hash(o_orderkey) % 3 = 0 then 7 when hash(o_orderkey) % 17 = 0 then null else o_custkey end as o_custkey)",
        "lineitem": f"* replace (case when hash(l_partkey, l_quantity, l_orderkey) % 3 = 0 then {hot_order} else l_orderkey end as l_orderkey)",
        "events": "* replace (case when hash(event_id) % 3 = 0 then 7 when hash(event_id) % 17 = 0 then null else user_id end as user_id)",
    }
    for name, columns in changed.items():
        con.execute(f"copy (select {columns} from '{BASE}/{name}.parquet') to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    yield str(folder), con
    con.close()


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
@pytest.mark.parametrize("name", QUERIES)
def test_skewed_data_matches_oracle(spark, skewed, name, broadcast):
    folder, con = skewed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        ours = contract.queries()[name](spark, folder)
        result = con.execute(contract.oracle_sql()[name])
        columns = [d[0] for d in result.description]
        expected = Counter(map(tuple, result.fetchall()))
        actual = Counter(map(tuple, ours.select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(expected.values()) > 0
    assert actual == expected
