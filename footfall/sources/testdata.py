"""Adapter: the generated test tables seen as the logical input tables.

A visitor is a customer, a visit an order, an interaction a line item. The
expressions are those of FIXTURES.md; ``oracle/statements.py`` states them again in SQL.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.functions import columns as C, rules
from footfall.params import DateWindow, Grain
from footfall.plans import jobs

# What each remainder stands for.
URLS = (
    "/offers/no-ding/lookup/30393",
    "/accounts/reapply",
    "/accounts/check-offers",
    "/accounts/get-started",
    "/Application/step1",
    "/affiliate/x",
    "/apply",
    "/accounts/offers",
    "/ppc/a",
    "/check-offers/###",
    "/prequalification",
    None,
    "http://h/prequalification",
    "/home",
)
FUNNELS = (*rules.FUNNEL_GROUPS[rules.ITA], *rules.FUNNEL_GROUPS[rules.PQ], "", None, " PQ_OMF ")
CUST_TYPES = ("NEW", "FORMER", " present ", None, "", "New")

# A line item is dated its line number in minutes after the order, less than a day.
LINE_ITEM_SLACK = timedelta(days=1)


def pick(values: tuple, index: str) -> str:
    """SQL for the value at ``index``, counting from 0."""
    items = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({items}), cast({index} + 1 as int))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(
    orders: DataFrame, lineitem: DataFrame, window: DateWindow | None = None, person: str | None = None
) -> DataFrame:
    """All interactions; with ``window`` or ``person``, those that these need (and possibly more).

    The date and the person of an interaction are computed, so a filter on them cannot reach the scan
    of the orders. The implied bounds on the order date and the customer can.
    """
    if person is not None:
        orders = orders.filter(F.col("o_custkey") == F.lit(person).try_cast("bigint"))
    if window:
        orders = orders.filter(C.in_window("o_orderdate", DateWindow(window.start - LINE_ITEM_SLACK, window.end)))
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_custkey as visitor_id",
        "cast(o_custkey as string) as person",
        "'c' || o_custkey as cookie_id",
        "if(o_orderkey % 53 <> 0, o_orderkey, null) as visit_id",
        "o_orderdate + make_dt_interval(0, 0, l_linenumber, 0) as interaction_date",
        f"{pick(FUNNELS, 'o_orderkey % 20')} as funnel",
        f"{pick(URLS, 'l_partkey % 14')} as gen_url",
        f"{pick(URLS, 'l_suppkey % 14')} as gen_url2",
        "case l_returnflag when 'R' then 1 when 'A' then 0 end as soft_submit_flag",
        "if(l_returnflag = 'R' and l_linestatus = 'F', 1, 0) as soft_approval_flag",
        "if(l_quantity >= 48, 1, 0) as hard_submit_flag",
        "if(o_orderkey % 10 = 7, 0, 1) as visitor_flag",
        "o_orderkey as appl_key",
    )


def applications(orders: DataFrame) -> DataFrame:
    """One application per order, and a renewed copy of every ninth.

    The copies come out of the same scan: an order is exploded into its versions.
    """
    first = (
        f"struct({pick(CUST_TYPES, 'o_orderkey % 6')} as cust_type, "
        "if(o_orderkey % 41 <> 0, o_orderdate, null) as appl_entry_dt)"
    )
    renewed = "struct('RENEWED' as cust_type, o_orderdate + interval '1' day as appl_entry_dt)"
    versions = f"explode(if(o_orderkey % 9 = 0, array({first}, {renewed}), array({first}))) as v"
    return orders.selectExpr("o_orderkey", "o_custkey", "o_orderdate", versions).selectExpr(
        "o_orderkey as appl_key",
        "cast(o_custkey as string) as cust_id",
        "v.cust_type as cust_type",
        "o_orderdate as tran_date",
        "v.appl_entry_dt as appl_entry_dt",
    )


def traffic_visits(events: DataFrame) -> DataFrame:
    """One traffic visit per event, with a customer id as dirty as real ones."""
    return events.selectExpr(
        "user_id as visitor_id",
        "event_id as visit_id",
        "case event_id % 4 when 0 then cast(user_id as string) when 1 then (user_id + 1) || '.0' "
        "when 2 then 'abc' end as customer_id",
        "ts as created_at",
        "ts + interval '1' day as record_created_timestamp",
    )


def returning_population(rows: DataFrame, grain: Grain) -> DataFrame:
    """Return bucket of every person, in the wording of the population table."""
    return jobs.return_buckets(rows, grain).select(grain.key, "return_bucket")


def cookie_summary(rows: DataFrame) -> DataFrame:
    return rows.select("cookie_id", "visitor_id").distinct()


def with_second_type(lookup: DataFrame) -> DataFrame:
    """The lookup with another customer type for every fifth visitor."""
    types = "explode(if(visitor_id % 5 = 0, array(cust_type, 'SECOND'), array(cust_type))) as cust_type"
    return lookup.selectExpr("visitor_id", "customer_id", "cust_id", types, "visit_date")
