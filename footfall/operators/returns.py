"""Return-visit operators: how soon and how intensely does a key come back?

Everything here is a chain of hash aggregations over fixed-width columns. Each one
combines on the map side before it shuffles, so a key that owns a third of all rows
is spread by (key, day, visit) first and reaches its own partition only as one row
per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import columns as C
from footfall.functions.rules import BucketRules
from footfall.params import DateWindow


def slice_window(df: DataFrame, ts: str, window: DateWindow) -> DataFrame:
    """Rows with ``start <= ts < end``; NULL timestamps are dropped."""
    return df.filter(C.in_window(ts, window))


def daily_visits(rows: DataFrame, key: str, ts: str = "interaction_date") -> DataFrame:
    """Distinct non-NULL visits per key and calendar day."""
    return rows.groupBy(key, F.expr(f"to_date({ts}) as visit_date")).agg(
        F.expr("count(distinct visit_id) as visit_id_count")
    )


def first_date(daily: DataFrame, key: str) -> DataFrame:
    """First active day per key."""
    return daily.groupBy(key).agg(F.expr("min(visit_date) as first_visit_date"))


def same_day_max(daily: DataFrame, key: str) -> DataFrame:
    """Most visits on any one day per key."""
    return daily.groupBy(key).agg(F.expr("max(visit_id_count) as max_visit_ids_in_day"))


def return_gap(daily: DataFrame, key: str) -> DataFrame:
    """Days from the first active day to the next one; keys with one day are left out."""
    return return_summary(daily, key).filter("min_return_gap is not null").select(key, "min_return_gap")


def return_summary(daily: DataFrame, key: str, *more: Column) -> DataFrame:
    """One row per key: same-day maximum, gap to the second active day, and ``more`` aggregates of its days.

    The nearest later day is the second day in order, so looking one day ahead
    replaces joining the days to themselves. A key has at most one row per day of
    the window here, so the window partition is bounded.
    """
    ahead = f"lead(visit_date) over (partition by {key} order by visit_date) as next_date"
    return (
        daily.selectExpr("*", ahead)
        .groupBy(key)
        .agg(
            F.expr("max(visit_id_count) as max_visit_ids_in_day"),
            F.expr("date_diff(min_by(next_date, visit_date), min(visit_date)) as min_return_gap"),
            *more,
        )
    )


def with_bucket(summary: DataFrame, buckets: BucketRules) -> DataFrame:
    """Add the return bucket."""
    return summary.withColumn("return_bucket", C.return_bucket("max_visit_ids_in_day", "min_return_gap", buckets))
