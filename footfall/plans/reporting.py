"""Reports, audits and look-ups over the inputs and over the tables the jobs build.

Reports count distinct keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.functions import columns as C, rules
from footfall.operators import custtype, reports as O, returns as R
from footfall.params import DateWindow

CATEGORY = "first_visit_category"


def cust_type_profile(applications: DataFrame, years: DateWindow) -> DataFrame:
    """Distinct applications and customers per customer type."""
    recent = R.slice_window(applications, "tran_date", years)
    return (
        recent.groupBy("cust_type")
        .agg(F.expr("count(distinct appl_key) as app_count"), F.expr("count(distinct cust_id) as cust_count"))
        .orderBy(F.col("cust_type").asc_nulls_last())
    )


def multi_type_audit(lookup: DataFrame, key: str) -> DataFrame:
    """Customer types per key of a lookup; anything above 1 is a fault."""
    return O.multi_value_audit(lookup, key, "cust_type", "cust_type_count")


def customer_multi_type_audit(applications: DataFrame, years: DateWindow) -> DataFrame:
    """Customer types per customer over the latest applications."""
    return multi_type_audit(custtype.latest_application(applications, "cust_id", years), "cust_id")


def visit_timeline(traffic: DataFrame, visitor: object, years: DateWindow) -> DataFrame:
    """One visitor's visits in time order."""
    visits = O.rows_for(R.slice_window(traffic, "record_created_timestamp", years), "visitor_id", visitor)
    return visits.select(
        "visitor_id", "visit_id", "customer_id", F.col("created_at").alias("visit_time"), "record_created_timestamp"
    ).orderBy(F.col("visit_time").asc_nulls_last(), F.col("visit_id").asc_nulls_last())


def ita_by_type(
    ita: DataFrame,
    key: str,
    categories: tuple[str, ...] | None = (rules.ITA_STARTED, rules.ITA_APPROVED),
) -> DataFrame:
    """Keys per ITA category and customer type; ``categories=None`` keeps all."""
    only = {CATEGORY: categories} if categories else None
    return O.count_keys_by(ita, [CATEGORY, "cust_type"], key, only=only)


def pq_by_type(
    pq: DataFrame, key: str, categories: tuple[str, ...] | None = (rules.PQ_NO_HARD,)
) -> DataFrame:
    """Keys per PQ category and customer type; ``categories=None`` keeps all."""
    return ita_by_type(pq, key, categories)


def by_category(audience: DataFrame, key: str) -> DataFrame:
    """Keys per category."""
    return O.count_keys_by(audience, [CATEGORY], key)


def ita_other_reasons(ita: DataFrame, key: str) -> DataFrame:
    """Why ITA first visits have no stage, by funnel, most first."""
    reason = C.ita_other_reason("matched_first_visit_rows", "app_started", "soft_submitted")
    others = ita.filter(F.col(CATEGORY) == rules.ITA_OTHER).withColumn("other_reason", reason)
    dims = ["first_visit_funnel", "other_reason"]
    counts = O.count_keys_by(others, dims, key)
    return counts.orderBy(F.desc("visitor_count"), *dims)


def return_bucket_by_group(classified: DataFrame, key: str) -> DataFrame:
    """Keys per return bucket and audience group."""
    return O.count_keys_by(classified, ["return_bucket", "first_visit_group"], key, name="returning_visitors")


def later_submit_report(ita_later: DataFrame) -> DataFrame:
    """Per category: people, those who later hard-submitted, only soft-submitted, or neither."""
    def people(cond, name):
        return F.expr(f"count(if({cond}, 1, null)) as {name}")

    return (
        ita_later.groupBy(CATEGORY)
        .agg(
            F.expr("count(*) as total_people"),
            people("later_hard_submitted = 1", "later_hard_submit_people"),
            people("later_soft_submitted = 1 and later_hard_submitted = 0", "later_soft_submit_only_people"),
            people("later_soft_submitted = 0 and later_hard_submitted = 0", "neither_later_submit_people"),
        )
        .orderBy(CATEGORY)
    )
