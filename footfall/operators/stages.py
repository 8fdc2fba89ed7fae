"""What happened in the first visit of each key, and which stage that amounts to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import columns as C, rules


def ita_flags() -> dict[str, Column]:
    """Row-level 0/1 flags followed in an ITA first visit; ``_url`` is the lower-cased URL."""
    return {
        "app_started": F.when(C.any_like("_url", rules.APP_START_PATTERNS), 1).otherwise(0),
        "soft_submitted": C.flag("soft_submit_flag = 1"),
        "soft_approved": C.flag("soft_approval_flag = 1"),
        "hard_submitted": C.flag("hard_submit_flag = 1"),
    }


def with_ita_category(activity: DataFrame) -> DataFrame:
    """Add the ITA stage of the first visit."""
    stage = C.ita_category("first_visit_funnel", "app_started", "soft_submitted", "soft_approved", "hard_submitted")
    return activity.withColumn("first_visit_category", stage)


def with_pq_category(activity: DataFrame) -> DataFrame:
    """Add the PQ stage of the first visit and the reason when there is none."""
    reason = C.pq_other_reason("first_interaction_time", "first_visit_id", "matched_first_visit_rows")
    return activity.withColumn("other_reason", reason).select(
        *activity.columns,
        C.pq_category("other_reason", "hard_submitted").alias("first_visit_category"),
        "other_reason",
    )
