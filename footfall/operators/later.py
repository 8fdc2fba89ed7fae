"""Activity after the first visit day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.functions import columns as C

EVENTS = ("soft", "hard")


def with_later_activity(first: DataFrame) -> DataFrame:
    """Whether, when and how long after the first visit day a key submitted, in place of ``submit_days``.

    ``first`` holds one row per key with its submit days (submit_date, soft, hard), as ``visits.first_visits_and_days`` makes them: at most one for each
    day of the window. So nothing is joined or grouped.
    """
    kept = [c for c in first.columns if c != "submit_days"]
    dates = [f"first_later_{e}_submit_date" for e in EVENTS]
    after = "submit_date > to_date(first_interaction_time)"
    earliest = [
        F.expr(f"array_min(transform(filter(submit_days, d -> d.{after} and d.{e} = 1), d -> d.submit_date)) as {d}")
        for e, d in zip(EVENTS, dates)
    ]
    return first.select(*kept, *earliest).select(
        *kept,
        *[C.flag(f"{d} is not null").alias(f"later_{e}_submitted") for e, d in zip(EVENTS, dates)],
        *dates,
        *[
            C.days_between("first_interaction_time", d).alias(f"days_to_later_{e}_submit")
            for e, d in zip(EVENTS, dates)
        ],
    )
