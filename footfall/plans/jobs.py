"""Jobs that classify, attribute and follow up visitors and persons.

Every job takes its input tables as DataFrames and returns a DataFrame; nothing
runs until the caller writes or reads the result. The same code serves the visitor
and the person grain. Where a job takes ``visits``, it takes the interactions, or the
visit summary that ``visit_summary`` makes of them for the same grain, and sees the
same rows either way.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from footfall.functions import columns as C, rules
from footfall.operators import custtype, later, reports, returns as R, stages, visits as V
from footfall.params import VISITOR, Grain


def url_map_visitors(interactions: DataFrame, url_rules=rules.URL_RULES) -> DataFrame:
    """Distinct visitors per page label, most first."""
    label = C.first_like("_url", url_rules, "gen_url2")
    counts = (
        interactions.selectExpr("visitor_id", "gen_url2", "lower(gen_url2) as _url")
        .select(label.alias("url_mapping"), "visitor_id")
        .groupBy("url_mapping")
        .agg(F.expr("count(distinct visitor_id) as visitor_count"))
    )
    return counts.orderBy(F.desc("visitor_count"), F.col("url_mapping").asc_nulls_last())


def recent_offer_cookies(
    interactions: DataFrame, as_of: date, days: int = 30, pattern: str = rules.OFFER_PAGE_PATTERN
) -> DataFrame:
    """Cookies and times that saw an offer page within ``days`` before ``as_of``."""
    since = C.midnight(as_of - timedelta(days=days))
    seen = f"interaction_date >= {since} and {C.matches('lower(gen_url2)', pattern)}"
    return interactions.filter(seen).select("cookie_id", "interaction_date").distinct()


def _known(interactions: DataFrame, grain: Grain) -> DataFrame:
    """Rows inside the window that have an identity."""
    rows = R.slice_window(interactions, "interaction_date", grain.window)
    return rows.filter(f"{grain.key} is not null")


def visit_summary(interactions: DataFrame, grain: Grain) -> DataFrame:
    """The interactions of the window, by key, day, visit, funnel and visitor flag; one scan that serves all jobs of the grain."""
    return V.visits_of(interactions, grain)


def return_buckets(visits: DataFrame, grain: Grain = VISITOR) -> DataFrame:
    """Return bucket of every key seen in the window."""
    key = grain.key
    daily = V.daily_visits(visits, key) if V.is_summary(visits) else R.daily_visits(_known(visits, grain), key)
    return R.with_bucket(R.return_summary(daily, key), grain.buckets)


def return_bucket_detail(visits: DataFrame, grain: Grain = VISITOR) -> DataFrame:
    """Return bucket of the keys that came back."""
    return return_buckets(visits, grain).filter(
        f"return_bucket not ilike {C.text(rules.NO_REPEAT_VISITOR_PATTERN)}"
    )


def return_bucket_report(visits: DataFrame, grain: Grain = VISITOR) -> DataFrame:
    """Formatted number of keys per return bucket, and their total."""
    counts = return_buckets(visits, grain).groupBy("return_bucket").agg(
        F.count(grain.key).alias("visitor_count")
    )
    total = reports.with_total(counts, "return_bucket", "visitor_count")
    return reports.formatted(total, "visitor_count").orderBy("return_bucket")


def repeat_visitors(visits: DataFrame, grain: Grain = VISITOR) -> DataFrame:
    """Keys that came back, with return bucket, first touch and audience group.

    Days carry their earliest visit along, so buckets and first touch come out of the same grouping.
    """
    daily = (
        V.visits_of(visits, grain)
        .groupBy(grain.key, F.col("day").alias("visit_date"))
        .agg(F.expr("count(distinct visit_id) as visit_id_count"), V.touch(grain.trim_funnel))
    )
    summary = R.return_summary(daily, grain.key, F.expr("min(touch) as touch"))
    returned = R.with_bucket(summary, grain.buckets).filter(F.col("return_bucket") != grain.buckets.none)
    return returned.select(grain.key, "return_bucket", *V.touched(grain.trim_funnel)).withColumn(
        "first_visit_group", C.funnel_group("first_visit_funnel")
    )


def repeat_first_visits(visits: DataFrame, grain: Grain = VISITOR) -> DataFrame:
    """``repeat_visitors`` with what happened in the first visit, from one pass over the visits."""
    if grain.flagged_only:
        raise ValueError("first visits are among the flagged visits only, return buckets are not; use repeat_visitors")
    daily = V.daily_first_visits(V.visits_of(visits, grain), grain.key, grain.trim_funnel)
    summary = R.return_summary(daily, grain.key, F.expr("min(first) as first"))
    returned = R.with_bucket(summary, grain.buckets).filter(F.col("return_bucket") != grain.buckets.none)
    return (
        returned.select(grain.key, "return_bucket", "first.*")
        .select(grain.key, "return_bucket", *V.touched(grain.trim_funnel), *V.CARRIED)
        .withColumn("first_visit_group", C.funnel_group("first_visit_funnel"))
    )


def person_funnel_type(population: DataFrame, visits: DataFrame, grain: Grain) -> DataFrame:
    """Returning population with the funnel and group of each first interaction.

    Someone without a flagged interaction in the window stays, ``Unmapped``.
    """
    returning = population.filter(f"return_bucket not ilike {C.text(rules.NO_REPEAT_PERSON_PATTERN)}")
    flagged = V.flagged(V.visits_of(visits, grain), grain)
    return (
        V.audience_first_touch(flagged, returning, grain.key, "return_bucket", grain.trim_funnel)
        .select(grain.key, "return_bucket", "first_interaction_time", "first_visit_funnel")
        .withColumn("first_visit_group", C.funnel_group("first_visit_funnel"))
    )


def _audience(classified: DataFrame, group: str) -> DataFrame:
    return classified.filter(F.col("first_visit_group") == group)


def _first(columns: DataFrame, grain: Grain) -> DataFrame:
    return columns.select(grain.key, "first_visit_id", "first_interaction_time", "first_visit_funnel", *V.CARRIED)


def _ita(visits: DataFrame, classified: DataFrame | None, grain: Grain) -> DataFrame:
    """First visits of the ITA audience with their stage; of its keys that have rows in the window."""
    if classified is None:
        first = _first(_audience(repeat_first_visits(visits, grain), rules.ITA), grain)
    else:
        first = V.first_visits(V.flagged(V.visits_of(visits, grain), grain), grain.key, audience=_audience(classified, rules.ITA))
    return stages.with_ita_category(first)


def _pq(visits: DataFrame, classified: DataFrame | None, grain: Grain, prune: bool) -> DataFrame:
    """First visits of all PQ keys, NULL for those without rows in the window, with their stage."""
    if classified is None:
        first = _audience(repeat_first_visits(visits, grain), rules.PQ)
    else:
        keys = _audience(classified, rules.PQ).select(grain.key)
        first = V.audience_first_visits(V.flagged(V.visits_of(visits, grain), grain), keys, grain.key, prune=prune)
    columns = ("first_visit_id", "first_interaction_time", "first_visit_funnel", "matched_first_visit_rows", "hard_submitted")
    return stages.with_pq_category(first.select(grain.key, *columns))


def visitor_ita(visits: DataFrame, repeat: DataFrame | None, lookup: DataFrame, grain: Grain = VISITOR) -> DataFrame:
    """ITA audience with stage and summarised customer type; ``repeat=None`` finds the repeat visitors in the same pass."""
    return custtype.attach_summary(_ita(visits, repeat, grain), lookup, grain.key)


def visitor_pq(visits: DataFrame, repeat: DataFrame | None, lookup: DataFrame, grain: Grain = VISITOR, prune: bool = False) -> DataFrame:
    """PQ audience with stage and summarised customer type; ``repeat=None`` finds the repeat visitors in the same pass.

    ``prune`` is for a stored ``repeat``: a small audience then drops the other keys' visits before they are grouped.
    """
    return custtype.attach_summary(_pq(visits, repeat, grain, prune), lookup, grain.key)


def person_ita(visits: DataFrame, classified: DataFrame, lookup: DataFrame, grain: Grain) -> DataFrame:
    """ITA audience with stage and customer type as looked up (NULL when unmatched)."""
    return custtype.attach_type(_ita(visits, classified, grain), lookup, grain.key)


def person_ita_later(visits: DataFrame, classified: DataFrame, lookup: DataFrame, grain: Grain) -> DataFrame:
    """``person_ita`` with the submits after the first visit day, from one pass over the visits."""
    audience = _audience(classified, rules.ITA)
    first = V.first_visits_and_days(V.visits_of(visits, grain), grain.key, grain.flagged_only, audience=audience)
    return later.with_later_activity(custtype.attach_type(stages.with_ita_category(first), lookup, grain.key))


def person_pq(visits: DataFrame, classified: DataFrame, lookup: DataFrame, grain: Grain, prune: bool = False) -> DataFrame:
    """PQ audience with stage, customer type and whether one was found; ``prune`` as in ``visitor_pq``."""
    return custtype.attach_type(_pq(visits, classified, grain, prune), lookup, grain.key, default=rules.UNKNOWN)
