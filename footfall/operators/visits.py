"""The visit summary: one pass over the interactions from which the jobs derive all they need.

A row stands for the interactions of a key that share a calendar day, a visit, a funnel and a visitor flag. Strings are grouping columns and
all measures have a fixed width, so the interactions are aggregated by hash, combined on the map side, and never sorted. A key with a
third of all rows is spread by day and visit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import columns as C
from footfall.operators import returns as R, stages, touch as T
from footfall.params import Grain

FLAGS = ("app_started", "soft_submitted", "soft_approved", "hard_submitted")


def summarise(rows: DataFrame, key: str) -> DataFrame:
    """The visit summary of ``rows``: first time, 0/1 flags and number of rows of each group."""
    lowered = rows.selectExpr("*", "lower(gen_url) as _url")
    return lowered.groupBy(key, F.expr("to_date(interaction_date) as day"), "visit_id", "funnel", "visitor_flag").agg(
        F.expr("min(interaction_date) as first_time"),
        *[F.max(expr).alias(name) for name, expr in stages.ita_flags().items()],
        F.expr("count(*) as row_count"),
    )


def is_summary(table: DataFrame) -> bool:
    return "first_time" in table.columns


def visits_of(table: DataFrame, grain: Grain) -> DataFrame:
    """The visit summary of the interactions in the window that have an identity.

    A table that is a visit summary already, made for the same grain, is returned as it is.
    """
    if is_summary(table):
        return table
    rows = R.slice_window(table, "interaction_date", grain.window).filter(f"{grain.key} is not null")
    return summarise(rows, grain.key)


def flagged(visits: DataFrame, grain: Grain) -> DataFrame:
    """The visits that may be first visits."""
    return visits.filter("visitor_flag = 1") if grain.flagged_only else visits


def _touch(trim_funnel: bool) -> str:
    """A visit as an ordered struct: time, then visit, then funnel, nulls last."""
    funnel = C.trimmed("funnel") if trim_funnel else "funnel"
    return f"struct(first_time as time, visit_id is null as no_visit, visit_id as visit, {funnel} is null as no_funnel, {funnel} as funnel)"


def touch(trim_funnel: bool) -> Column:
    """The earliest of a group of visits."""
    return F.expr(f"min({_touch(trim_funnel)}) as touch")


def touched(trim_funnel: bool) -> list[Column]:
    """First visit, time and funnel of a ``touch``."""
    funnel = F.expr("touch.funnel")
    return [
        F.expr("touch.visit as first_visit_id"),
        F.expr("touch.time as first_interaction_time"),
        # A missing funnel is named, but not one of a key without any visit.
        (F.expr(f"if(touch is null, null, coalesce(touch.funnel, {C.text(C.rules.UNKNOWN)}))") if trim_funnel else funnel).alias("first_visit_funnel"),
    ]


def first_touch(visits: DataFrame, key: str, trim_funnel: bool = True) -> DataFrame:
    """Earliest visit, time and funnel per key."""
    return visits.groupBy(key).agg(touch(trim_funnel)).select(key, *touched(trim_funnel))


def _restricted(grouped: DataFrame, audience: DataFrame | None, key: str) -> DataFrame:
    """Right above a grouping, from where Spark moves the semi-join below all groupings when the audience can be broadcast."""
    return grouped if audience is None else T.restrict_to(grouped, audience, key)


CARRIED = (*FLAGS, "matched_first_visit_rows")
_FIRST = f"struct(touch, {', '.join(CARRIED)})"


def _activity(visit: str) -> list[Column]:
    """What a group of rows of one visit carries: its flags and number of rows. A visit without an id matches no rows."""
    flags = [F.expr(f"if({visit} is null, 0, max({f})) as {f}") for f in FLAGS]
    return [*flags, F.expr(f"if({visit} is null, 0L, sum(row_count)) as matched_first_visit_rows")]


def _by_visit(visits: DataFrame, key: str, trim_funnel: bool) -> DataFrame:
    return visits.groupBy(key, "visit_id").agg(touch(trim_funnel), *_activity("visit_id"))


def first_visits(visits: DataFrame, key: str, trim_funnel: bool = True, audience: DataFrame | None = None) -> DataFrame:
    """First touch per key with the flags of that visit over all its days, and the number of its rows.

    Visits are summed up by key and visit and the earliest carries its flags along, so nothing is joined. A first visit
    without an id matches no rows: its flags and number are 0. With an ``audience`` only its keys are kept.
    """
    # The touch differs between the visits of a key, so it alone decides.
    first = _by_visit(visits, key, trim_funnel).groupBy(key).agg(F.expr(f"min({_FIRST}) as first"))
    return _restricted(first, audience, key).select(key, "first.*").select(key, *touched(trim_funnel), *CARRIED)


def audience_first_visits(visits: DataFrame, audience: DataFrame, key: str, trim_funnel: bool = True, prune: bool = False) -> DataFrame:
    """One row for each key of ``audience``: its first visit as in ``first_visits``, NULL and 0 for keys without visits.

    Audience and visits are one tagged union, grouped once; the tag decides which keys survive. So the audience is read once, however costly it is to compute.
    With ``prune`` it is read a second time, to drop the visits of other keys below the grouping where it can be broadcast: for a stored audience.
    """
    by_visit = _restricted(_by_visit(visits, key, trim_funnel), audience if prune else None, key)
    rows = by_visit.selectExpr(key, f"{_FIRST} as first", "false as wanted").unionByName(audience.selectExpr(key, "true as wanted"), allowMissingColumns=True)
    first = rows.groupBy(key).agg(F.expr("min(first) as first"), F.expr("max(wanted) as wanted")).filter("wanted")
    zeros = [F.expr(f"coalesce({c}, 0) as {c}") for c in CARRIED]
    return first.select(key, "first.*").select(key, *touched(trim_funnel), *zeros)


def audience_first_touch(visits: DataFrame, audience: DataFrame, key: str, label: str, trim_funnel: bool = True) -> DataFrame:
    """Each distinct key and ``label`` of ``audience`` with the key's first touch, NULL for keys without visits; a tagged union as above."""
    touches = visits.groupBy(key).agg(touch(trim_funnel))
    rows = touches.unionByName(audience.selectExpr(key, f"struct({label}) as member"), allowMissingColumns=True)
    grouped = rows.groupBy(key).agg(F.expr("min(touch) as touch"), F.expr("collect_set(member) as members"))
    return grouped.select(key, "touch", F.explode("members").alias("member")).select(key, F.col(f"member.{label}").alias(label), *touched(trim_funnel))


def first_visits_and_days(visits: DataFrame, key: str, flagged_only: bool, trim_funnel: bool = True, audience: DataFrame | None = None) -> DataFrame:
    """``first_visits``, and in ``submit_days`` the days on which the key soft- or hard-submitted, whatever the visitor flag.

    A visit counts for its visit and, where it has a submit, for its day: both are summed up in one grouping. A key has at most one
    entry for each day of the window.
    """
    may_be_first = "visitor_flag = 1" if flagged_only else "true"
    kinds = (
        f"array_compact(array(if({may_be_first}, struct(false as is_day, visit_id as visit, cast(null as date) as submit_date), null), "
        "if(soft_submitted = 1 or hard_submitted = 1, struct(true as is_day, cast(null as bigint) as visit, day as submit_date), null)))"
    )
    # The funnel is cleaned ahead: inside the aggregate it would keep the semi-join from moving below.
    cleaned = visits.withColumn("funnel", F.expr(C.trimmed("funnel"))) if trim_funnel else visits
    parts = cleaned.withColumn("part", F.explode(F.expr(kinds))).select("*", "part.*")
    summed = parts.groupBy(key, "is_day", "visit", "submit_date").agg(
        touch(False), F.expr("max(soft_submitted) as soft"), F.expr("max(hard_submitted) as hard"), *_activity("visit")
    )
    # collect_list keeps Spark from moving a semi-join below its grouping, so the audience meets the rows under it.
    first = _restricted(summed, audience, key).groupBy(key).agg(
        F.expr(f"min(if(is_day, null, {_FIRST})) as first"),
        F.expr("collect_list(if(is_day, struct(submit_date, soft, hard), null)) as submit_days"),
    )
    return first.filter("first is not null").select(key, "first.*", "submit_days").select(key, *touched(trim_funnel), *CARRIED, "submit_days")


def daily_visits(visits: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL visits per key and calendar day, from the summary."""
    return visits.groupBy(key, F.col("day").alias("visit_date")).agg(F.expr("count(distinct visit_id) as visit_id_count"))


def daily_first_visits(visits: DataFrame, key: str, trim_funnel: bool = True) -> DataFrame:
    """``daily_visits`` with the earliest visit of each day in ``first``: its touch, and its flags and rows over all its days.

    A window sums each visit up over its days, and then days are grouped; so return buckets and first visits come out of one chain, which
    shuffles nothing where the summary is clustered by the key.
    """
    by_day = visits.groupBy(key, "visit_id", "day").agg(
        touch(trim_funnel), *[F.expr(f"max({f}) as {f}") for f in FLAGS], F.expr("sum(row_count) as row_count")
    )
    whole = f"over (partition by {key}, visit_id)"
    flags = [f"if(visit_id is null, 0, max({f}) {whole}) as {f}" for f in FLAGS]
    summed = by_day.selectExpr(key, "visit_id", "day as visit_date", "touch", *flags, f"if(visit_id is null, 0L, sum(row_count) {whole}) as matched_first_visit_rows")
    return summed.groupBy(key, "visit_date").agg(F.expr("count(visit_id) as visit_id_count"), F.expr(f"min({_FIRST}) as first"))
