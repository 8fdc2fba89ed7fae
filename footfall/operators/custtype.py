"""Customer types: which one belongs to a visitor or person?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.functions import columns as C, rules
from footfall.operators import returns as R, touch as T
from footfall.params import DateWindow


def latest_application(applications: DataFrame, key: str, years: DateWindow) -> DataFrame:
    """Customer type of the latest application per ``key``, of the given transaction years."""
    by_type = "cust_type asc nulls last"
    tie_break = by_type if key == "appl_key" else f"appl_key desc nulls last, {by_type}"
    recent = R.slice_window(applications, "tran_date", years)
    return T.latest_per_key(recent, key, "appl_entry_dt", tie_break).select(key, "cust_type")


def visitor_candidates(
    traffic: DataFrame, applications: DataFrame, traffic_years: DateWindow, application_years: DateWindow
) -> DataFrame:
    """Every typed (visitor, customer id, customer) with its first visit time.

    Traffic is reduced to one row per visitor and customer id before the join.
    Applications are unique per customer after the latest pick, so the join gives
    each combination once and needs no grouping after it. Both sides are shuffled
    for the join, so Spark can split a customer that many visitors share.
    """
    visits = (
        R.slice_window(traffic, "record_created_timestamp", traffic_years)
        .groupBy("visitor_id", "customer_id")
        .agg(F.expr("min(created_at) as visit_date"))
    )
    typed = latest_application(applications, "cust_id", application_years).filter("cust_type is not null")
    return (
        visits.withColumn("_number", C.numeric_key("customer_id"))
        .join(typed.withColumn("_number", C.numeric_key("cust_id")), "_number")
        .select("visitor_id", "customer_id", "cust_id", "cust_type", "visit_date")
    )


def visitor_cust_type(
    traffic: DataFrame, applications: DataFrame, traffic_years: DateWindow, application_years: DateWindow
) -> DataFrame:
    """One customer type per visitor: the candidate with the latest first visit."""
    candidates = visitor_candidates(traffic, applications, traffic_years, application_years)
    tie_break = "customer_id asc nulls last, cust_id asc nulls last, cust_type asc nulls last"
    return T.latest_per_key(candidates, "visitor_id", "visit_date", tie_break)


def person_candidates(interactions: DataFrame, applications: DataFrame, years: DateWindow) -> DataFrame:
    """Every typed (application, person) with its first interaction.

    Joining on a hash beside the key changes no match. It has both sides shuffled for
    the join itself; the applications, grouped by the same key, would otherwise stay
    where they are, and Spark splits a skewed partition only between two fresh
    shuffles. So an application that many people share is split, not one huge task.
    """
    seen = (
        R.slice_window(interactions, "interaction_date", years)
        .groupBy("appl_key", "person")
        .agg(F.expr("min(interaction_date) as visit_date"))
    )
    typed = latest_application(applications, "appl_key", years).filter("cust_type is not null")
    with_hash = ("*", "xxhash64(appl_key) as _hash")
    return (
        seen.selectExpr(*with_hash)
        .join(typed.selectExpr(*with_hash), ["_hash", "appl_key"])
        .select("appl_key", "person", "cust_type", "visit_date")
    )


def person_cust_type(interactions: DataFrame, applications: DataFrame, years: DateWindow) -> DataFrame:
    """One customer type per person: the candidate with the latest first interaction."""
    candidates = person_candidates(interactions, applications, years)
    return T.latest_per_key(candidates, "person", "visit_date", "appl_key asc nulls last, cust_type asc nulls last")


def cust_type_summary(lookup: DataFrame, key: str) -> DataFrame:
    """Per key: how many customer ids and types the lookup holds, and the type to report.

    Blank ids and types do not count; types are compared without case or padding.
    """
    ids = C.trimmed("cast(customer_id as string)")
    types = C.trimmed("upper(cust_type)")
    counted = lookup.groupBy(key).agg(
        F.expr(f"count(distinct {ids}) as customer_id_count"),
        F.expr(f"count(distinct {types}) as cust_type_count"),
        F.expr(f"max({types}) as one_type"),
    )
    label = C.cases(
        [
            ("customer_id_count > 1", C.text(rules.MULTIPLE_IDS)),
            ("cust_type_count > 1", C.text(rules.MULTIPLE_TYPES)),
        ],
        f"coalesce(one_type, {C.text(rules.UNKNOWN)})",
    )
    return counted.selectExpr(key, f"{label} as cust_type", "customer_id_count", "cust_type_count")


def attach_summary(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Add the summarised customer type; keys the lookup lacks are ``Unknown`` with zero counts."""
    return df.join(cust_type_summary(lookup, key), key, "left").selectExpr(
        *df.columns,
        f"coalesce(cust_type, {C.text(rules.UNKNOWN)}) as cust_type",
        "coalesce(customer_id_count, 0) as customer_id_count",
        "coalesce(cust_type_count, 0) as cust_type_count",
    )


def attach_type(df: DataFrame, lookup: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """Add the looked-up customer type.

    Without a ``default`` an unmatched key gets NULL. With one it gets the default
    and the column ``cust_type_matched`` tells the two apart.
    """
    if default is None:
        return df.join(lookup.select(key, "cust_type"), key, "left")
    found = lookup.selectExpr(key, "cust_type", "1 as found")
    return df.join(found, key, "left").selectExpr(
        *df.columns,
        f"coalesce(cust_type, {C.text(default)}) as cust_type",
        "coalesce(found, 0) as cust_type_matched",
    )
