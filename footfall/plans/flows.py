"""The two table-building flows: each derived table is written once and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame

from footfall.operators import custtype
from footfall.params import DEFAULT_YEARS, PERSON, VISITOR, DateWindow, Grain
from footfall.plans import jobs
from footfall.sources.tables import TableStore


def build_visitor_tables(
    interactions: DataFrame,
    applications: DataFrame,
    traffic_visits: DataFrame,
    store: TableStore,
    grain: Grain = VISITOR,
    traffic_years: DateWindow = DEFAULT_YEARS,
    application_years: DateWindow = DEFAULT_YEARS,
) -> dict[str, DataFrame]:
    """Replace the visit summary and the four visitor tables; returns them as stored. The interactions are read once."""
    lookup = store.replace(
        "visitor_cust_type",
        custtype.visitor_cust_type(traffic_visits, applications, traffic_years, application_years),
    )
    visits = store.replace("visitor_visits", jobs.visit_summary(interactions, grain))
    repeat = store.replace("repeat_visitors", jobs.repeat_visitors(visits, grain))
    ita = jobs.visitor_ita(visits, repeat, lookup, grain)
    pq = jobs.visitor_pq(visits, repeat, lookup, grain, prune=True)
    return {
        "visitor_visits": visits,
        "visitor_cust_type": lookup,
        "repeat_visitors": repeat,
        "visitor_ita": store.replace("visitor_ita", ita),
        "visitor_pq": store.replace("visitor_pq", pq),
    }


def build_person_tables(
    interactions: DataFrame,
    applications: DataFrame,
    returning_population: DataFrame,
    store: TableStore,
    grain: Grain = PERSON,
    years: DateWindow = DEFAULT_YEARS,
) -> dict[str, DataFrame]:
    """Replace the visit summary and the four person tables; returns them as stored. ITA includes later activity.

    The interactions are read twice: for the summary, and over other years for the customer types.
    """
    lookup = store.replace("person_cust_type", custtype.person_cust_type(interactions, applications, years))
    visits = store.replace("person_visits", jobs.visit_summary(interactions, grain))
    classified = store.replace("person_funnel_type", jobs.person_funnel_type(returning_population, visits, grain))
    ita = jobs.person_ita_later(visits, classified, lookup, grain)
    pq = jobs.person_pq(visits, classified, lookup, grain, prune=True)
    return {
        "person_visits": visits,
        "person_cust_type": lookup,
        "person_funnel_type": classified,
        "person_ita": store.replace("person_ita", ita),
        "person_pq": store.replace("person_pq", pq),
    }
