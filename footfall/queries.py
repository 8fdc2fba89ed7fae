"""Every job and every operator on the test data, under its query name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.functions import rules
from footfall.operators import custtype, later, reports as O, returns as R, visits as V
from footfall.params import PERSON, VISITOR, DateWindow
from footfall.plans import jobs, reporting
from footfall.sources import testdata
from footfall.sources.tables import TableStore, scratch_folder

# Parameters that suit the dates of the test data.
WINDOW = DateWindow(date(1996, 1, 1), date(1997, 2, 1))
WIDE_WINDOW = DateWindow(date(1995, 1, 1), date(2002, 1, 1))
APPLICATION_YEARS = DateWindow.years(1996, 1998)
PERSON_YEARS = DateWindow.years(1996, 1997)
TRAFFIC_YEARS = DateWindow.years(2024, 2024)
AS_OF = date(2001, 8, 1)
OFFER_WINDOW = DateWindow(AS_OF - timedelta(days=30), date(9999, 12, 31))
VISITOR_ID = 7
CUSTOMER_ID = "7"
PERSON_ID = "7"

VISITOR_GRAIN = replace(VISITOR, window=WINDOW)
WIDE_GRAIN = replace(VISITOR, window=WIDE_WINDOW)
PERSON_GRAIN = replace(PERSON, window=WINDOW)
POPULATION_GRAIN = replace(PERSON_GRAIN, buckets=replace(rules.RETURN_BUCKETS, none="7. No repeat identified"))


class Data:
    """The input tables and the tables built from them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._table = cache(lambda name: testdata.table(spark, sf_dir, name))

    def interactions(self, window: DateWindow | None = None, person: str | None = None) -> DataFrame:
        return testdata.interactions(self._table("orders"), self._table("lineitem"), window, person)

    @cached_property
    def rows(self) -> DataFrame:
        return self.interactions(WINDOW)

    @cached_property
    def known_rows(self) -> DataFrame:
        return R.slice_window(self.rows, "interaction_date", WINDOW).filter("visitor_id is not null")

    @cached_property
    def applications(self) -> DataFrame:
        return testdata.applications(self._table("orders"))

    @cached_property
    def traffic(self) -> DataFrame:
        return testdata.traffic_visits(self._table("events"))

    @cached_property
    def visitor_candidates(self) -> DataFrame:
        return custtype.visitor_candidates(self.traffic, self.applications, TRAFFIC_YEARS, APPLICATION_YEARS)

    @cached_property
    def visitor_cust_type(self) -> DataFrame:
        return custtype.visitor_cust_type(self.traffic, self.applications, TRAFFIC_YEARS, APPLICATION_YEARS)

    @cached_property
    def person_cust_type(self) -> DataFrame:
        return custtype.person_cust_type(self.interactions(PERSON_YEARS), self.applications, PERSON_YEARS)

    @cached_property
    def repeat_visitors(self) -> DataFrame:
        return jobs.repeat_visitors(self.rows, VISITOR_GRAIN)

    @cached_property
    def wide_repeat_visitors(self) -> DataFrame:
        return jobs.repeat_visitors(self.interactions(WIDE_WINDOW), WIDE_GRAIN)

    @cached_property
    def person_funnel_type(self) -> DataFrame:
        population = testdata.returning_population(self.rows, POPULATION_GRAIN)
        return jobs.person_funnel_type(population, self.rows, PERSON_GRAIN)

    @cached_property
    def visitor_ita(self) -> DataFrame:
        return jobs.visitor_ita(self.rows, None, self.visitor_cust_type, VISITOR_GRAIN)

    @cached_property
    def visitor_pq(self) -> DataFrame:
        return jobs.visitor_pq(self.rows, None, self.visitor_cust_type, VISITOR_GRAIN)

    @cached_property
    def person_ita(self) -> DataFrame:
        return jobs.person_ita(self.rows, self.person_funnel_type, self.person_cust_type, PERSON_GRAIN)

    @cached_property
    def person_pq(self) -> DataFrame:
        return jobs.person_pq(self.rows, self.person_funnel_type, self.person_cust_type, PERSON_GRAIN)

    @cached_property
    def person_ita_later(self) -> DataFrame:
        return jobs.person_ita_later(self.rows, self.person_funnel_type, self.person_cust_type, PERSON_GRAIN)


def _replaced(data: Data) -> DataFrame:
    """The repeat visitors as read back from a table that held those of a wider window before."""
    spark = data.rows.sparkSession
    store = TableStore(spark, root=scratch_folder(spark))
    store.replace("repeat_visitors", data.wide_repeat_visitors)
    store.replace("repeat_visitors", data.repeat_visitors)
    return store.read("repeat_visitors")


def _first(*columns: str):
    return [F.col(c).asc_nulls_last() for c in columns]


_QUERIES: dict[str, Callable[[Data], DataFrame]] = {
    # Returns and pages
    "url_map_visitors": lambda d: jobs.url_map_visitors(d.interactions()),
    "recent_offer_cookies": lambda d: jobs.recent_offer_cookies(d.interactions(OFFER_WINDOW), AS_OF),
    "return_bucket_detail": lambda d: jobs.return_bucket_detail(d.rows, VISITOR_GRAIN),
    "return_bucket_detail_wide": lambda d: jobs.return_bucket_detail(d.interactions(WIDE_WINDOW), WIDE_GRAIN),
    "return_bucket_report": lambda d: jobs.return_bucket_report(d.rows, VISITOR_GRAIN),
    "return_bucket_report_wide": lambda d: jobs.return_bucket_report(d.interactions(WIDE_WINDOW), WIDE_GRAIN),
    # Customer types
    "cust_type_profile": lambda d: reporting.cust_type_profile(d.applications, APPLICATION_YEARS),
    "visitor_cust_type": lambda d: d.visitor_cust_type,
    "visitor_multi_type_audit": lambda d: reporting.multi_type_audit(d.visitor_cust_type, "visitor_id"),
    "visitor_cust_type_for": lambda d: O.rows_for(d.visitor_cust_type, "visitor_id", VISITOR_ID),
    "customer_multi_type_audit": lambda d: reporting.customer_multi_type_audit(d.applications, APPLICATION_YEARS),
    "applications_for": lambda d: O.rows_for(d.applications, "cust_id", CUSTOMER_ID),
    "visit_timeline": lambda d: reporting.visit_timeline(d.traffic, VISITOR_ID, TRAFFIC_YEARS),
    "person_cust_type": lambda d: d.person_cust_type,
    "person_multi_type_audit": lambda d: reporting.multi_type_audit(d.person_cust_type, "person"),
    # Visitor audiences
    "repeat_visitors": lambda d: d.repeat_visitors,
    "visitor_ita": lambda d: d.visitor_ita,
    "visitor_ita_by_type": lambda d: reporting.ita_by_type(d.visitor_ita, "visitor_id"),
    "visitor_ita_by_category": lambda d: reporting.by_category(d.visitor_ita, "visitor_id"),
    "visitor_ita_other_reasons": lambda d: reporting.ita_other_reasons(d.visitor_ita, "visitor_id"),
    "visitor_pq": lambda d: d.visitor_pq,
    "visitor_pq_by_type": lambda d: reporting.pq_by_type(d.visitor_pq, "visitor_id"),
    "visitor_pq_by_category": lambda d: reporting.by_category(d.visitor_pq, "visitor_id"),
    # Person audiences
    "person_funnel_type": lambda d: d.person_funnel_type,
    "return_bucket_by_group": lambda d: reporting.return_bucket_by_group(d.person_funnel_type, "person"),
    "person_ita": lambda d: d.person_ita,
    "person_ita_by_type": lambda d: reporting.ita_by_type(d.person_ita, "person", categories=None),
    "person_pq": lambda d: d.person_pq,
    "person_pq_by_type": lambda d: reporting.pq_by_type(d.person_pq, "person", categories=None),
    "person_ita_later": lambda d: d.person_ita_later,
    "later_submit_report": lambda d: reporting.later_submit_report(d.person_ita_later),
    "interactions_for": lambda d: O.rows_for(d.interactions(person=PERSON_ID), "person", PERSON_ID),
    # Single operators, over all keys
    "daily_visits": lambda d: R.daily_visits(d.known_rows, "visitor_id"),
    "first_date": lambda d: R.first_date(R.daily_visits(d.known_rows, "visitor_id"), "visitor_id"),
    "same_day_max": lambda d: R.same_day_max(R.daily_visits(d.known_rows, "visitor_id"), "visitor_id"),
    "return_gap": lambda d: R.return_gap(R.daily_visits(d.known_rows, "visitor_id"), "visitor_id"),
    "first_touch": lambda d: V.first_touch(jobs.visit_summary(d.rows, VISITOR_GRAIN), "visitor_id"),
    "first_touch_raw_funnel": lambda d: V.first_touch(jobs.visit_summary(d.rows, PERSON_GRAIN), "person", trim_funnel=False),
    "first_visit_activity": lambda d: V.audience_first_visits(
        jobs.visit_summary(d.rows, VISITOR_GRAIN), d.known_rows.select("visitor_id"), "visitor_id"
    ),
    "latest_application": lambda d: custtype.latest_application(d.applications, "cust_id", APPLICATION_YEARS),
    "latest_application_row": lambda d: custtype.latest_application(d.applications, "appl_key", PERSON_YEARS),
    "visitor_candidates": lambda d: d.visitor_candidates,
    "person_candidates": lambda d: custtype.person_candidates(
        d.interactions(PERSON_YEARS), d.applications, PERSON_YEARS
    ),
    "cust_type_summary": lambda d: custtype.cust_type_summary(d.visitor_candidates, "visitor_id"),
    "visitor_ita_all_candidates": lambda d: jobs.visitor_ita(
        d.rows, d.repeat_visitors, d.visitor_candidates, VISITOR_GRAIN
    ),
    "visitor_ita_second_type": lambda d: jobs.visitor_ita(
        d.rows, d.repeat_visitors, testdata.with_second_type(d.visitor_cust_type), VISITOR_GRAIN
    ),
    "cust_type_summary_second_type": lambda d: custtype.cust_type_summary(
        testdata.with_second_type(d.visitor_cust_type), "visitor_id"
    ),
    # Audiences that reach beyond the window of their interactions
    "visitor_ita_wider_repeat": lambda d: jobs.visitor_ita(
        d.rows, d.wide_repeat_visitors, d.visitor_cust_type, VISITOR_GRAIN
    ),
    "visitor_pq_wider_repeat": lambda d: jobs.visitor_pq(
        d.rows, d.wide_repeat_visitors, d.visitor_cust_type, VISITOR_GRAIN
    ),
    "visit_summary": lambda d: jobs.visit_summary(d.rows, VISITOR_GRAIN),
    "first_visits": lambda d: V.first_visits(jobs.visit_summary(d.rows, VISITOR_GRAIN), "visitor_id"),
    "later_activity": lambda d: later.with_later_activity(
        V.first_visits_and_days(jobs.visit_summary(d.rows, PERSON_GRAIN), "person", flagged_only=False)
        .select("person", "first_visit_id", "first_interaction_time", "first_visit_funnel", "submit_days")
    ),
    "return_bucket_report_from_summary": lambda d: jobs.return_bucket_report(jobs.visit_summary(d.rows, VISITOR_GRAIN), VISITOR_GRAIN),
    # The sink: a table replaced twice
    "repeat_visitors_replaced": _replaced,
    # Previews, in a fixed order so that they can be checked
    "sample_cookie_summary": lambda d: O.sample_rows(
        testdata.cookie_summary(d.interactions()), order_by=_first("cookie_id", "visitor_id")
    ),
    "sample_repeat_visitors": lambda d: O.sample_rows(d.repeat_visitors, order_by=_first("visitor_id")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query as a function of the session and the data folder."""

    def on_data(job):
        return lambda spark, sf_dir: job(Data(spark, sf_dir))

    return {name: on_data(job) for name, job in _QUERIES.items()}
