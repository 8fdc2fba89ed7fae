"""Return-visit operators and the jobs on them."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from footfall.operators import reports as O, returns as R
from footfall.params import PERSON, VISITOR
from footfall.plans import jobs
from tests.data import WINDOW, hit, interactions, keyed

GRAIN = replace(VISITOR, window=WINDOW)


def random_hits(seed, n=800, keys=40):
    rng = random.Random(seed)
    return [
        hit(
            rng.randrange(keys),
            f"2025-{rng.randint(1, 12):02}-{rng.choice([1, 1, 2, 9, 28]):02} {rng.randint(0, 23):02}:{rng.choice([0, 30]):02}",
            rng.choice([None, *range(12)]),
            funnel=rng.choice([None, "", " PQ_OMF ", "PQ_OMF", "CK_EA", "FA_OMF"]),
        )
        for _ in range(n)
    ]


def test_buckets(spark):
    rows = [
        hit(1, "2025-03-01 10:00", 1), hit(1, "2025-03-01 11:00", 2), hit(1, "2025-03-03 11:00", 3),
        hit(2, "2025-03-01 23:59", 1), hit(2, "2025-03-02 00:01", 1),
        hit(3, "2025-03-01 10:00", 1), hit(3, "2025-03-01 12:00", 1),
        hit(4, "2025-03-01 10:00"), hit(4, "2025-03-01 11:00"), hit(4, "2025-07-01 11:00"),
        hit(5, "2024-12-31 23:59", 1), hit(5, "2025-01-01 00:00", 2), hit(5, "2026-01-31 23:59", 3), hit(5, "2026-02-01 00:00", 4),
        hit(None, "2025-03-01 10:00", 1), hit(None, "2025-03-02 10:00", 2),
        hit(6, None, 1),
        # a later day with many visits still means "same day", whatever the gap
        hit(7, "2025-01-01 10:00", 1), hit(7, "2025-12-01 10:00", 2), hit(7, "2025-12-01 11:00", 3),
    ]
    got = keyed(jobs.return_buckets(interactions(spark, rows), GRAIN), "visitor_id")
    facts = {k: (r["max_visit_ids_in_day"], r["min_return_gap"], r["return_bucket"][0]) for k, r in got.items()}
    assert facts == {
        1: (2, 2, "1"), 2: (1, 1, "2"), 3: (1, None, "7"), 4: (0, 122, "5"), 5: (1, 395, "6"), 7: (2, 334, "1"),
    }
    detail = keyed(jobs.return_bucket_detail(interactions(spark, rows), GRAIN), "visitor_id")
    assert set(detail) == {1, 2, 4, 5, 7}


def test_looking_ahead_equals_joining_days(spark):
    rows = interactions(spark, random_hits(1)).filter("visitor_id is not null")
    daily = R.daily_visits(rows, "visitor_id")
    first = R.first_date(daily, "visitor_id")
    joined = (
        daily.join(first, "visitor_id")
        .filter("visit_date > first_visit_date")
        .groupBy("visitor_id")
        .agg(F.expr("min(date_diff(visit_date, first_visit_date)) as min_return_gap"))
    )
    assert sorted(map(tuple, R.return_gap(daily, "visitor_id").collect())) == sorted(map(tuple, joined.collect()))
    summary = R.return_summary(daily, "visitor_id").select("visitor_id", "max_visit_ids_in_day")
    assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, R.same_day_max(daily, "visitor_id").collect()))
    assert R.return_gap(daily, "visitor_id").filter("min_return_gap < 1").count() == 0


def test_report_adds_up(spark):
    rows = interactions(spark, random_hits(2))
    report = {r[0]: int(r[1].replace(",", "")) for r in jobs.return_bucket_report(rows, GRAIN).collect()}
    total = report.pop("Total")
    assert total == sum(report.values()) == rows.select("visitor_id").distinct().count()


def test_report_order_and_empty_input(spark):
    rows = interactions(spark, random_hits(3))
    labels = [r[0] for r in jobs.return_bucket_report(rows, GRAIN).collect()]
    assert labels == sorted(labels) and labels[-1] == "Total"
    empty = interactions(spark, [])
    assert [tuple(r) for r in jobs.return_bucket_report(empty, GRAIN).collect()] == [("Total", None)]


def test_total_sums_details(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 4)], "d string, n long")
    assert sorted(map(tuple, O.with_total(counts, "d", "n").collect())) == [("Total", 7), ("a", 3), ("b", 4)]


def test_repeat_visitors_do_not_depend_on_row_order(spark):
    hits = random_hits(4)
    shuffled = hits[:]
    random.Random(5).shuffle(shuffled)
    one = jobs.repeat_visitors(interactions(spark, hits), GRAIN)
    two = jobs.repeat_visitors(interactions(spark, shuffled).repartition(7), GRAIN)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    assert one.count() > 0 and one.filter("return_bucket like '7%'").count() == 0


def test_key_is_a_parameter(spark):
    rows = interactions(spark, random_hits(6))
    by_visitor = jobs.return_buckets(rows, GRAIN).selectExpr("cast(visitor_id as string) as person", "return_bucket")
    by_person = jobs.return_buckets(rows, replace(PERSON, window=WINDOW)).select("person", "return_bucket")
    assert sorted(map(tuple, by_visitor.collect())) == sorted(map(tuple, by_person.collect()))
