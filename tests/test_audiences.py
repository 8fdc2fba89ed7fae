"""Audience tables: first-visit activity, stages, customer types, person population."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from footfall.operators import custtype, visits as V
from footfall.params import PERSON, VISITOR
from footfall.plans import jobs, reporting
from footfall.sources import schemas
from tests.data import WINDOW, at, frame, hit, interactions, keyed
from tests.test_returns import random_hits

GRAIN = replace(VISITOR, window=WINDOW)
PERSONS = replace(PERSON, window=WINDOW)


def lookup(spark, rows=()):
    return frame(spark, "visitor_cust_type", list(rows))


def repeat(spark, group, keys):
    return frame(spark, "repeat_visitors", [{"visitor_id": k, "first_visit_group": group} for k in keys])


def test_ita_activity_covers_the_whole_first_visit(spark):
    rows = interactions(
        spark,
        [
            # a visit across midnight is one visit; other visits do not count
            hit(1, "2025-03-01 23:59", 1, funnel="PQ_OMF", gen_url="/home"),
            hit(1, "2025-03-02 00:01", 1, funnel="PQ_OMF", gen_url="/apply", soft_submit_flag=1),
            hit(1, "2025-03-05 00:01", 2, funnel="PQ_OMF", hard_submit_flag=1),
            # no visit id: nothing matches
            hit(2, "2025-03-01 10:00", None, funnel="PQ_OMF", gen_url="/apply", hard_submit_flag=1),
            # rows of the first visit outside the window do not count
            hit(3, "2026-01-31 23:59", 7, funnel="FA_OMF", gen_url="/apply"),
            hit(3, "2026-02-01 00:00", 7, funnel="FA_OMF", hard_submit_flag=1),
            # not in the audience, and no identity
            hit(4, "2025-03-01 10:00", 1, funnel="PQ_OMF"),
            hit(None, "2025-03-01 10:00", 1, funnel="PQ_OMF"),
            # flags other than 1 are not set
            hit(5, "2025-03-01 10:00", 1, funnel=" ", soft_submit_flag=2, hard_submit_flag=0, gen_url=None),
        ],
    )
    got = keyed(jobs.visitor_ita(rows, repeat(spark, "ITA", [1, 2, 3, 5, 5, 9, None]), lookup(spark), GRAIN), "visitor_id")
    flags = ("app_started", "soft_submitted", "soft_approved", "hard_submitted", "matched_first_visit_rows")
    assert {k: tuple(r[f] for f in flags) for k, r in got.items()} == {
        1: (1, 1, 0, 0, 2), 2: (0, 0, 0, 0, 0), 3: (1, 0, 0, 0, 1), 5: (0, 0, 0, 0, 1),
    }
    assert {k: r["first_visit_category"][0] for k, r in got.items()} == {1: "3", 2: "5", 3: "1", 5: "5"}
    assert got[5]["first_visit_funnel"] == "Unknown"
    assert {(r["cust_type"], r["customer_id_count"], r["cust_type_count"]) for r in got.values()} == {("Unknown", 0, 0)}


def test_pq_keeps_keys_without_rows(spark):
    rows = interactions(
        spark,
        [
            hit(1, "2025-03-01 10:00", 1, hard_submit_flag=1), hit(2, "2025-03-01 10:00", 1), hit(3, "2025-03-01 10:00", None),
            hit(2, "2025-03-02 10:00", 2, hard_submit_flag=1), hit(4, "2024-03-01 10:00", 1),
        ],
    )
    got = keyed(jobs.visitor_pq(rows, repeat(spark, "PQ", [1, 2, 3, 4, 4]), lookup(spark), GRAIN), "visitor_id")
    assert {k: (r["first_visit_category"], r["other_reason"]) for k, r in got.items()} == {
        1: ("2. Hard submitted", None),
        2: ("1. Prequalified, no hard submit", None),
        3: ("3. Other", "Missing first visit ID"),
        4: ("3. Other", "No source records in date window"),
    }
    assert got[4]["first_visit_funnel"] is None and got[4]["hard_submitted"] == 0


def test_visit_summaries_equal_joining_rows(spark):
    rows = interactions(
        spark, [{**h, "gen_url": u, "soft_submit_flag": s} for h, u, s in zip(random_hits(21), ["/apply", "/x", None] * 300, [0, 1, None, 1, 0] * 200)]
    ).filter("visitor_id is not null")
    visits = V.summarise(rows, "visitor_id")
    first, ours = V.first_touch(visits, "visitor_id"), V.first_visits(visits, "visitor_id")
    first.createOrReplaceTempView("first_rows")
    rows.createOrReplaceTempView("all_rows")
    joined = spark.sql(
        """select f.visitor_id, f.first_visit_id, f.first_interaction_time, f.first_visit_funnel,
                  max(if(gen_url ilike '%apply%', 1, 0)) app_started, max(if(soft_submit_flag = 1, 1, 0)) soft_submitted,
                  max(if(soft_approval_flag = 1, 1, 0)) soft_approved, max(if(hard_submit_flag = 1, 1, 0)) hard_submitted,
                  count(d.visitor_id) matched_first_visit_rows
           from first_rows f left join all_rows d on f.visitor_id = d.visitor_id and f.first_visit_id = d.visit_id
           group by all"""
    )
    assert ours.columns == joined.columns and ours.count() > 0
    assert ours.exceptAll(joined).count() == joined.exceptAll(ours).count() == 0


def applications(spark, rows):
    return frame(spark, "applications", [{"tran_date": at("2025-05-01"), **r} for r in rows])


def visits(spark, rows):
    return frame(spark, "traffic_visits", [{"record_created_timestamp": at("2025-05-01"), **r} for r in rows])


def test_visitor_cust_type(spark):
    apps = applications(
        spark,
        [
            dict(cust_id="7", appl_key=1, cust_type="OLD", appl_entry_dt=at("2025-01-01")),
            dict(cust_id="7", appl_key=2, cust_type="NEW", appl_entry_dt=at("2025-02-01")),
            dict(cust_id="8", appl_key=3, cust_type="X", appl_entry_dt=at("2025-02-01")),
            dict(cust_id="8", appl_key=4, cust_type=None, appl_entry_dt=None),
            dict(cust_id="9", appl_key=5, cust_type="", appl_entry_dt=at("2025-02-01")),
            dict(cust_id="9", appl_key=6, cust_type="LATE", appl_entry_dt=at("2025-03-01"), tran_date=at("2023-12-31")),
            dict(cust_id="n/a", appl_key=7, cust_type="BAD", appl_entry_dt=at("2025-02-01")),
        ],
    )
    traffic = visits(
        spark,
        [
            # earliest visit per customer, then the latest of those wins: 9 beats 7
            dict(visitor_id=1, customer_id="7.0", created_at=at("2025-01-01")),
            dict(visitor_id=1, customer_id="7.0", created_at=at("2025-09-01")),
            dict(visitor_id=1, customer_id=" 9 ", created_at=at("2025-02-01")),
            # latest application is untyped: no row
            dict(visitor_id=2, customer_id="8", created_at=at("2025-01-01")),
            dict(visitor_id=3, customer_id="n/a", created_at=at("2025-01-01")),
            # filter is on the record time, value is the creation time
            dict(visitor_id=4, customer_id="007", created_at=at("2020-01-01")),
            dict(visitor_id=5, customer_id="7", created_at=at("2025-01-01"), record_created_timestamp=at("2023-12-31")),
            # rows without a visitor form one group
            dict(visitor_id=None, customer_id="7", created_at=at("2025-01-01")),
            dict(visitor_id=None, customer_id="9", created_at=None),
        ],
    )
    from footfall.params import DEFAULT_YEARS

    got = keyed(custtype.visitor_cust_type(traffic, apps, DEFAULT_YEARS, DEFAULT_YEARS), "visitor_id")
    assert {k: (r["customer_id"], r["cust_type"]) for k, r in got.items()} == {
        1: (" 9 ", ""), 4: ("007", "NEW"), None: ("9", ""),
    }
    assert got[4]["visit_date"] == at("2020-01-01")
    audit = reporting.multi_type_audit(custtype.visitor_cust_type(traffic, apps, DEFAULT_YEARS, DEFAULT_YEARS), "visitor_id")
    assert {r[1] for r in audit.collect()} == {1}


def test_customer_type_summary(spark):
    rows = [
        (1, "7", "new "), (1, " 7", "NEW"),
        (2, "7", "NEW"), (2, "8", "OLD"),
        (3, "7", "NEW"), (3, "7", "OLD"), (3, None, None),
        (4, " ", " "), (4, None, None),
        (5, "", "OLD"),
    ]
    table = lookup(spark, [dict(visitor_id=v, customer_id=c, cust_type=t) for v, c, t in rows])
    got = {tuple(r) for r in custtype.cust_type_summary(table, "visitor_id").collect()}
    assert got == {
        (1, "NEW", 1, 1), (2, "Multiple customer IDs", 2, 2), (3, "Multiple customer types", 1, 2),
        (4, "Unknown", 0, 0), (5, "OLD", 0, 1),
    }


def test_person_cust_type(spark):
    apps = applications(
        spark,
        [
            dict(appl_key=1, cust_type="A", appl_entry_dt=at("2025-01-01")), dict(appl_key=1, cust_type="B", appl_entry_dt=None),
            dict(appl_key=2, cust_type="C", appl_entry_dt=at("2025-01-01")), dict(appl_key=3, cust_type=None, appl_entry_dt=None),
            dict(appl_key=None, cust_type="N", appl_entry_dt=at("2025-01-01")),
        ],
    )
    rows = interactions(
        spark,
        [
            hit(1, "2025-01-01 10:00", 1, appl_key=1), hit(1, "2025-09-01 10:00", 1, appl_key=1),
            hit(1, "2025-02-01 10:00", 1, appl_key=2), hit(1, "2025-12-01 10:00", 1, appl_key=3),
            hit(2, "2025-02-01 10:00", 1, appl_key=None), hit(3, "2023-02-01 10:00", 1, appl_key=1),
            hit(None, "2025-02-01 10:00", 1, appl_key=1),
        ],
    )
    from footfall.params import DEFAULT_YEARS

    got = keyed(custtype.person_cust_type(rows, apps, DEFAULT_YEARS), "person")
    assert {k: (r["appl_key"], r["cust_type"]) for k, r in got.items()} == {"1": (2, "C"), None: (1, "B")}


def test_person_funnel_type(spark):
    population = frame(
        spark,
        "returning_population",
        [dict(person=p, return_bucket=b) for p, b in [
            ("1", "2. x"), ("1", "2. x"), ("1", "3. y"), ("2", "7. No repeat identified"), ("3", None),
            ("4", "2. x"), ("5", "7. No repeat visits"), (None, "2. x"),
        ]],
    )
    rows = interactions(
        spark,
        [
            hit(1, "2025-03-01 10:00", 1, funnel="PQ_OMF", visitor_flag=0), hit(1, "2025-03-02 10:00", 1, funnel=" PQ_OMF "),
            hit(4, "2025-03-01 10:00", 1, funnel="CK_EA"), hit(2, "2025-03-01 10:00", 1, funnel="CK_EA"),
            hit(None, "2025-03-01 10:00", 1, funnel="CK_EA"),
        ],
    )
    got = {tuple(r) for r in jobs.person_funnel_type(population, rows, PERSONS).collect()}
    assert got == {
        ("1", "2. x", at("2025-03-02 10:00"), " PQ_OMF ", "Unmapped"),
        ("1", "3. y", at("2025-03-02 10:00"), " PQ_OMF ", "Unmapped"),
        ("4", "2. x", at("2025-03-01 10:00"), "CK_EA", "PQ"),
        ("5", "7. No repeat visits", None, None, "Unmapped"),
        (None, "2. x", None, None, "Unmapped"),
    }
    counts = {tuple(r) for r in reporting.return_bucket_by_group(jobs.person_funnel_type(population, rows, PERSONS), "person").collect()}
    assert ("2. x", "Unmapped", 1) in counts and ("2. x", "PQ", 1) in counts


def classified(spark, group, keys):
    return frame(spark, "person_funnel_type", [{"person": k, "first_visit_group": group, "return_bucket": b} for k in keys for b in "ab"])


def types(spark, rows):
    return frame(spark, "person_cust_type", [dict(person=p, cust_type=t) for p, t in rows])


def test_later_activity(spark):
    rows = interactions(
        spark,
        [
            hit(1, "2025-03-01 10:00", 1, funnel="PQ_OMF"),
            # same day does not count, a row without the visitor flag does
            hit(1, "2025-03-01 23:59", 2, soft_submit_flag=1, hard_submit_flag=1),
            hit(1, "2025-03-02 00:00", 3, soft_submit_flag=1, visitor_flag=0),
            hit(1, "2025-03-09 00:00", 3, soft_submit_flag=1, hard_submit_flag=1),
            # after the window, and before the first flagged row
            hit(2, "2025-03-05 10:00", 1, funnel="PQ_OMF"), hit(2, "2026-02-01 00:00", 2, hard_submit_flag=1),
            hit(2, "2025-03-01 10:00", 1, hard_submit_flag=1, visitor_flag=0),
            hit(3, "2025-01-01 00:00", 1, funnel="PQ_OMF"), hit(3, "2026-01-31 23:59", 1, hard_submit_flag=1),
        ],
    )
    args = (rows, classified(spark, "ITA", ["1", "2", "3"]), types(spark, [("1", "NEW")]), PERSONS)
    got = keyed(jobs.person_ita_later(*args), "person")
    cols = ("later_soft_submitted", "later_hard_submitted", "days_to_later_soft_submit", "days_to_later_hard_submit")
    assert {k: tuple(r[c] for c in cols) for k, r in got.items()} == {
        "1": (1, 1, 1, 8), "2": (0, 0, None, None), "3": (0, 1, None, 395),
    }
    assert (got["1"]["cust_type"], got["2"]["cust_type"]) == ("NEW", None)
    for row in reporting.later_submit_report(jobs.person_ita_later(*args)).collect():
        assert row[1] == row[2] + row[3] + row[4]


def test_person_pq_tells_matched_from_unknown(spark):
    rows = interactions(spark, [hit(k, "2025-03-01 10:00", 1, funnel="CK_EA") for k in (1, 2, 3)])
    args = (rows, classified(spark, "PQ", ["1", "2", "3"]), types(spark, [("1", "NEW"), ("2", "Unknown")]), PERSONS)
    got = keyed(jobs.person_pq(*args), "person")
    assert {k: (r["cust_type"], r["cust_type_matched"]) for k, r in got.items()} == {
        "1": ("NEW", 1), "2": ("Unknown", 1), "3": ("Unknown", 0),
    }


@pytest.mark.parametrize("name", ["visitor_ita", "visitor_pq"])
def test_lookup_with_several_rows_adds_none(spark, name):
    rows = interactions(spark, [hit(k, "2025-03-01 10:00", 1, funnel="X", gen_url="/apply") for k in range(9)])
    group = "ITA" if name == "visitor_ita" else "PQ"
    several = lookup(spark, [dict(visitor_id=k, customer_id=str(c), cust_type="NEW") for k in range(9) for c in range(2)])
    table = getattr(jobs, name)(rows, repeat(spark, group, range(9)), several, GRAIN)
    assert {r.cust_type for r in table.collect()} == {"Multiple customer IDs"} and table.count() == 9
    assert sum(r[1] for r in reporting.by_category(table, "visitor_id").collect()) == 9
    assert [f.name for f in schemas.contract(name)] == table.columns


@pytest.mark.parametrize("name", ["visitor_ita", "visitor_pq"])
def test_repeat_table_of_a_wider_window_adds_no_rows_from_outside(spark, name):
    """First visits come from the interactions given, whatever the repeat table says."""
    rows = interactions(spark, [hit(1, "2025-03-05 10:00", 2, funnel="X", hard_submit_flag=1), hit(2, "2024-03-01 10:00", 1)])
    group = "ITA" if name == "visitor_ita" else "PQ"
    got = keyed(getattr(jobs, name)(rows, repeat(spark, group, [1, 2]), lookup(spark), GRAIN), "visitor_id")
    assert got[1]["first_visit_id"] == 2 and got[1]["hard_submitted"] == 1
    if name == "visitor_pq":
        assert got[2]["other_reason"] == "No source records in date window"
    else:
        assert set(got) == {1}


@pytest.mark.parametrize("grain", [GRAIN, PERSONS])
def test_jobs_see_the_same_through_the_visit_summary(spark, grain):
    rows = interactions(
        spark,
        [
            hit(v, f"2025-0{1 + (v * k) % 9}-{1 + (v + k) % 5:02} {k % 24:02}:{k:02}", None if k % 7 == 0 else k % 4, funnel=["PQ_OMF", " CK_EA", None, ""][k % 4],
                gen_url=["/apply", None][k % 2], soft_submit_flag=[0, 1, None][k % 3], soft_approval_flag=k % 2, hard_submit_flag=int(k == 11), visitor_flag=int(k % 5 > 0))
            for v in range(1, 12) for k in range(14)
        ] + [hit(None, "2025-03-01 10:00", 1), hit(3, "2027-01-01 10:00", 1), hit(5, "2025-05-05 23:59", 9), hit(5, "2025-05-06 00:01", 9, hard_submit_flag=1)],
    )
    summary = jobs.visit_summary(rows, grain)
    assert summary.agg({"row_count": "sum"}).first()[0] == 11 * 14 + 2
    key = grain.key
    audience = rows.select(key).distinct().selectExpr(key, "'b' as return_bucket", f"if(crc32(cast({key} as string)) % 2 = 0, 'ITA', 'PQ') as first_visit_group")
    if grain is PERSONS:
        made = [lambda t: jobs.person_ita_later(t, audience, types(spark, []), grain), lambda t: jobs.person_pq(t, audience, types(spark, []), grain)]
    else:
        made = [lambda t: jobs.repeat_visitors(t, grain), lambda t: jobs.return_bucket_report(t, grain), lambda t: jobs.repeat_first_visits(t, grain), lambda t: jobs.visitor_ita(t, audience, lookup(spark), grain), lambda t: jobs.visitor_pq(t, audience, lookup(spark), grain)]
    for make in made:
        direct, derived = sorted(map(str, make(rows).collect())), sorted(map(str, make(summary).collect()))
        assert direct == derived and direct


def mixed_hits(spark):
    return interactions(
        spark,
        [hit(v, f"2025-01-0{1 + (v + k) % 3} 0{k % 3}:00", None if (v + k) % 4 == 0 else (v * k) % 3, funnel=[None, " a", "b", ""][k % 4], gen_url="/apply" if k % 3 else None, soft_submit_flag=k % 2,
             hard_submit_flag=int(k == 7), visitor_flag=int((v + k) % 3 > 0)) for v in range(30) for k in range(9)],
    )


def equal(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@pytest.mark.parametrize("trim", [True, False])
def test_all_forms_of_first_visits_agree(spark, trim):
    """By audience, in one pass with the submit days, and in one pass with the return buckets."""
    visits, key = jobs.visit_summary(mixed_hits(spark), GRAIN), "visitor_id"
    expected = V.first_visits(visits, key, trim)
    assert expected.count() == 30
    audience = spark.createDataFrame([(k,) for k in (1, 1, 5, 9, 77, None)], "visitor_id bigint")
    for prune in (False, True):
        got = V.audience_first_visits(visits, audience, key, trim, prune)
        assert equal(got.filter("matched_first_visit_rows > 0 or first_interaction_time is not null"), V.first_visits(visits, key, trim, audience))
        assert sorted(str(r.visitor_id) for r in got.collect()) == ["1", "5", "77", "9", "None"]
        assert {tuple(r)[1:] for r in got.collect() if r.visitor_id in (None, 77)} == {(None, None, None, 0, 0, 0, 0, 0)}
    for flagged in (False, True):
        some = visits.filter("visitor_flag = 1") if flagged else visits
        assert equal(V.first_visits_and_days(visits, key, flagged, trim).drop("submit_days"), V.first_visits(some, key, trim))
    daily = V.daily_first_visits(visits, key, trim)
    assert equal(daily.drop("first"), V.daily_visits(visits, key))
    first = daily.groupBy(key).agg(F.expr("min(first) as first")).select(key, "first.*").select(key, *V.touched(trim), *V.CARRIED)
    assert equal(first, expected)


def test_submit_days_are_one_per_day(spark):
    visits = jobs.visit_summary(mixed_hits(spark), GRAIN)
    days = V.first_visits_and_days(visits, "visitor_id", flagged_only=True).selectExpr("visitor_id", "inline(submit_days)")
    expected = visits.filter("soft_submitted = 1 or hard_submitted = 1").groupBy("visitor_id", "day").agg(F.expr("max(soft_submitted)"), F.expr("max(hard_submitted)"))
    assert days.exceptAll(expected).count() == expected.exceptAll(days).count() == 0


def test_repeat_visitors_in_the_same_pass(spark):
    rows = mixed_hits(spark)
    together = jobs.repeat_first_visits(rows, GRAIN)
    assert equal(together.drop(*V.CARRIED), jobs.repeat_visitors(rows, GRAIN)) and together.count()
    for job in (jobs.visitor_ita, jobs.visitor_pq):
        assert equal(job(rows, None, lookup(spark), GRAIN), job(rows, jobs.repeat_visitors(rows, GRAIN), lookup(spark), GRAIN))
    with pytest.raises(ValueError):
        jobs.repeat_first_visits(rows, PERSONS)
