"""Rule tables and scalar expressions."""

from __future__ import annotations

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.functions import columns as C, rules
from footfall.params import DateWindow, YearSet
from tests.data import at


def values(spark, items, expr, kind="string"):
    """``expr`` over column x for each item, in order."""
    df = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_url_rules_first_match_wins(spark):
    urls = {
        "/Offers/no-ding/lookup/30393/x": "no-ding-email",
        "/accounts/reapply": "account-reapply",
        "/accounts/check-offers": "account-check-offers",
        "/accounts/GET-started": "account-get-started",
        "/my/Application/1": "application",
        "/affiliate/application": "application",
        "/affiliate/x": "affiliate-link",
        "/apply": "apply-page",
        "/accounts/offers": "account-offers",
        "/accounts/offers/1": "/accounts/offers/1",
        "/ppc/a": "ppc-page",
        "/check-offers/###": "wizard-check-offer-page",
        "/check-offers/123": "/check-offers/123",
        "/Home": "/Home",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").selectExpr("u", "lower(u) as low")
    got = {r[0]: r[1] for r in df.select("u", C.first_like("low", rules.URL_RULES, "u")).collect()}
    assert got == urls


def test_app_start_patterns(spark):
    yes = ["/check/offers", "/prequalification/Start", "/APPLICATION", "/prequalification", "/account/x/reapply",
           "/prequalification-started", "/account/get/started", "/Apply"]
    no = ["/offers/check", "http://h/prequalification", "/prequalification/", "/account/started/get", "/home", "", None]
    assert values(spark, yes + no, F.when(C.any_like("lower(x)", rules.APP_START_PATTERNS), 1).otherwise(0)) == (
        [1] * len(yes) + [0] * len(no)
    )


def test_guards_do_not_change_a_match(spark):
    rng = random.Random(7)
    words = ["check", "offers", "account", "accounts", "get", "started", "start", "reapply", "apply", "application",
             "prequalification", "/", "-", "###", "no", "ding", "lookup", "30393", "X", "\n"]
    urls = ["".join(rng.choices(words, k=rng.randint(0, 7))).swapcase() for _ in range(600)]
    patterns = [*rules.APP_START_PATTERNS, *(r.pattern for r in rules.URL_RULES), rules.OFFER_PAGE_PATTERN, "%a_p%ly%"]
    df = spark.createDataFrame([(u,) for u in urls], "x string")
    for pattern in patterns:
        plain, guarded = F.col("x").ilike(pattern), F.expr(C.matches("lower(x)", pattern))
        assert df.filter(plain != guarded).count() == 0, pattern


def test_literals_are_escaped(spark):
    odd = ["it's", "back\\slash", "a%b"]
    for value in odd:
        assert spark.range(1).select(F.expr(C.text(value))).first()[0] == value


def test_thousands(spark):
    assert values(spark, [0, 7, 999, 1234567, 999999999, 10**9, None], C.thousands("x"), "long") == [
        "           0", "           7", "         999", "   1,234,567", " 999,999,999", "#" * 12, None,
    ]


def test_numeric_key(spark):
    got = values(spark, ["12.5", "-12.5", " 12 ", "", "abc", "007", "1e3", None], C.numeric_key("x"))
    assert [None if v is None else int(v) for v in got] == [13, -13, 12, None, None, 7, 1000, None]


def test_funnel_cleaning_and_groups(spark):
    assert values(spark, [" PQ_OMF ", "", "  ", None, "\tx"], C.clean_funnel("x")) == [
        "PQ_OMF", "Unknown", "Unknown", "Unknown", "\tx",
    ]
    for group, codes in rules.FUNNEL_GROUPS.items():
        assert set(values(spark, list(codes), C.funnel_group("x"))) == {group}
    others = [" PQ_OMF ", "pq_omf", "Unknown", "", None]
    assert set(values(spark, others, C.funnel_group("x"))) == {"Unmapped"}
    assert [len(c) for c in rules.FUNNEL_GROUPS.values()] == [5, 12]


def test_return_bucket_edges(spark):
    b = rules.RETURN_BUCKETS
    expected = {None: b.none, 1: "2", 30: "2", 31: "3", 60: "3", 61: "4", 90: "4", 91: "5", 365: "5", 366: "6", 4000: "6"}
    df = spark.createDataFrame([(1, g) for g in expected] + [(2, g) for g in expected] + [(0, 5)], "n long, gap int")
    for n, gap, bucket in df.select("n", "gap", C.return_bucket("n", "gap", b)).collect():
        assert bucket == b.same_day if n > 1 else bucket.startswith(expected.get(gap, "2")[0])


# Category number per (soft, approved) = 00, 01, 10, 11, by what else happened.
STAGES = {
    ("hard submit",): "4444",
    ("no app start",): "5555",
    ("app start", "FA_OMF"): "1111",
    ("app start", "other funnel"): "1132",
}


def expected_stage(funnel, app, soft, approved, hard):
    if hard:
        row = ("hard submit",)
    elif not app:
        row = ("no app start",)
    else:
        row = ("app start", "FA_OMF" if funnel == "FA_OMF" else "other funnel")
    return STAGES[row][2 * soft + approved]


def test_ita_category_truth_table(spark):
    cases = list(itertools.product(["FA_OMF", "PQ_OMF", "Unknown"], (0, 1), (0, 1), (0, 1), (0, 1)))
    df = spark.createDataFrame(cases, "f string, app int, soft int, approved int, hard int")
    got = df.select("*", C.ita_category("f", "app", "soft", "approved", "hard")).collect()
    assert len(got) == 48
    for row in got:
        assert row[5][0] == expected_stage(*row[:5]), row
    labels = {r[5] for r in got}
    assert labels == {rules.ITA_STARTED, rules.ITA_APPROVED, rules.ITA_SOFT, rules.ITA_HARD, rules.ITA_OTHER}


def test_ita_category_with_null_flags(spark):
    """What the conditions of the stages, spelled out one by one, give when a flag is missing."""
    cases = [c for c in itertools.product(["FA_OMF", "PQ_OMF", None], *[(0, 1, None)] * 4) if None in c]
    df = spark.createDataFrame(cases, "f string, app int, soft int, approved int, hard int")
    no, yes = (lambda x: x == 0), (lambda x: x == 1)
    for f, app, soft, approved, hard, got in df.select("*", C.ita_category("f", "app", "soft", "approved", "hard")).collect():
        only, other = f == "FA_OMF", f not in (None, "FA_OMF")
        started = yes(app) and (only and no(hard) or other and no(soft))
        approved_only = other and yes(app) and yes(soft) and yes(approved) and no(hard)
        soft_only = other and yes(app) and yes(soft) and no(approved)
        stage = "4" if yes(hard) else "1" if started else "2" if approved_only else "3" if soft_only else "5"
        assert got[0] == stage, (f, app, soft, approved, hard)


def test_ita_reasons_with_null_flags(spark):
    df = spark.createDataFrame([(2, 0, None), (2, None, 1), (2, None, 0), (None, 0, 0), (0, None, None)], "m long, app int, soft int")
    assert [r[0][0] for r in df.select(C.ita_other_reason("m", "app", "soft")).collect()] == ["4", "4", "4", "3", "1"]


def test_year_sets_with_gaps(spark):
    assert YearSet.of(2024, 2026, 2025).ranges == DateWindow.years(2024, 2026).ranges
    df = spark.sql("select timestamp_ntz'2020-06-01 00:00:00' + make_ym_interval(id) as t, 2020 + id as y from range(8) as r(id)")
    years = YearSet.of(2021, 2023, 2024)
    assert {r.y for r in df.filter(C.in_window("t", years)).collect()} == years.years
    with pytest.raises(ValueError):
        YearSet.of()


def test_ita_reasons(spark):
    df = spark.createDataFrame([(0, 0, 1), (2, 0, 1), (2, 0, 0), (2, 1, 0)], "m long, app int, soft int")
    got = [r[0] for r in df.select(C.ita_other_reason("m", "app", "soft")).collect()]
    assert [g[0] for g in got] == ["1", "2", "3", "4"]


def test_pq_reasons_and_categories(spark):
    now = at("2025-03-01")
    rows = [(None, None, 0, 0), (now, None, 0, 0), (now, 1, 0, 0), (now, 1, 2, 0), (now, 1, 2, 1)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v long, m long, hard int")
    df = df.withColumn("why", C.pq_other_reason("t", "v", "m"))
    got = [tuple(r) for r in df.select("why", C.pq_category("why", "hard")).collect()]
    assert got == [
        ("No source records in date window", "3. Other"),
        ("Missing first visit ID", "3. Other"),
        ("No matching first-visit records", "3. Other"),
        (None, "1. Prequalified, no hard submit"),
        (None, "2. Hard submitted"),
    ]


def test_days_are_calendar_days(spark):
    df = spark.createDataFrame(
        [(at("2025-01-01 23:00"), at("2025-01-02 01:00")), (at("2025-01-01 01:00"), None)],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert [r[0] for r in df.select(C.days_between("a", "b")).collect()] == [1, None]


def test_flag_is_zero_for_null(spark):
    assert values(spark, [1, 0, None, 2], C.flag("x = 1"), "int") == [1, 0, 0, 0]


def test_window_is_half_open_in_any_time_zone(spark):
    window = DateWindow.years(2025, 2025)
    times = [datetime(2024, 12, 31, 23, 59, 59, 999999), datetime(2025, 1, 1), datetime(2025, 12, 31, 23, 59), datetime(2026, 1, 1), None]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert values(spark, times, C.in_window("x", window), "timestamp_ntz") == [False, True, True, False, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_window_is_refused():
    with pytest.raises(ValueError):
        DateWindow.years(2025, 2024)
