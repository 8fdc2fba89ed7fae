"""First touch, latest row, audience filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import touch as T, visits as V
from tests.data import at, hit, interactions, keyed


def test_first_touch_order(spark):
    rows = interactions(
        spark,
        [
            hit(1, "2025-03-02 10:00", 1, funnel="B"), hit(1, "2025-03-01 10:00", 9, funnel="A"),
            # same time: smaller visit id first, a missing one last
            hit(2, "2025-03-01 10:00", None, funnel="A"), hit(2, "2025-03-01 10:00", 5, funnel="C"), hit(2, "2025-03-01 10:00", 3, funnel="D"),
            # same visit: smaller funnel first, a missing one last
            hit(3, "2025-03-01 10:00", 5, funnel=None), hit(3, "2025-03-01 10:00", 5, funnel="Z"), hit(3, "2025-03-01 10:00", 5, funnel=" Y"),
            hit(4, "2025-03-01 10:00", None, funnel="  "),
        ],
    )
    visits = V.summarise(rows, "visitor_id")
    trimmed = keyed(V.first_touch(visits, "visitor_id"), "visitor_id")
    facts = {k: (r["first_visit_id"], r["first_visit_funnel"]) for k, r in trimmed.items()}
    assert facts == {1: (9, "A"), 2: (3, "D"), 3: (5, "Y"), 4: (None, "Unknown")}
    raw = keyed(V.first_touch(visits, "visitor_id", trim_funnel=False), "visitor_id")
    assert [raw[k]["first_visit_funnel"] for k in (1, 2, 3, 4)] == ["A", "D", " Y", "  "]


def test_first_touch_equals_sorted_window(spark):
    from tests.test_returns import random_hits

    rows = interactions(spark, random_hits(11)).filter("visitor_id is not null")
    order = (
        "row_number() over (partition by visitor_id order by interaction_date, visit_id asc nulls last, "
        "nullif(trim(funnel), '') asc nulls last) as n"
    )
    ranked = rows.selectExpr("*", order).filter("n = 1").selectExpr(
        "visitor_id", "visit_id", "interaction_date", "coalesce(nullif(trim(funnel), ''), 'Unknown')"
    )
    got = V.first_touch(V.summarise(rows, "visitor_id"), "visitor_id")
    assert sorted(map(str, got.collect())) != [] and got.exceptAll(ranked).count() == ranked.exceptAll(got).count() == 0


def test_latest_counts_missing_dates_as_latest(spark):
    df = spark.createDataFrame(
        [("a", at("2025-01-01"), 1), ("a", None, 2), ("b", at("2025-01-01"), 3), ("b", at("2025-01-02"), 4),
         ("c", at("2025-01-01"), 6), ("c", at("2025-01-01"), 5), (None, at("2025-01-01"), 7), (None, at("2025-01-03"), 8)],
        "k string, t timestamp_ntz, n int",
    )
    got = {r[0]: r[2] for r in T.latest_per_key(df, "k", "t", "n asc nulls last").collect()}
    assert got == {"a": 2, "b": 4, "c": 5, None: 8}


def test_restrict_to_ignores_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    audience = spark.createDataFrame([(1,), (1,), (None,), (3,)], "k int")
    got = sorted(r["v"] for r in T.restrict_to(df, audience, "k").collect())
    assert got == ["x", "y"]
    joined = df.join(audience.distinct(), "k").select(F.col("v")).collect()
    assert sorted(r[0] for r in joined) == got
