"""Physical plans: what is shuffled, pruned and pushed down."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from footfall.operators import custtype, returns as R
from footfall.plans import flows, jobs
from footfall.queries import APPLICATION_YEARS, PERSON_GRAIN, TRAFFIC_YEARS, VISITOR_GRAIN, queries
from footfall.sources import schemas

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Empty input tables on disk, so that scans and their filters show in the plans."""
    root = tmp_path_factory.mktemp("inputs")
    tables = {}
    for name in [*schemas.INPUTS, *schemas.TABLES]:
        spark.createDataFrame([], schemas.contract(name)).write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    return tables


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> list[str]:
    """Shuffle keys in plan order, without expression ids."""
    found = re.findall(r"Exchange hashpartitioning\((.*), \d+\), ENSURE", plan(df))
    return [re.sub(r"#\d+L?", "", keys) for keys in found]


def test_returns_shuffle_small_keys_last(stored):
    keys = shuffles(jobs.return_buckets(stored["interactions"], VISITOR_GRAIN))
    assert [k.count(",") + 1 for k in keys] == [1, 2, 3]
    assert keys[0] == "visitor_id"


def test_big_aggregations_hash_and_combine_first(stored):
    rows = stored["interactions"]
    tables = stored["person_funnel_type"], stored["person_cust_type"]
    for df in (
        R.daily_visits(rows, "visitor_id"),
        jobs.visit_summary(rows, VISITOR_GRAIN),
        jobs.repeat_visitors(rows, VISITOR_GRAIN),
        jobs.person_pq(rows, *tables, PERSON_GRAIN),
        jobs.person_ita_later(rows, *tables, PERSON_GRAIN),
    ):
        for part in above_scans(df, "interactions"):
            assert "SortAggregate" not in part and "Sort [" not in part and "HashAggregate" in part


def above_scans(df, table):
    """Plan text between each scan of a table and the first shuffle above it."""
    text = plan(df)
    scans = [m.start() for m in re.finditer(rf"/{table}\]", text)]
    assert scans
    return [text[text.rindex("Exchange hashpartitioning", 0, at) : at] for at in scans]


def scans(df, table):
    return len(re.findall(rf"/{table}\]", plan(df)))


def test_interactions_are_scanned_once(stored):
    """Each audience job reads them once; with the stored summary it does not read them at all."""
    rows, lookup = stored["interactions"], stored["visitor_cust_type"]
    for source, name in ((rows, "interactions"), (stored["visitor_visits"], "visitor_visits")):
        assert scans(jobs.repeat_visitors(source, VISITOR_GRAIN), name) == 1
        assert scans(jobs.repeat_first_visits(source, VISITOR_GRAIN), name) == 1
        assert scans(jobs.return_bucket_report(source, VISITOR_GRAIN), name) == 1
        assert scans(jobs.visitor_ita(source, stored["repeat_visitors"], lookup, VISITOR_GRAIN), name) == 1
        assert scans(jobs.visitor_ita(source, None, lookup, VISITOR_GRAIN), name) == 1
        assert scans(jobs.visitor_pq(source, None, lookup, VISITOR_GRAIN), name) == 1
        assert scans(jobs.visitor_pq(source, stored["repeat_visitors"], lookup, VISITOR_GRAIN), name) == 1
    tables = stored["person_funnel_type"], stored["person_cust_type"]
    for source, name in ((rows, "interactions"), (stored["person_visits"], "person_visits")):
        assert scans(jobs.person_funnel_type(stored["returning_population"], source, PERSON_GRAIN), name) == 1
        assert scans(jobs.person_ita(source, *tables, PERSON_GRAIN), name) == 1
        assert scans(jobs.person_pq(source, *tables, PERSON_GRAIN), name) == 1
        assert scans(jobs.person_ita_later(source, *tables, PERSON_GRAIN), name) == 1


def test_flows_scan_interactions_once_and_twice(spark, stored, monkeypatch):
    seen = []

    class Kept:
        def replace(self, name, df):
            seen.append(scans(df, "interactions"))
            return stored[name]

    t = stored
    flows.build_visitor_tables(t["interactions"], t["applications"], t["traffic_visits"], Kept(), VISITOR_GRAIN)
    assert sum(seen) == 1
    seen.clear()
    flows.build_person_tables(t["interactions"], t["applications"], t["returning_population"], Kept(), PERSON_GRAIN)
    assert sum(seen) == 2


def test_audiences_are_read_once(stored):
    """A tagged union: an audience computed in the plan is computed once."""
    lookup = stored["visitor_cust_type"]
    pq = jobs.visitor_pq(stored["interactions"], stored["repeat_visitors"], lookup, VISITOR_GRAIN)
    assert scans(pq, "repeat_visitors") == 1 and plan(pq).count("Join") == 1  # the customer type
    funnel = jobs.person_funnel_type(stored["returning_population"], stored["interactions"], PERSON_GRAIN)
    assert scans(funnel, "returning_population") == 1 and "Join" not in plan(funnel)
    pruned = jobs.visitor_pq(stored["interactions"], stored["repeat_visitors"], lookup, VISITOR_GRAIN, prune=True)
    assert scans(pruned, "repeat_visitors") == 2


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name, most", [("visitor_pq", 5), ("visitor_ita", 5), ("person_funnel_type", 4), ("person_pq", 9), ("person_ita_later", 9), ("return_bucket_report", 2)])
def test_scans_of_registered_queries(spark, name, most):
    assert plan(queries()[name](spark, SF_DIR)).count("FileScan") <= most


def test_total_computes_the_counts_once(stored):
    text = plan(jobs.return_bucket_report(stored["interactions"], VISITOR_GRAIN))
    assert "Expand" in text and len(shuffles(jobs.return_bucket_report(stored["interactions"], VISITOR_GRAIN))) == 5


def test_report_on_the_summary_reads_no_interactions(stored):
    text = plan(jobs.return_bucket_report(stored["visitor_visits"], VISITOR_GRAIN))
    assert "/interactions]" not in text and "struct<visitor_id:bigint,day:date,visit_id:bigint>" in text


def test_buckets_and_first_touch_are_one_chain(stored):
    text = plan(jobs.repeat_visitors(stored["interactions"], VISITOR_GRAIN))
    assert "Join" not in text
    assert [k.count(",") + 1 for k in shuffles(jobs.repeat_visitors(stored["interactions"], VISITOR_GRAIN))] == [1, 2, 3, 5]


def test_latest_row_is_pruned_before_the_shuffle(stored):
    df = custtype.latest_application(stored["applications"], "cust_id", APPLICATION_YEARS)
    before_shuffle = plan(df).split("Exchange hashpartitioning")[-1]
    assert "WindowGroupLimit" in before_shuffle


def test_later_activity_is_in_the_grouping(stored):
    """First visits and submit days meet by key in one grouping; audience and customer type are joined by key, and nothing else."""
    tables = stored["person_visits"], stored["person_funnel_type"], stored["person_cust_type"]
    df = jobs.person_ita_later(*tables, PERSON_GRAIN)
    keys = shuffles(df)
    assert [k for k in keys if "," in k] == ["person, is_day, visit, submit_date"] and len([k for k in keys if "," not in k]) == 3
    assert plan(df).count("Join") == 2


def test_typed_lookup_joins_reduced_rows(stored):
    text = plan(custtype.visitor_candidates(stored["traffic_visits"], stored["applications"], TRAFFIC_YEARS, APPLICATION_YEARS))
    assert "LeftOuter" not in text
    assert text.count("SortMergeJoin") == 1


@pytest.fixture
def eager_skew_split(spark):
    """Thresholds small enough for test data."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_shared_applications_and_customers_are_split(spark, stored, eager_skew_split):
    """One application of many people, one customer of many visitors: the join splits the partition."""
    years = APPLICATION_YEARS
    day = "timestamp_ntz'1997-05-01 00:00:00'"
    many = spark.range(40000).repartition(8)
    apps = spark.range(2000).selectExpr(
        "id as appl_key", "cast(id as string) as cust_id", "'NEW' as cust_type", f"{day} as tran_date", f"{day} as appl_entry_dt"
    )
    seen = many.selectExpr(
        "if(id % 3 = 0, 1, id % 2000) as appl_key", "cast(id as string) as person", f"{day} as interaction_date"
    )
    traffic = many.selectExpr(
        "id as visitor_id", "cast(if(id % 3 = 0, 1, id % 2000) as string) as customer_id", f"{day} as created_at",
        f"{day} as record_created_timestamp",
    )
    for df in (
        custtype.person_candidates(seen, apps, years),
        custtype.visitor_candidates(traffic, apps, years, years),
    ):
        assert len(df.collect()) == 40000
        assert "SortMergeJoin(skew=true)" in plan(df)


@pytest.mark.parametrize(
    "make, pushed",
    [
        (lambda t: R.slice_window(t["interactions"], "interaction_date", VISITOR_GRAIN.window).select("visitor_id"), "interaction_date"),
        (lambda t: R.slice_window(t["applications"], "tran_date", APPLICATION_YEARS).select("cust_id"), "tran_date"),
        (lambda t: jobs.return_buckets(t["interactions"], VISITOR_GRAIN), "interaction_date"),
        (lambda t: jobs.visit_summary(t["interactions"], PERSON_GRAIN), "interaction_date"),
    ],
)
def test_windows_reach_the_scan(stored, make, pushed):
    filters = re.search(r"PushedFilters: \[(.*?)\]", plan(make(stored))).group(1)
    assert f"GreaterThanOrEqual({pushed}" in filters and f"LessThan({pushed}" in filters


def test_rows_without_a_join_key_are_dropped_at_the_scan(stored):
    def below_first_grouping(df, table):
        """Plan text of the branch that scans ``table``, under its last shuffle."""
        text = plan(df)
        scan = text.index(f"/{table}]")
        return text[text.rindex("Exchange hashpartitioning", 0, scan) : scan]

    seen = custtype.person_candidates(stored["interactions"], stored["applications"], APPLICATION_YEARS)
    assert "isnotnull(appl_key" in below_first_grouping(seen, "interactions")
    traffic = custtype.visitor_candidates(
        stored["traffic_visits"], stored["applications"], TRAFFIC_YEARS, APPLICATION_YEARS
    )
    assert "isnotnull(try_cast(customer_id" in below_first_grouping(traffic, "traffic_visits")


def test_scans_read_only_needed_columns(stored):
    text = plan(jobs.return_buckets(stored["interactions"], VISITOR_GRAIN))
    assert re.search(r"ReadSchema: struct<(.*?)>", text).group(1) == (
        "visitor_id:bigint,visit_id:bigint,interaction_date:timestamp_ntz"
    )


def test_small_audience_prunes_rows_before_grouping(spark, stored):
    """The semi-join moves below the groupings when the audience can be broadcast, and only then."""
    tables = stored["person_funnel_type"], stored["person_cust_type"]
    first = "partial_min(interaction_date"
    for make in (
        lambda: jobs.person_ita(stored["interactions"], *tables, PERSON_GRAIN),
        lambda: jobs.person_pq(stored["interactions"], *tables, PERSON_GRAIN, prune=True),
    ):
        text = plan(make())
        assert text.index("LeftSemi") < text.index(first)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        text = plan(make())
        assert text.rindex(first) < text.rindex("LeftSemi")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_small_audience_prunes_visits_before_their_days(spark, stored):
    """In the one pass with the submit days the semi-join stops above the exploding, which is before the first shuffle of the summary."""
    make = lambda: jobs.person_ita_later(stored["person_visits"], stored["person_funnel_type"], stored["person_cust_type"], PERSON_GRAIN)
    text = plan(make())
    assert text.index("LeftSemi") < text.index("hashpartitioning(person") < text.index("Generate")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    text = plan(make())
    assert text.index("is_day") < text.index("LeftSemi") and not re.search(r"hashpartitioning\(person.*LeftSemi.*hashpartitioning\(person.*Generate", text, re.S)


def test_large_audience_prunes_by_a_bloom_filter(spark, tmp_path):
    """An audience too large to broadcast: Spark's runtime filter drops rows of other keys at the scan, before the first grouping."""
    rows = spark.range(2000).selectExpr("cast(id as string) as person", "timestamp_ntz'1996-05-01 10:00:00' as interaction_date", "id as visit_id", "1 as visitor_flag")
    for name, df in (("interactions", schemas_filled(rows, "interactions")), ("person_funnel_type", schemas_filled(rows.selectExpr("person", "if(visit_id < 50, 'ITA', 'PQ') as first_visit_group"), "person_funnel_type"))):
        df.write.parquet(f"{tmp_path}/{name}")
    settings = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        classified = spark.read.parquet(f"{tmp_path}/person_funnel_type")
        lookup = spark.createDataFrame([], schemas.contract("person_cust_type"))
        df = jobs.person_ita(spark.read.parquet(f"{tmp_path}/interactions"), classified, lookup, PERSON_GRAIN)
        text = plan(df)
        assert "might_contain" in text and text.rindex("partial_min(interaction_date") < text.rindex("might_contain")
        assert df.count() == 50
    finally:
        for k in settings:
            spark.conf.unset(k)


def schemas_filled(df, name):
    """``df`` with the columns of a table that it lacks, as NULL."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.contract(name).fields])


def test_times_with_a_zone_reach_the_scan(spark, stored, tmp_path):
    zoned = stored["interactions"].withColumn("interaction_date", F.expr("cast(interaction_date as timestamp)"))
    zoned.write.parquet(f"{tmp_path}/interactions")
    rows = schemas.check_schema(spark.read.parquet(f"{tmp_path}/interactions"), "interactions")
    filters = re.search(r"PushedFilters: \[(.*?)\]", plan(jobs.return_buckets(rows, VISITOR_GRAIN))).group(1)
    assert "GreaterThanOrEqual(interaction_date" in filters and "LessThan(interaction_date" in filters


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name, column", [("recent_offer_cookies", "o_orderdate"), ("interactions_for", "o_custkey")])
def test_look_ups_reach_the_scan_of_the_orders(spark, name, column):
    text = plan(queries()[name](spark, SF_DIR))
    pushed = [f for f in re.findall(r"PushedFilters: \[(.*?)\]", text) if f"({column}" in f]
    assert any("GreaterThanOrEqual(o_orderdate" in f or "EqualTo(o_custkey,7" in f for f in pushed)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name", sorted(queries()))
def test_no_query_crosses_or_leaves_the_jvm(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoop|Python|Pandas|MapInArrow", text)
