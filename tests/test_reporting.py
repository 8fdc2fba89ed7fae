"""Reports, look-ups, contracts and table replacement."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from footfall.functions import rules
from footfall.operators import reports as O
from footfall.params import PERSON, VISITOR, DateWindow
from footfall.plans import flows, jobs, reporting
from footfall.queries import PERSON_GRAIN, POPULATION_GRAIN, PERSON_YEARS, TRAFFIC_YEARS, APPLICATION_YEARS, VISITOR_GRAIN, Data
from footfall.sources import schemas, testdata
from footfall.sources.tables import TableBusy, TableStore
from tests.data import at, frame, hit, interactions

SF_DIR = "/root/testdata/sf0.001"


def test_recent_offer_cookies(spark):
    rows = interactions(
        spark,
        [
            hit(1, "2025-03-02 00:00", cookie_id="a", gen_url2="/accounts/Offers"), hit(2, "2025-03-02 00:00", cookie_id="a", gen_url2="/accounts/offers"),
            hit(1, "2025-03-01 23:59", cookie_id="b", gen_url2="/accounts/offers"), hit(1, "2025-03-05 00:00", cookie_id="c", gen_url2="/accounts/offers/1"),
            hit(1, "2025-03-05 00:00", cookie_id="d"),
        ],
    )
    got = [tuple(r) for r in jobs.recent_offer_cookies(rows, date(2025, 4, 1)).collect()]
    assert got == [("a", at("2025-03-02 00:00"))]


def test_url_counts_keep_unknown_urls(spark):
    rows = interactions(spark, [hit(v, "2025-03-01", gen_url2=u) for v, u in [(1, "/apply"), (1, "/APPLY/x"), (2, "/apply"), (1, "/Home"), (3, None), (None, None)]])
    got = [tuple(r) for r in jobs.url_map_visitors(rows).collect()]
    assert got == [("apply-page", 2), ("/Home", 1), (None, 1)]


def test_counts_are_of_distinct_keys(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", None, 2), ("b", "x", 1), ("a", "x", None)], "c string, t string, k int")
    assert [tuple(r) for r in O.count_keys_by(df, ["c", "t"], "k", only={"c": ["a"]}).collect()] == [("a", "x", 1), ("a", None, 1)]


def test_type_report_filters_categories(spark):
    ita = frame(
        spark,
        "visitor_ita",
        [dict(visitor_id=i, first_visit_category=c, cust_type="NEW") for i, c in enumerate([rules.ITA_STARTED, rules.ITA_APPROVED, rules.ITA_SOFT])],
    )
    assert len(reporting.ita_by_type(ita, "visitor_id").collect()) == 2
    assert len(reporting.ita_by_type(ita, "visitor_id", categories=None).collect()) == 3


def test_rows_for_compares_in_the_column_type(spark):
    df = spark.createDataFrame([(7, "7"), (8, "007"), (None, None)], "n long, s string")
    assert O.rows_for(df, "n", "7").count() == O.rows_for(df, "n", 7).count() == O.rows_for(df, "s", 7).count() == 1
    assert O.rows_for(df, "n", "abc").count() == 0
    assert O.rows_for(spark.createDataFrame([("None",), (None,)], "s string"), "s", None).count() == 0


def test_sample_rows(spark):
    df = spark.range(500)
    assert O.sample_rows(df).count() == 100
    assert O.sample_rows(df).exceptAll(df.toDF("id")).count() == 0
    assert O.sample_rows(spark.range(3)).count() == 3
    assert [r[0] for r in O.sample_rows(df, 2, [F.desc("id")]).collect()] == [499, 498]


def test_audit_finds_keys_with_several_types(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None)], "k int, cust_type string")
    assert [tuple(r) for r in reporting.multi_type_audit(df, "k").collect()] == [(1, 2), (2, 1), (3, 0)]


def test_contract_names_what_is_wrong(spark):
    with pytest.raises(ValueError, match="visit_id is missing.*created_at is string, not timestamp_ntz"):
        schemas.check_schema(spark.createDataFrame([], "visitor_id long, customer_id string, created_at string, record_created_timestamp timestamp_ntz"), "traffic_visits")
    wide = spark.createDataFrame([], "extra int, RETURN_BUCKET string, Person string")
    assert schemas.check_schema(wide, "returning_population").columns == ["person", "return_bucket"]


def test_store_takes_one_place(spark):
    with pytest.raises(ValueError):
        TableStore(spark)
    with pytest.raises(ValueError):
        TableStore(spark, root="/tmp/x", database="d")


ROW = dict(appl_key=1, person="1", cust_type="NEW", visit_date=at("2025-01-01"))


@pytest.fixture(params=["folder", "catalog"])
def any_store(spark, request, tmp_path):
    if request.param == "folder":
        yield TableStore(spark, root=str(tmp_path))
        return
    spark.sql("create database replaced")
    yield TableStore(spark, database="replaced")
    spark.sql("drop database replaced cascade")


def versions(store, tmp_path):
    if store.root:
        return [p.name for p in (tmp_path / "person_cust_type").iterdir() if p.is_dir()]
    return [t.name for t in store.spark.catalog.listTables(store.database) if "__" in t.name]


def test_store_replaces_tables(spark, any_store, tmp_path):
    for n in (2, 1, 3, 1):
        stored = any_store.replace("person_cust_type", frame(spark, "person_cust_type", [ROW] * n))
        assert stored.count() == any_store.read("person_cust_type").count() == n
    assert [r.asDict() for r in stored.collect()] == [ROW]
    assert len(versions(any_store, tmp_path)) == 2


def test_failed_write_leaves_the_table(spark, any_store, tmp_path):
    any_store.replace("person_cust_type", frame(spark, "person_cust_type", [ROW]))
    rows = frame(spark, "person_cust_type", [ROW] * 3)
    broken = rows.withColumn("cust_type", F.raise_error(F.lit("lost")).cast("string"))
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            any_store.replace("person_cust_type", broken)
        assert any_store.read("person_cust_type").count() == 1
    assert any_store.replace("person_cust_type", rows).count() == 3


def test_new_version_may_be_made_of_the_old(spark, any_store, tmp_path):
    any_store.replace("person_cust_type", frame(spark, "person_cust_type", [ROW]))
    for n in (2, 4, 8):
        old = any_store.read("person_cust_type")
        assert any_store.replace("person_cust_type", old.unionAll(old)).count() == n


def test_table_written_by_others_becomes_a_version(spark, any_store, tmp_path):
    plain = frame(spark, "person_cust_type", [ROW, ROW])
    if any_store.root:
        plain.write.parquet(f"{any_store.root}/person_cust_type")
    else:
        plain.write.saveAsTable("replaced.person_cust_type")
    assert any_store.read("person_cust_type").count() == 2
    assert any_store.replace("person_cust_type", plain.limit(1)).count() == 1


def test_readers_always_find_the_table(spark, any_store, tmp_path):
    """Also while a table that others made is replaced for the first time."""
    import threading

    rows = frame(spark, "person_cust_type", [ROW, ROW])
    if any_store.root:
        any_store.replace("person_cust_type", rows)
    else:
        rows.write.saveAsTable("replaced.person_cust_type")
    done, seen, faults = threading.Event(), set(), []

    def reader():
        while not done.is_set():
            try:
                seen.add(any_store.read("person_cust_type").count())
            except Exception as error:
                faults.append(str(error)[:300])

    thread = threading.Thread(target=reader)
    thread.start()
    try:
        for n in (3, 4, 5):
            assert any_store.replace("person_cust_type", frame(spark, "person_cust_type", [ROW] * n)).count() == n
    finally:
        done.set()
        thread.join()
    assert not faults and seen <= {2, 3, 4, 5} and seen


def test_tables_of_another_layout_are_refused(spark):
    spark.sql("create database other")
    try:
        store = TableStore(spark, database="other")
        rows = frame(spark, "person_cust_type", [ROW, ROW])
        for make in (lambda w: w.partitionBy("cust_type"), lambda w: w.bucketBy(2, "person"), lambda w: w.format("json")):
            make(rows.write).saveAsTable("other.person_cust_type")
            with pytest.raises(ValueError, match="layout"):
                store.replace("person_cust_type", rows)
            assert spark.table("other.person_cust_type").count() == 2
            spark.sql("drop table other.person_cust_type")
        rows.withColumn("more", F.lit(1)).write.saveAsTable("other.person_cust_type")
        with pytest.raises(ValueError, match="columns"):
            store.replace("person_cust_type", rows)
    finally:
        spark.sql("drop database other cascade")


def test_one_writer_at_a_time(spark, any_store, tmp_path):
    rows = frame(spark, "person_cust_type", [ROW])
    any_store.replace("person_cust_type", rows)
    before = versions(any_store, tmp_path)
    any_store._claim("person_cust_type")
    with pytest.raises(TableBusy):
        any_store.replace("person_cust_type", rows)
    assert any_store.read("person_cust_type").count() == 1 and sorted(versions(any_store, tmp_path)) == sorted(before)
    any_store.release("person_cust_type")
    assert any_store.replace("person_cust_type", rows.unionAll(rows)).count() == 2


def test_only_one_of_two_writers_succeeds(spark, any_store, tmp_path):
    """A second writer that starts while the first one writes gets an error, and the first one's rows are there."""
    rows = frame(spark, "person_cust_type", [ROW])

    class Meddling(type(any_store)):
        def _replace_folder(self, name, df):
            with pytest.raises(TableBusy):
                any_store.replace(name, rows.limit(0))
            super()._replace_folder(name, df)

        def _replace_view(self, name, df):
            with pytest.raises(TableBusy):
                any_store.replace(name, rows.limit(0))
            super()._replace_view(name, df)

    first = Meddling(spark, root=any_store.root, database=any_store.database)
    assert first.replace("person_cust_type", rows).count() == 1
    assert any_store.replace("person_cust_type", rows.unionAll(rows)).count() == 2


def test_clustered_tables_are_not_shuffled_by_key(spark, tmp_path):
    """Repeat visitors, audiences and later activity on stored tables: no exchange by the key, and the same rows."""
    from tests.test_plans import plan, shuffles

    spark.sql("create database clustered")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = Data(spark, SF_DIR)
        population = testdata.returning_population(data.rows, POPULATION_GRAIN)
        store = TableStore(spark, database="clustered", buckets=4)
        tables = flows.build_visitor_tables(data.rows, data.applications, data.traffic, store, VISITOR_GRAIN, TRAFFIC_YEARS, APPLICATION_YEARS)
        tables |= flows.build_person_tables(data.interactions(PERSON_YEARS), data.applications, population, store, PERSON_GRAIN, PERSON_YEARS)
        visits, repeat, lookup = tables["visitor_visits"], tables["repeat_visitors"], tables["visitor_cust_type"]
        persons = tables["person_visits"], tables["person_funnel_type"], tables["person_cust_type"]
        for df, plain in (
            (jobs.repeat_visitors(visits, VISITOR_GRAIN), data.repeat_visitors),
            (jobs.repeat_first_visits(visits, VISITOR_GRAIN).select(*repeat.columns), data.repeat_visitors),
            (jobs.return_buckets(visits, VISITOR_GRAIN), jobs.return_buckets(data.rows, VISITOR_GRAIN)),
            (jobs.person_ita(*persons, PERSON_GRAIN), data.person_ita),
            (jobs.person_ita_later(*persons, PERSON_GRAIN), data.person_ita_later),
        ):
            assert shuffles(df) == [], plan(df)
            assert same(df, plain)
        # Counting customer ids and types expands the look-up, which shuffles that alone.
        ita = jobs.visitor_ita(visits, repeat, lookup, VISITOR_GRAIN)
        assert same(ita, data.visitor_ita) and all("visits" not in part and "repeat" not in part for part in plan(ita).split("Exchange hashpartitioning")[1:])
        # The two sides of the tagged union are clustered alike, and so is the union.
        pq = jobs.person_pq(*persons, PERSON_GRAIN)
        assert same(pq, data.person_pq) and shuffles(pq) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop database clustered cascade")


def test_ordinary_input_types_fit(spark):
    usual = {f.name: f.dataType.simpleString() for f in schemas.contract("interactions")}
    for other in (
        {"interaction_date": "timestamp"},
        {"interaction_date": "date", "visitor_id": "int", "visit_id": "smallint"},
        {"visitor_id": "decimal(38,0)", "person": "bigint", "cookie_id": "decimal(20,0)", "appl_key": "string"},
        {"soft_submit_flag": "bigint", "hard_submit_flag": "boolean", "visitor_flag": "decimal(1,0)", "soft_approval_flag": "tinyint"},
    ):
        kinds = usual | other
        values = dict.fromkeys(kinds, "'1'") | {"interaction_date": "timestamp_ntz'2025-03-01 00:00:00'", "gen_url": "'/apply'"}
        row = spark.sql("select " + ", ".join(f"cast({'true' if kinds[c] == 'boolean' else v} as {kinds[c]}) as {c}" for c, v in values.items()))
        got = schemas.check_schema(row, "interactions")
        assert {f.name: f.dataType.simpleString() for f in got.schema} == usual | ({"interaction_date": "timestamp"} if other.get("interaction_date") == "timestamp" else {})
        (r,) = got.collect()
        assert (r.visitor_id, r.person, r.visit_id, r.appl_key, r.soft_submit_flag, r.hard_submit_flag, r.visitor_flag) == (1, "1", 1, 1, 1, 1, 1)
        assert r.interaction_date == at("2025-03-01")


def test_times_with_a_zone_give_the_same_audience(spark):
    data = Data(spark, SF_DIR)
    zoned = schemas.check_schema(data.rows.withColumn("interaction_date", F.expr("cast(interaction_date as timestamp)")), "interactions")
    repeat = schemas.check_schema(jobs.repeat_visitors(zoned, VISITOR_GRAIN), "repeat_visitors")
    assert repeat.dtypes == data.repeat_visitors.dtypes and same(repeat, data.repeat_visitors)


def test_what_would_lose_data_is_refused(spark):
    for kind in ("double", "decimal(10,2)", "boolean"):
        with pytest.raises(ValueError, match="visitor_id is"):
            schemas.check_schema(frame(spark, "traffic_visits", []).withColumn("visitor_id", F.lit(None).cast(kind)), "traffic_visits")
    for value in ("cast('99999999999999999999' as decimal(38,0))", "'7a'"):
        wide = frame(spark, "traffic_visits", [dict(visit_id=1)]).withColumn("visitor_id", F.expr(value))
        with pytest.raises(Exception, match="visitor_id does not fit bigint"):
            schemas.check_schema(wide, "traffic_visits").collect()


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_adapter_meets_the_contracts(spark):
    data = Data(spark, SF_DIR)
    population = testdata.returning_population(data.rows, POPULATION_GRAIN)
    for name, df in {"interactions": data.rows, "applications": data.applications, "traffic_visits": data.traffic, "returning_population": population}.items():
        assert schemas.check_schema(df, name).columns == schemas.contract(name).names


def test_window_hint_drops_no_row(spark):
    data = Data(spark, SF_DIR)
    window = VISITOR_GRAIN.window
    inside = [f"interaction_date >= '{window.start}'", f"interaction_date < '{window.end}'"]
    hinted, full = data.rows, data.interactions()
    for cond in inside:
        hinted, full = hinted.filter(cond), full.filter(cond)
    assert same(hinted, full)
    person = data.interactions().filter("person = '7'")
    assert same(data.interactions(person="7").filter("person = '7'"), person) and person.count()


def test_visitor_flow_replaces_tables(spark, tmp_path):
    data = Data(spark, SF_DIR)
    store = TableStore(spark, root=str(tmp_path))
    for _ in range(2):
        tables = flows.build_visitor_tables(
            data.rows, data.applications, data.traffic, store, VISITOR_GRAIN, TRAFFIC_YEARS, APPLICATION_YEARS
        )
    for name, df in tables.items():
        assert same(store.read(name), df)
        if name != "visitor_visits":
            assert same(df, getattr(data, name)), name
            assert df.select("visitor_id").distinct().count() == df.count()


def test_person_flow_replaces_tables(spark, tmp_path):
    data = Data(spark, SF_DIR)
    store = TableStore(spark, root=str(tmp_path))
    population = testdata.returning_population(data.rows, POPULATION_GRAIN)
    tables = flows.build_person_tables(
        data.interactions(PERSON_YEARS), data.applications, population, store, PERSON_GRAIN, PERSON_YEARS
    )
    for name in ("person_cust_type", "person_funnel_type", "person_pq"):
        assert same(tables[name], getattr(data, name)), name
    assert same(tables["person_ita"], data.person_ita_later)


def test_default_windows():
    assert VISITOR.window == DateWindow(date(2025, 8, 1), date(2026, 9, 1))
    assert PERSON.window == DateWindow(date(2025, 9, 1), date(2026, 10, 1))
    assert replace(VISITOR, flagged_only=True).flagged_only and PERSON.flagged_only and not PERSON.trim_funnel
