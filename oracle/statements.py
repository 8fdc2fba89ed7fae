"""Oracle SQL: what each query must return, in DuckDB's dialect.

Each relation is a named SELECT that may use the relations before it; a statement
puts the relations it needs in a WITH clause. They are written for clarity and in
DuckDB idiom (DISTINCT ON, FILTER, regular expressions), not after the Spark plans.
"""

from __future__ import annotations

import re

# Labels, codes and patterns below are fixed values: results are compared by them.

W13 = "interaction_date >= timestamp '1996-01-01' and interaction_date < timestamp '1997-02-01'"
WALL = "interaction_date >= timestamp '1995-01-01' and interaction_date < timestamp '2002-01-01'"

# --------------------------------------------------------------------------- inputs

_URLS = (
    "['/offers/no-ding/lookup/30393', '/accounts/reapply', '/accounts/check-offers', '/accounts/get-started', "
    "'/Application/step1', '/affiliate/x', '/apply', '/accounts/offers', '/ppc/a', '/check-offers/###', "
    "'/prequalification', null, 'http://h/prequalification', '/home']"
)

INPUTS = {
    "interactions": f"""
        select o_custkey as visitor_id,
               cast(o_custkey as varchar) as person,
               'c' || o_custkey as cookie_id,
               case when o_orderkey % 53 <> 0 then o_orderkey end as visit_id,
               o_orderdate + to_minutes(l_linenumber) as interaction_date,
               (['PQ_OMF', 'PQ_Email', 'FA_OMF', 'PQ_OAM', 'Others',
                 'Affiliat_API', 'CK_EA', 'Affiliate_Remarketing_Multiple', 'FA_Aff_Link', 'Direct_Mail', 'FA_Email',
                 'Affiliate_Remarketing_Single', 'EA_Remarketing', 'CK_LB', 'Exp_Act_WH', 'ND_FA_Email', 'FA_OAM',
                 '', null, ' PQ_OMF '])[o_orderkey % 20 + 1] as funnel,
               ({_URLS})[l_partkey % 14 + 1] as gen_url,
               ({_URLS})[l_suppkey % 14 + 1] as gen_url2,
               cast(case l_returnflag when 'R' then 1 when 'A' then 0 end as integer) as soft_submit_flag,
               cast(l_returnflag = 'R' and l_linestatus = 'F' as integer) as soft_approval_flag,
               cast(l_quantity >= 48 as integer) as hard_submit_flag,
               cast(o_orderkey % 10 <> 7 as integer) as visitor_flag,
               o_orderkey as appl_key
        from orders join lineitem on l_orderkey = o_orderkey""",
    "applications": """
        select o_orderkey as appl_key, cast(o_custkey as varchar) as cust_id,
               (['NEW', 'FORMER', ' present ', null, '', 'New'])[o_orderkey % 6 + 1] as cust_type,
               o_orderdate as tran_date,
               case when o_orderkey % 41 <> 0 then o_orderdate end as appl_entry_dt
        from orders
        union all
        select o_orderkey, cast(o_custkey as varchar), 'RENEWED', o_orderdate, o_orderdate + to_days(1)
        from orders where o_orderkey % 9 = 0""",
    "traffic": """
        select user_id as visitor_id, event_id as visit_id,
               case event_id % 4 when 0 then cast(user_id as varchar)
                                 when 1 then (user_id + 1) || '.0'
                                 when 2 then 'abc' end as customer_id,
               ts as created_at, ts + to_days(1) as record_created_timestamp
        from events""",
}

# --------------------------------------------------------------------------- operators


def _buckets(key: str, where: str, none: str = "7. No repeat visits") -> str:
    """Return bucket per key: each active day is measured against the key's first."""
    return f"""
        select {key}, max(visits) as max_visit_ids_in_day,
               cast(min(day - day0) filter (where day > day0) as integer) as min_return_gap,
               case when max_visit_ids_in_day > 1 then '1. Same day return'
                    when min_return_gap is null then '{none}'
                    when min_return_gap <= 30 then '2. Returned within 1-30 days'
                    when min_return_gap <= 60 then '3. Returned within 31-60 days'
                    when min_return_gap <= 90 then '4. Returned within 61-90 days'
                    when min_return_gap <= 365 then '5. Returned within 91-365 days'
                    else '6. Returned after more than 1 year' end as return_bucket
        from (select *, min(day) over (partition by {key}) as day0
              from (select {key}, cast(interaction_date as date) as day, count(distinct visit_id) as visits
                    from interactions where {where} and {key} is not null group by all))
        group by {key}"""


_CLEAN = "nullif(trim(funnel), '')"


def _first(key: str, where: str, funnel: str = _CLEAN) -> str:
    """Earliest row per key."""
    return f"""
        select distinct on ({key}) {key}, visit_id as first_visit_id, interaction_date as first_interaction_time,
               {funnel} as first_funnel
        from interactions where {where} and {key} is not null
        order by {key}, interaction_date, visit_id nulls last, {funnel} nulls last"""


def _group(funnel: str) -> str:
    return f"""case when {funnel} in ('PQ_OMF', 'PQ_Email', 'FA_OMF', 'PQ_OAM', 'Others') then 'ITA'
                    when {funnel} in ('Affiliat_API', 'CK_EA', 'Affiliate_Remarketing_Multiple', 'FA_Aff_Link',
                                      'Direct_Mail', 'FA_Email', 'Affiliate_Remarketing_Single', 'EA_Remarketing',
                                      'CK_LB', 'Exp_Act_WH', 'ND_FA_Email', 'FA_OAM') then 'PQ'
                    else 'Unmapped' end"""


_STARTED = (
    "regexp_matches(gen_url, 'check.*offers|prequalification.*start|application|account.*reapply"
    "|account.*get.*started|apply', 'is') or lower(gen_url) = '/prequalification'"
)


def _activity(key: str, where: str, audience: str, group: str) -> str:
    """First visit of every key in a group, and what happened in it."""
    return f"""
        select a.{key}, first_visit_id, first_interaction_time, coalesce(first_funnel, 'Unknown') as funnel_name,
               first_funnel, coalesce(bool_or({_STARTED}), false) as app,
               coalesce(bool_or(soft_submit_flag = 1), false) as soft,
               coalesce(bool_or(soft_approval_flag = 1), false) as approved,
               coalesce(bool_or(hard_submit_flag = 1), false) as hard,
               count(d.{key}) as matched_first_visit_rows
        from (select distinct {key} from {audience} where first_visit_group = '{group}') a
        left join first_{key} f on f.{key} = a.{key}
        left join (select * from interactions where {where}) d on d.{key} = f.{key} and d.visit_id = f.first_visit_id
        group by all"""


def _ita(key: str, activity: str) -> str:
    return f"""
        select {key}, first_visit_id, first_interaction_time, funnel_name as first_visit_funnel,
               cast(app as integer) as app_started, cast(soft as integer) as soft_submitted,
               cast(approved as integer) as soft_approved, cast(hard as integer) as hard_submitted,
               matched_first_visit_rows,
               case when hard then '4. Hard submitted'
                    when app and funnel_name = 'FA_OMF' then '1. App started, no submit'
                    when app and not soft then '1. App started, no submit'
                    when app and approved then '2. Soft approved, no hard submit'
                    when app then '3. Soft submitted, not soft approved'
                    else '5. Other' end as first_visit_category
        from {activity} where first_interaction_time is not null"""


def _pq(key: str, activity: str) -> str:
    return f"""
        select {key}, first_visit_id, first_interaction_time,
               case when first_interaction_time is not null then funnel_name end as first_visit_funnel,
               matched_first_visit_rows, cast(hard as integer) as hard_submitted,
               case when matched_first_visit_rows = 0 then '3. Other'
                    when hard then '2. Hard submitted'
                    else '1. Prequalified, no hard submit' end as first_visit_category,
               case when matched_first_visit_rows > 0 then null
                    when first_interaction_time is null then 'No source records in date window'
                    when first_visit_id is null then 'Missing first visit ID'
                    else 'No matching first-visit records' end as other_reason
        from {activity}"""


def _with_summary(audience: str, lookup: str = "visitor_cust_type") -> str:
    """Visitor audience with the customer types its lookup rows sum up to."""
    return f"""
        select a.*, coalesce(case when ids > 1 then 'Multiple customer IDs'
                                  when types > 1 then 'Multiple customer types' else one_type end, 'Unknown') as cust_type,
               coalesce(ids, 0) as customer_id_count, coalesce(types, 0) as cust_type_count
        from {audience} a
        left join (select visitor_id, count(distinct nullif(trim(customer_id), '')) as ids,
                          count(distinct nullif(upper(trim(cust_type)), '')) as types,
                          max(nullif(upper(trim(cust_type)), '')) as one_type
                   from {lookup} group by visitor_id) using (visitor_id)"""


RELATIONS = {
    **INPUTS,
    # customer types
    "customer_type": """
        select distinct on (cust_id) cust_id, cust_type from applications where year(tran_date) between 1996 and 1998
        order by cust_id, appl_entry_dt desc nulls first, appl_key desc nulls last, cust_type asc nulls last""",
    "application_type": """
        select distinct on (appl_key) appl_key, cust_type from applications where year(tran_date) between 1996 and 1997
        order by appl_key, appl_entry_dt desc nulls first, cust_type asc nulls last""",
    "visitor_candidates": """
        select visitor_id, customer_id, cust_id, cust_type, min(created_at) as visit_date
        from traffic join customer_type
          on try_cast(customer_id as decimal(38, 0)) = try_cast(cust_id as decimal(38, 0))
        where year(record_created_timestamp) = 2024 and cust_type is not null
        group by all""",
    "visitor_cust_type": """
        select distinct on (visitor_id) * from visitor_candidates
        order by visitor_id, visit_date desc nulls first, customer_id, cust_id, cust_type""",
    "person_candidates": """
        select appl_key, person, cust_type, min(interaction_date) as visit_date
        from interactions join application_type using (appl_key)
        where year(interaction_date) between 1996 and 1997 and cust_type is not null
        group by all""",
    "person_cust_type": """
        select distinct on (person) * from person_candidates
        order by person, visit_date desc nulls first, appl_key, cust_type""",
    # visitor audiences
    "visitor_buckets": _buckets("visitor_id", W13),
    "visitor_buckets_wide": _buckets("visitor_id", WALL),
    "first_visitor_id": _first("visitor_id", W13),
    "repeat_visitors": f"""
        select visitor_id, return_bucket, first_visit_id, first_interaction_time,
               coalesce(first_funnel, 'Unknown') as first_visit_funnel, {_group("first_funnel")} as first_visit_group
        from visitor_buckets join first_visitor_id using (visitor_id)
        where return_bucket not like '7.%'""",
    "visitor_ita_activity": _activity("visitor_id", W13, "repeat_visitors", "ITA"),
    "visitor_pq_activity": _activity("visitor_id", W13, "repeat_visitors", "PQ"),
    "visitor_ita_stage": _ita("visitor_id", "visitor_ita_activity"),
    "visitor_pq_stage": _pq("visitor_id", "visitor_pq_activity"),
    "visitor_ita": _with_summary("visitor_ita_stage"),
    "visitor_pq": _with_summary("visitor_pq_stage"),
    "first_wide": _first("visitor_id", WALL),
    "repeat_wide": f"""
        select visitor_id, {_group("first_funnel")} as first_visit_group
        from visitor_buckets_wide join first_wide using (visitor_id) where return_bucket not like '7.%'""",
    "visitor_ita_wide": _activity("visitor_id", W13, "repeat_wide", "ITA"),
    "visitor_pq_wide": _activity("visitor_id", W13, "repeat_wide", "PQ"),
    "visitor_ita_wide_stage": _ita("visitor_id", "visitor_ita_wide"),
    "visitor_pq_wide_stage": _pq("visitor_id", "visitor_pq_wide"),
    "second_types": """
        select * from visitor_cust_type union all
        select visitor_id, customer_id, cust_id, 'SECOND', visit_date from visitor_cust_type where visitor_id % 5 = 0""",
    # person audiences
    "returning_population": _buckets("person", W13, none="7. No repeat identified"),
    "first_flagged": _first("person", f"{W13} and visitor_flag = 1", funnel="funnel"),
    "person_funnel_type": f"""
        select distinct person, return_bucket, first_interaction_time, first_funnel as first_visit_funnel,
               {_group("first_funnel")} as first_visit_group
        from returning_population left join first_flagged using (person)
        where return_bucket not ilike '%no%repeat%identified%'""",
    "first_person": _first("person", f"{W13} and visitor_flag = 1"),
    "person_ita_activity": _activity("person", f"{W13} and visitor_flag = 1", "person_funnel_type", "ITA"),
    "person_pq_activity": _activity("person", f"{W13} and visitor_flag = 1", "person_funnel_type", "PQ"),
    "person_ita_stage": _ita("person", "person_ita_activity"),
    "person_pq_stage": _pq("person", "person_pq_activity"),
    "person_ita": """
        select s.*, t.cust_type from person_ita_stage s left join person_cust_type t on t.person = s.person""",
    "person_pq": """
        select s.*, coalesce(t.cust_type, 'Unknown') as cust_type,
               cast(t.person is not null as integer) as cust_type_matched
        from person_pq_stage s left join person_cust_type t on t.person = s.person""",
    "person_ita_later": f"""
        select i.*, cast(soft_day is not null as integer) as later_soft_submitted,
               cast(hard_day is not null as integer) as later_hard_submitted,
               soft_day as first_later_soft_submit_date, hard_day as first_later_hard_submit_date,
               cast(soft_day - cast(first_interaction_time as date) as integer) as days_to_later_soft_submit,
               cast(hard_day - cast(first_interaction_time as date) as integer) as days_to_later_hard_submit
        from person_ita i
        left join (select f.person, min(cast(interaction_date as date)) filter (where soft_submit_flag = 1) as soft_day,
                          min(cast(interaction_date as date)) filter (where hard_submit_flag = 1) as hard_day
                   from first_person f join interactions d on d.person = f.person
                   where cast(interaction_date as date) > cast(first_interaction_time as date)
                     and interaction_date < timestamp '1997-02-01'
                   group by f.person) l on l.person = i.person""",
}


def _report(buckets: str) -> str:
    return f"""
        select return_bucket, lpad(format('{{:,}}', n), 12, ' ') as visitor_count
        from (select coalesce(return_bucket, 'Total') as return_bucket, count(*) as n
              from {buckets} group by grouping sets ((return_bucket), ()))
        order by return_bucket"""


def _repeaters(buckets: str) -> str:
    return f"select * from {buckets} where min_return_gap is not null or max_visit_ids_in_day > 1"


def _counts(table: str, key: str, dims: str, where: str = "true", name: str = "visitor_count") -> str:
    return f"select {dims}, count(distinct {key}) as {name} from {table} where {where} group by {dims} order by {dims}"


STATEMENTS = {
    "url_map_visitors": """
        select case when u like '%offers%no%ding%lookup%30393%' then 'no-ding-email'
                    when u like '%accounts%reapply%' then 'account-reapply'
                    when u like '%accounts%check%offers%' then 'account-check-offers'
                    when u like '%accounts%get%started%' then 'account-get-started'
                    when contains(u, 'application') then 'application'
                    when contains(u, '/affiliate/') then 'affiliate-link'
                    when contains(u, '/apply') then 'apply-page'
                    when u like '%accounts%offers' then 'account-offers'
                    when contains(u, '/ppc/') then 'ppc-page'
                    when u like '%check%offers%###' then 'wizard-check-offer-page'
                    else gen_url2 end as url_mapping, count(distinct visitor_id) as visitor_count
        from (select lower(gen_url2) as u, gen_url2, visitor_id from interactions)
        group by 1 order by 2 desc, 1 nulls last""",
    "recent_offer_cookies": """
        select cookie_id, interaction_date from interactions
        where regexp_matches(gen_url2, 'accounts.*offers$', 'is')
          and cast(interaction_date as date) >= date '2001-08-01' - 30
        group by all""",
    "return_bucket_detail": _repeaters("visitor_buckets"),
    "return_bucket_detail_wide": _repeaters("visitor_buckets_wide"),
    "return_bucket_report": _report("visitor_buckets"),
    "return_bucket_report_wide": _report("visitor_buckets_wide"),
    "cust_type_profile": """
        select cust_type, count(distinct appl_key) as app_count, count(distinct cust_id) as cust_count
        from applications where year(tran_date) in (1996, 1997, 1998) group by cust_type order by cust_type nulls last""",
    "visitor_cust_type": "select * from visitor_cust_type",
    "visitor_multi_type_audit": _counts("visitor_cust_type", "cust_type", "visitor_id", name="cust_type_count"),
    "visitor_cust_type_for": "select * from visitor_cust_type where visitor_id = 7",
    "customer_multi_type_audit": _counts("customer_type", "cust_type", "cust_id", name="cust_type_count"),
    "applications_for": "select * from applications where cust_id = '7'",
    "visit_timeline": """
        select visitor_id, visit_id, customer_id, created_at as visit_time, record_created_timestamp
        from traffic where visitor_id = 7 and year(record_created_timestamp) = 2024 order by created_at, visit_id""",
    "person_cust_type": "select * from person_cust_type",
    "person_multi_type_audit": _counts("person_cust_type", "cust_type", "person", name="cust_type_count"),
    "repeat_visitors": "select * from repeat_visitors",
    "visitor_ita": "select * from visitor_ita",
    "visitor_ita_by_type": _counts(
        "visitor_ita", "visitor_id", "first_visit_category, cust_type", "first_visit_category in ('1. App started, no submit', '2. Soft approved, no hard submit')"
    ),
    "visitor_ita_by_category": _counts("visitor_ita", "visitor_id", "first_visit_category"),
    "visitor_ita_other_reasons": """
        select first_visit_funnel,
               case when matched_first_visit_rows = 0 then '1. No source rows matched first visit'
                    when app_started + soft_submitted = 0 then '3. No app-start URL match, no submit'
                    when app_started = 0 then '2. Soft submitted, no app-start URL match'
                    else '4. Unexpected flag combination' end as other_reason,
               count(distinct visitor_id) as visitor_count
        from visitor_ita where first_visit_category = '5. Other' group by all order by visitor_count desc""",
    "visitor_pq": "select * from visitor_pq",
    "visitor_pq_by_type": _counts(
        "visitor_pq", "visitor_id", "first_visit_category, cust_type", "first_visit_category = '1. Prequalified, no hard submit'"
    ),
    "visitor_pq_by_category": _counts("visitor_pq", "visitor_id", "first_visit_category"),
    "person_funnel_type": "select * from person_funnel_type",
    "return_bucket_by_group": _counts(
        "person_funnel_type", "person", "return_bucket, first_visit_group", name="returning_visitors"
    ),
    "person_ita": "select * from person_ita",
    "person_ita_by_type": _counts("person_ita", "person", "first_visit_category, cust_type"),
    "person_pq": "select * from person_pq",
    "person_pq_by_type": _counts("person_pq", "person", "first_visit_category, cust_type"),
    "person_ita_later": "select * from person_ita_later",
    "later_submit_report": """
        select first_visit_category, count(*) as total_people,
               count(*) filter (where later_hard_submitted = 1) as later_hard_submit_people,
               count(*) filter (where later_hard_submitted < later_soft_submitted) as later_soft_submit_only_people,
               count(*) filter (where later_hard_submitted + later_soft_submitted = 0) as neither_later_submit_people
        from person_ita_later group by first_visit_category order by first_visit_category""",
    "interactions_for": "select * from interactions where person = '7'",
    # single operators
    "daily_visits": f"""
        select visitor_id, cast(interaction_date as date) as visit_date, count(distinct visit_id) as visit_id_count
        from interactions where {W13} and visitor_id is not null group by all""",
    "first_date": f"""
        select visitor_id, cast(min(interaction_date) as date) as first_visit_date
        from interactions where {W13} and visitor_id is not null group by visitor_id""",
    "same_day_max": "select visitor_id, max_visit_ids_in_day from visitor_buckets",
    "return_gap": "select visitor_id, min_return_gap from visitor_buckets where min_return_gap is not null",
    "first_touch": """
        select visitor_id, first_visit_id, first_interaction_time, coalesce(first_funnel, 'Unknown') as first_visit_funnel
        from first_visitor_id""",
    "first_touch_raw_funnel": f"""
        select person, first_visit_id, first_interaction_time, first_funnel as first_visit_funnel
        from ({_first("person", W13, funnel="funnel")})""",
    "first_visit_activity": f"""
        select f.visitor_id, first_visit_id, first_interaction_time,
               coalesce(first_funnel, 'Unknown') as first_visit_funnel,
               cast(count(*) filter (where {_STARTED}) > 0 as integer) as app_started,
               cast(count(*) filter (where soft_submit_flag = 1) > 0 as integer) as soft_submitted,
               cast(count(*) filter (where soft_approval_flag = 1) > 0 as integer) as soft_approved,
               cast(count(*) filter (where hard_submit_flag = 1) > 0 as integer) as hard_submitted,
               count(d.visitor_id) as matched_first_visit_rows
        from first_visitor_id f
        left join interactions d on d.visitor_id = f.visitor_id and d.visit_id = f.first_visit_id and {W13}
        group by all""",
    "latest_application": "select * from customer_type",
    "latest_application_row": "select * from application_type",
    "visitor_candidates": "select * from visitor_candidates",
    "person_candidates": "select * from person_candidates",
    "cust_type_summary": """
        select visitor_id, count(distinct nullif(trim(customer_id), '')) as customer_id_count,
               count(distinct nullif(upper(trim(cust_type)), '')) as cust_type_count,
               case when customer_id_count > 1 then 'Multiple customer IDs'
                    when cust_type_count > 1 then 'Multiple customer types'
                    else coalesce(max(nullif(upper(trim(cust_type)), '')), 'Unknown') end as cust_type
        from visitor_candidates group by visitor_id""",
    "cust_type_summary_second_type": """
        select visitor_id, count(distinct nullif(trim(customer_id), '')) as customer_id_count,
               count(distinct nullif(upper(trim(cust_type)), '')) as cust_type_count,
               case when customer_id_count > 1 then 'Multiple customer IDs'
                    when cust_type_count > 1 then 'Multiple customer types'
                    else coalesce(max(nullif(upper(trim(cust_type)), '')), 'Unknown') end as cust_type
        from second_types group by visitor_id""",
    "visitor_ita_second_type": _with_summary("visitor_ita_stage", "second_types"),
    "visitor_ita_wider_repeat": _with_summary("visitor_ita_wide_stage"),
    "visitor_pq_wider_repeat": _with_summary("visitor_pq_wide_stage"),
    "visit_summary": f"""
        select visitor_id, cast(interaction_date as date) as day, visit_id, funnel, visitor_flag,
               min(interaction_date) as first_time,
               cast(coalesce(bool_or({_STARTED}), false) as integer) as app_started,
               cast(coalesce(bool_or(soft_submit_flag = 1), false) as integer) as soft_submitted,
               cast(coalesce(bool_or(soft_approval_flag = 1), false) as integer) as soft_approved,
               cast(coalesce(bool_or(hard_submit_flag = 1), false) as integer) as hard_submitted,
               count(*) as row_count
        from interactions where {W13} and visitor_id is not null group by all""",
    "visitor_ita_all_candidates": _with_summary("visitor_ita_stage", "visitor_candidates"),
    "later_activity": f"""
        select * exclude (soft_day, hard_day, day0),
               cast(soft_day is not null as integer) as later_soft_submitted,
               cast(hard_day is not null as integer) as later_hard_submitted,
               soft_day as first_later_soft_submit_date, hard_day as first_later_hard_submit_date,
               cast(soft_day - day0 as integer) as days_to_later_soft_submit,
               cast(hard_day - day0 as integer) as days_to_later_hard_submit
        from (select f.person, first_visit_id, first_interaction_time,
                     coalesce(first_funnel, 'Unknown') as first_visit_funnel,
                     cast(first_interaction_time as date) as day0,
                     min(day) filter (where soft_submit_flag = 1) as soft_day,
                     min(day) filter (where hard_submit_flag = 1) as hard_day
              from ({_first("person", W13)}) f
              left join (select *, cast(interaction_date as date) as day from interactions
                         where interaction_date < timestamp '1997-02-01') s
                on s.person = f.person and s.day > cast(f.first_interaction_time as date)
              group by all)""",
    # previews
    "sample_cookie_summary": """
        select distinct cookie_id, visitor_id from interactions order by cookie_id, visitor_id limit 100""",
    "sample_repeat_visitors": "select * from repeat_visitors order by visitor_id limit 100",
}


STATEMENTS["first_visits"] = STATEMENTS["first_visit_activity"]
STATEMENTS["repeat_visitors_replaced"] = STATEMENTS["repeat_visitors"]
STATEMENTS["return_bucket_report_from_summary"] = STATEMENTS["return_bucket_report"]


def _needed(sql: str) -> list[str]:
    """Relations ``sql`` uses, directly or not, in order of definition."""
    names = {n for n in RELATIONS if re.search(rf"\b(?:from|join)\s+{n}\b", sql)}
    for name in list(names):
        names.update(_needed(RELATIONS[name]))
    return [n for n in RELATIONS if n in names]


def oracle_sql() -> dict[str, str]:
    """One complete statement per query."""
    statements = {}
    for name, body in STATEMENTS.items():
        ctes = ",\n".join(f"{n} as materialized ({RELATIONS[n].strip()})" for n in _needed(body))
        statements[name] = f"with {ctes}\n{body.strip()}" if ctes else body.strip()
    return statements
