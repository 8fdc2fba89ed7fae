"""Contracts of the input tables and of the tables the jobs build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    IntegralType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

# Input tables: column and type, in Spark DDL.
INPUTS = {
    "interactions": (
        "visitor_id bigint, person string, cookie_id string, visit_id bigint, interaction_date timestamp_ntz, "
        "funnel string, gen_url string, gen_url2 string, soft_submit_flag int, soft_approval_flag int, "
        "hard_submit_flag int, visitor_flag int, appl_key bigint"
    ),
    "applications": (
        "appl_key bigint, cust_id string, cust_type string, tran_date timestamp_ntz, appl_entry_dt timestamp_ntz"
    ),
    "traffic_visits": (
        "visitor_id bigint, visit_id bigint, customer_id string, created_at timestamp_ntz, "
        "record_created_timestamp timestamp_ntz"
    ),
    "returning_population": "person string, return_bucket string",
}

_FIRST_VISIT = "first_visit_id bigint, first_interaction_time timestamp_ntz, first_visit_funnel string"
_ITA = (
    f"{_FIRST_VISIT}, app_started int, soft_submitted int, soft_approved int, hard_submitted int, "
    "matched_first_visit_rows bigint, first_visit_category string"
)
_PQ = (
    f"{_FIRST_VISIT}, matched_first_visit_rows bigint, hard_submitted int, first_visit_category string, "
    "other_reason string"
)
_LATER = (
    "later_soft_submitted int, later_hard_submitted int, first_later_soft_submit_date date, "
    "first_later_hard_submit_date date, days_to_later_soft_submit int, days_to_later_hard_submit int"
)

_VISITS = (
    "day date, visit_id bigint, funnel string, visitor_flag int, first_time timestamp_ntz, app_started int, "
    "soft_submitted int, soft_approved int, hard_submitted int, row_count bigint"
)

# Tables the jobs build, in column order.
TABLES = {
    "visitor_visits": f"visitor_id bigint, {_VISITS}",
    "person_visits": f"person string, {_VISITS}",
    "visitor_cust_type": (
        "visitor_id bigint, customer_id string, cust_id string, cust_type string, visit_date timestamp_ntz"
    ),
    "person_cust_type": "appl_key bigint, person string, cust_type string, visit_date timestamp_ntz",
    "repeat_visitors": f"visitor_id bigint, return_bucket string, {_FIRST_VISIT}, first_visit_group string",
    "visitor_ita": f"visitor_id bigint, {_ITA}, cust_type string, customer_id_count bigint, cust_type_count bigint",
    "visitor_pq": f"visitor_id bigint, {_PQ}, cust_type string, customer_id_count bigint, cust_type_count bigint",
    "person_funnel_type": (
        "person string, return_bucket string, first_interaction_time timestamp_ntz, first_visit_funnel string, "
        "first_visit_group string"
    ),
    "person_ita": f"person string, {_ITA}, cust_type string, {_LATER}",
    "person_pq": f"person string, {_PQ}, cust_type string, cust_type_matched int",
}

# The column that the jobs group and join each table by.
CLUSTER_KEYS = {name: "visitor_id" if "visitor" in name else "person" for name in TABLES}


def contract(name: str) -> StructType:
    """The declared schema of a table."""
    return StructType.fromDDL(INPUTS.get(name) or TABLES[name])


def _adapted(wanted: DataType, actual: DataType, column: str) -> str | None:
    """SQL that gives the column the wanted type without loss, or None if the types do not allow it.

    Types that may hold values that do not fit (wide decimals, text for numbers) fail when such a value is read.
    """
    if actual == wanted:
        return column
    whole = isinstance(actual, IntegralType) or isinstance(actual, DecimalType) and actual.scale == 0
    if isinstance(wanted, TimestampNTZType) and isinstance(actual, DateType):
        return f"cast({column} as timestamp_ntz)"
    if isinstance(wanted, StringType) and whole:
        return f"cast({column} as string)"
    if isinstance(wanted, IntegralType) and (whole or isinstance(actual, StringType)):
        kind = wanted.simpleString()
        fits = f"try_cast({column} as {kind})"
        if isinstance(actual, IntegralType) and actual.jsonValue() in ("byte", "short", "integer"):
            return f"cast({column} as {kind})"
        told = f"concat('{column.strip('`')} does not fit {kind}: ', cast({column} as string))"
        return f"if({column} is not null and {fits} is null, cast(raise_error({told}) as {kind}), {fits})"
    if isinstance(wanted, IntegerType) and isinstance(actual, BooleanType):
        return f"cast({column} as int)"
    return None


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """Return the declared columns of ``df`` in order and type, or fail naming what differs.

    Extra columns are dropped; the scan then never reads them. Names are compared
    without case, as Spark does. Other types are brought to the declared ones where nothing is lost: whole numbers of any width, booleans for flags, ids
    as text or number, dates for times. An input's ``timestamp`` stays as it is, in the session's time zone: compared with a literal it still
    reaches the file scan. In a table that the jobs build it becomes ``timestamp_ntz``.
    """
    found = {f.name.lower(): f for f in df.schema.fields}
    faults, columns = [], []
    for field in contract(name).fields:
        actual = found.get(field.name.lower())
        if actual is None:
            faults.append(f"{field.name} is missing")
            continue
        column = f"`{field.name}`"
        if isinstance(field.dataType, TimestampNTZType) and isinstance(actual.dataType, TimestampType):
            adapted = column if name in INPUTS else f"cast({column} as timestamp_ntz)"
        else:
            adapted = _adapted(field.dataType, actual.dataType, column)
        if adapted is None:
            faults.append(f"{field.name} is {actual.dataType.simpleString()}, not {field.dataType.simpleString()}")
        else:
            columns.append(f"{adapted} as {column}")
    if faults:
        raise ValueError(f"{name}: " + "; ".join(faults))
    return df.selectExpr(*columns)
