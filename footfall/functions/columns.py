"""Scalar expressions, built from rule tables as Spark SQL text.

Every function takes column names (or SQL expressions) and returns a Column. All of
it is native SQL: there is no UDF anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, functions as F

from footfall.functions import rules
from footfall.params import DateWindow


def text(value: str) -> str:
    """SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def cases(branches: Iterable[tuple[str, str]], default: str = "null") -> str:
    """SQL CASE; the first true condition gives the value."""
    whens = " ".join(f"when {cond} then {value}" for cond, value in branches)
    return f"case {whens} else {default} end"


# ------------------------------------------------------------------ dates


def midnight(day: date) -> str:
    """Start of ``day`` as a timestamp literal without a time zone."""
    return f"timestamp_ntz'{day.isoformat()} 00:00:00'"


def in_window(ts: str, window: DateWindow) -> Column:
    """Half-open range tests on typed literals, so that they reach the file scan."""
    tests = [f"({ts} >= {midnight(start)} and {ts} < {midnight(end)})" for start, end in window.ranges]
    return F.expr(" or ".join(tests))


def days_between(first: str, later: str) -> Column:
    """Calendar days from ``first`` to ``later``; NULL when either is missing."""
    return F.expr(f"date_diff(to_date({later}), to_date({first}))")


# ------------------------------------------------------------------ text


def trimmed(col: str) -> str:
    """Spaces stripped; blank becomes NULL."""
    return f"nullif(trim({col}), '')"


def clean_funnel(col: str) -> Column:
    """Trimmed funnel code; blank or NULL becomes ``Unknown``."""
    return F.expr(f"coalesce({trimmed(col)}, {text(rules.UNKNOWN)})")


def numeric_key(col: str) -> Column:
    """Whole-number join key from text or number; unparseable gives NULL."""
    return F.expr(f"try_cast(cast({col} as string) as decimal(38, 0))")


def matches(lowered: str, pattern: str) -> str:
    """Case-insensitive LIKE of a lower-cased text, with cheap tests in front.

    A pattern with several literal pieces runs as a regular expression. Looking for
    the pieces first (byte searches) spares nearly all rows of it, and cannot
    change the answer: every piece must occur for the pattern to match.
    """
    pattern = pattern.lower()
    like = f"{lowered} like {text(pattern)}"
    pieces = [p for p in pattern.split("%") if p]
    if len(pieces) < 2 or "_" in pattern or "\\" in pattern:
        return like
    return " and ".join([*(f"contains({lowered}, {text(p)})" for p in pieces), like])


def any_like(lowered: str, patterns: Iterable[str]) -> Column:
    """True when any pattern matches the lower-cased text; NULL gives NULL."""
    return F.expr(" or ".join(f"({matches(lowered, p)})" for p in patterns))


def first_like(lowered: str, rule_list: Iterable[rules.LikeRule], default: str) -> Column:
    """Label of the first rule that matches the lower-cased text, else ``default``."""
    return F.expr(cases([(matches(lowered, r.pattern), text(r.label)) for r in rule_list], default))


def thousands(n: str, width: int = 12) -> Column:
    """Right-aligned count with separators: sign column plus ``999,999,999``.

    Counts too large for the picture are shown as ``#``, as SQL ``TO_CHAR`` does,
    since ``lpad`` alone would cut digits off.
    """
    shown = f"format_number({n}, 0)"
    return F.expr(
        cases(
            [
                (f"length({shown}) < {width}", f"lpad({shown}, {width}, ' ')"),
                (f"{n} is not null", text("#" * width)),
            ]
        )
    )


# ------------------------------------------------------------------ classifiers


def flag(cond: str) -> Column:
    """1 when true, 0 when false or NULL."""
    return F.expr(f"if({cond}, 1, 0)")


def return_bucket(same_day_max: str, gap: str, buckets: rules.BucketRules) -> Column:
    """Return bucket; several visits on one day win over any gap."""
    branches = [(f"{same_day_max} > 1", text(buckets.same_day))]
    for rule in buckets.gaps:
        above = f"{gap} >= {rule.low}"
        branches.append((above if rule.high is None else f"{above} and {gap} <= {rule.high}", text(rule.label)))
    return F.expr(cases(branches, text(buckets.none)))


def funnel_group(funnel: str, groups: Mapping[str, tuple[str, ...]] = rules.FUNNEL_GROUPS) -> Column:
    """Audience group of a funnel code; unlisted codes and NULL are ``Unmapped``."""
    branches = [(f"{funnel} in ({', '.join(map(text, codes))})", text(name)) for name, codes in groups.items()]
    return F.expr(cases(branches, text(rules.UNMAPPED)))


def ita_category(funnel: str, app: str, soft: str, approved: str, hard: str) -> Column:
    """Furthest stage an ITA first visit reached.

    Decided from the end of the funnel backwards: a hard submit settles it, a
    visit without an application start has no stage, and for the hard-only
    funnel soft submits are ignored. A flag that is NULL supports no stage.
    """
    hard_only = f"{funnel} = {text(rules.HARD_ONLY_FUNNEL)}"
    branches = [
        (f"{hard} = 1", text(rules.ITA_HARD)),
        (f"{funnel} is null or not {app} <=> 1", text(rules.ITA_OTHER)),
        (f"if({hard_only}, {hard}, {soft}) = 0", text(rules.ITA_STARTED)),
        (f"{hard_only} or not {soft} <=> 1", text(rules.ITA_OTHER)),
        (f"{approved} = 0", text(rules.ITA_SOFT)),
        (f"{approved} = 1 and {hard} = 0", text(rules.ITA_APPROVED)),
    ]
    return F.expr(cases(branches, text(rules.ITA_OTHER)))


def ita_other_reason(matched: str, app: str, soft: str) -> Column:
    """Why an ITA first visit has no stage; NULL flags are an unexpected combination."""
    branches = [
        (f"{matched} = 0", text(rules.ITA_REASON_UNMATCHED)),
        (f"{app} = 1 or {app} is null", text(rules.ITA_REASON_UNEXPECTED)),
        (f"{soft} = 1", text(rules.ITA_REASON_SOFT_ONLY)),
        (f"{soft} = 0", text(rules.ITA_REASON_NOTHING)),
    ]
    return F.expr(cases(branches, text(rules.ITA_REASON_UNEXPECTED)))


def pq_other_reason(first_time: str, first_visit: str, matched: str) -> Column:
    """Why a PQ first visit cannot be judged; NULL when it can."""
    branches = [
        (f"{first_time} is null", text(rules.PQ_REASON_NO_ROWS)),
        (f"{first_visit} is null", text(rules.PQ_REASON_NO_VISIT)),
        (f"{matched} = 0", text(rules.PQ_REASON_UNMATCHED)),
    ]
    return F.expr(cases(branches))


def pq_category(other_reason: str, hard: str) -> Column:
    """Stage of a PQ first visit; ``Other`` exactly when there is a reason for it."""
    branches = [(f"{other_reason} is not null", text(rules.PQ_OTHER)), (f"{hard} = 1", text(rules.PQ_HARD))]
    return F.expr(cases(branches, text(rules.PQ_NO_HARD)))
