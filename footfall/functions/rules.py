"""Business rules as plain data.

Everything a business user may want to change lives here. The functions in
``footfall.functions.columns`` turn these tables into Column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LikeRule:
    """Case-insensitive LIKE pattern and the label it gives."""

    pattern: str
    label: str


@dataclass(frozen=True)
class RangeRule:
    """Closed integer range and the label it gives; ``high=None`` is unbounded."""

    low: int
    high: int | None
    label: str


@dataclass(frozen=True)
class BucketRules:
    """Return buckets: same-day intensity first, then the day gap, else neither."""

    same_day: str
    gaps: tuple[RangeRule, ...]
    none: str


# ---------------------------------------------------------------------------
# Fixed values. Labels, codes and patterns must stay as they are: results are
# compared by these strings.
# ---------------------------------------------------------------------------

# URL to page label, first match wins.
URL_RULES = (
    LikeRule("%offers%no%ding%lookup%30393%", "no-ding-email"),
    LikeRule("%accounts%reapply%", "account-reapply"),
    LikeRule("%accounts%check%offers%", "account-check-offers"),
    LikeRule("%accounts%get%started%", "account-get-started"),
    LikeRule("%application%", "application"),
    LikeRule("%/affiliate/%", "affiliate-link"),
    LikeRule("%/apply%", "apply-page"),
    LikeRule("%accounts%offers", "account-offers"),
    LikeRule("%/ppc/%", "ppc-page"),
    LikeRule("%check%offers%###", "wizard-check-offer-page"),
)

# Page that marks a cookie as having seen offers.
OFFER_PAGE_PATTERN = "%accounts%offers"

# URLs that count as starting an application.
APP_START_PATTERNS = (
    "%check%offers%",
    "%prequalification%start%",
    "%application%",
    "/prequalification",
    "%account%reapply%",
    "%prequalification%started%",
    "%account%get%started%",
    "%apply%",
)

RETURN_BUCKETS = BucketRules(
    same_day="1. Same day return",
    gaps=(
        RangeRule(1, 30, "2. Returned within 1-30 days"),
        RangeRule(31, 60, "3. Returned within 31-60 days"),
        RangeRule(61, 90, "4. Returned within 61-90 days"),
        RangeRule(91, 365, "5. Returned within 91-365 days"),
        RangeRule(366, None, "6. Returned after more than 1 year"),
    ),
    none="7. No repeat visits",
)

# Buckets that are not a return visit: visitor detail, and person population.
NO_REPEAT_VISITOR_PATTERN = "%no%repeat%visits%"
NO_REPEAT_PERSON_PATTERN = "%no%repeat%identified%"

UNKNOWN = "Unknown"
ITA = "ITA"
PQ = "PQ"
UNMAPPED = "Unmapped"

# First-visit funnel code to audience group, case-sensitive.
FUNNEL_GROUPS = {
    ITA: ("PQ_OMF", "PQ_Email", "FA_OMF", "PQ_OAM", "Others"),
    PQ: (
        "Affiliat_API",
        "CK_EA",
        "Affiliate_Remarketing_Multiple",
        "FA_Aff_Link",
        "Direct_Mail",
        "FA_Email",
        "Affiliate_Remarketing_Single",
        "EA_Remarketing",
        "CK_LB",
        "Exp_Act_WH",
        "ND_FA_Email",
        "FA_OAM",
    ),
}

# The funnel whose soft submit does not move a first visit on.
HARD_ONLY_FUNNEL = "FA_OMF"

# Stage categories of an ITA first visit.
ITA_STARTED = "1. App started, no submit"
ITA_APPROVED = "2. Soft approved, no hard submit"
ITA_SOFT = "3. Soft submitted, not soft approved"
ITA_HARD = "4. Hard submitted"
ITA_OTHER = "5. Other"

# Why an ITA first visit ended up in "Other".
ITA_REASON_UNMATCHED = "1. No source rows matched first visit"
ITA_REASON_SOFT_ONLY = "2. Soft submitted, no app-start URL match"
ITA_REASON_NOTHING = "3. No app-start URL match, no submit"
ITA_REASON_UNEXPECTED = "4. Unexpected flag combination"

# Stage categories of a PQ first visit, and why it ended up in "Other".
PQ_NO_HARD = "1. Prequalified, no hard submit"
PQ_HARD = "2. Hard submitted"
PQ_OTHER = "3. Other"
PQ_REASON_NO_ROWS = "No source records in date window"
PQ_REASON_NO_VISIT = "Missing first visit ID"
PQ_REASON_UNMATCHED = "No matching first-visit records"

# Customer-type summary labels.
MULTIPLE_IDS = "Multiple customer IDs"
MULTIPLE_TYPES = "Multiple customer types"

# Label of the grand-total row.
TOTAL = "Total"
