"""Job parameters. Every date the jobs depend on is passed in, never read from the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from footfall.functions import rules


@dataclass(frozen=True)
class DateWindow:
    """Half-open date range: ``start <= ts < end``."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if not self.start < self.end:
            raise ValueError(f"empty window: {self.start} .. {self.end}")

    @property
    def ranges(self) -> tuple[tuple[date, date], ...]:
        return ((self.start, self.end),)

    @staticmethod
    def years(first: int, last: int) -> "DateWindow":
        """Whole calendar years ``first`` to ``last``, both included."""
        return DateWindow(date(first, 1, 1), date(last + 1, 1, 1))


@dataclass(frozen=True)
class YearSet:
    """Any calendar years, as half-open ranges; years that follow each other are one range."""

    years: frozenset[int]

    def __post_init__(self) -> None:
        if not self.years:
            raise ValueError("no years")

    @staticmethod
    def of(*years: int) -> "YearSet":
        return YearSet(frozenset(years))

    @property
    def ranges(self) -> tuple[tuple[date, date], ...]:
        starts = sorted(y for y in self.years if y - 1 not in self.years)
        ends = sorted(y for y in self.years if y + 1 not in self.years)
        return tuple((date(a, 1, 1), date(b + 1, 1, 1)) for a, b in zip(starts, ends))


# The windows the jobs use unless told otherwise.
VISITOR_WINDOW = DateWindow(date(2025, 8, 1), date(2026, 9, 1))
PERSON_WINDOW = DateWindow(date(2025, 9, 1), date(2026, 10, 1))
DEFAULT_YEARS = DateWindow.years(2024, 2026)


@dataclass(frozen=True)
class Grain:
    """How one identity column is analysed.

    ``flagged_only`` keeps only rows with ``visitor_flag = 1`` for first-visit
    data. ``trim_funnel`` decides whether blanks and padding are cleaned before
    the first-touch funnel is grouped.
    """

    key: str
    window: DateWindow
    flagged_only: bool
    trim_funnel: bool
    buckets: rules.BucketRules = rules.RETURN_BUCKETS


VISITOR = Grain("visitor_id", VISITOR_WINDOW, flagged_only=False, trim_funnel=True)
PERSON = Grain("person", PERSON_WINDOW, flagged_only=True, trim_funnel=False)
