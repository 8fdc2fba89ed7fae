"""Latest row per key, and rows of an audience."""

from __future__ import annotations

from pyspark.sql import DataFrame


def latest_per_key(df: DataFrame, key: str, ts: str, tie_break: str) -> DataFrame:
    """One row per key: the latest ``ts``, a missing date counting as latest.

    ``tie_break`` must order rows that share a date completely, or the pick would
    depend on row order. Spark prunes each map task to its best row per key before
    the shuffle (``WindowGroupLimit``), so hot keys stay small.
    """
    rank = f"row_number() over (partition by {key} order by {ts} desc nulls first, {tie_break}) as _rank"
    return df.selectExpr("*", rank).filter("_rank = 1").drop("_rank")


def restrict_to(df: DataFrame, audience: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``audience``; NULL keys never match.

    A semi-join needs no de-duplication of the audience. Put directly on top of a
    grouping by the same key, the optimiser moves it below the grouping when, and
    only when, the audience is small enough to broadcast.
    """
    return df.join(audience.select(key), key, "left_semi")
