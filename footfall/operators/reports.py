"""Report operators over any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import columns as C, rules


def count_keys_by(
    df: DataFrame,
    dims: Sequence[str],
    key: str,
    name: str = "visitor_count",
    only: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Distinct keys per combination of ``dims``, in order of the dimensions.

    ``only`` keeps the listed values of a column.
    """
    for column, values in (only or {}).items():
        df = df.filter(F.col(column).isin(*values))
    return df.groupBy(*dims).agg(F.count_distinct(key).alias(name)).orderBy(*[F.col(d).asc_nulls_last() for d in dims])


def with_total(counts: DataFrame, dim: str, measure: str) -> DataFrame:
    """Append one ``Total`` row, the sum of the detail rows (NULL when there are none).

    A rollup, so ``counts`` is computed once; ``grouping`` tells the total from a NULL in the dimension. A row without a measure makes sure
    that there is a total, and is no detail row.
    """
    detail = counts.selectExpr(dim, measure, "true as _real")
    empty = counts.sparkSession.range(1).selectExpr(f"cast(null as {counts.schema[dim].dataType.simpleString()}) as {dim}", f"cast(null as {counts.schema[measure].dataType.simpleString()}) as {measure}", "false as _real")
    summed = detail.unionAll(empty).rollup(dim).agg(F.sum(measure).alias(measure), F.max("_real").alias("_real"), F.grouping(dim).alias("_total"))
    return summed.filter("_total = 1 or _real").selectExpr(f"if(_total = 1, {C.text(rules.TOTAL)}, {dim}) as {dim}", measure)


def multi_value_audit(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Distinct values per key, most first: shows keys that should have one but have more."""
    counts = df.groupBy(key).agg(F.count_distinct(value).alias(name))
    return counts.orderBy(F.desc(name), F.col(key).asc_nulls_last())


def rows_for(df: DataFrame, column: str, value: object) -> DataFrame:
    """All rows of one entity.

    The value is brought to the column's type, not the other way round, so the
    filter reaches the file scan; a value that does not fit, or None, matches no row.
    """
    if value is None:
        return df.where("false")
    kind = df.schema[column].dataType
    return df.filter(F.col(column) == F.lit(str(value)).try_cast(kind))


def sample_rows(df: DataFrame, n: int = 100, order_by: Sequence[Column] = ()) -> DataFrame:
    """A preview of ``n`` rows: any of them, or the first ones of a given order."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def formatted(df: DataFrame, measure: str) -> DataFrame:
    """Show a count with thousands separators."""
    return df.withColumn(measure, C.thousands(measure))
