"""Grouped aggregates used across models and reports. All are plain ``groupBy().agg()``, which Spark
runs as partial (map-side) + final hash aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.functions.numeric import tie_safe_round


def count_when(cond: Column) -> Column:
    """Rows for which ``cond`` holds: 0 (not null) when nothing matches or there is no row; bigint."""
    return F.count(F.when(cond, F.lit(1)))


def category_counts(col: str, values: Mapping[str, object]) -> list[Column]:
    """One conditional count per ``{out_name: value}``."""
    return [count_when(F.col(col) == F.lit(v)).alias(name) for name, v in values.items()]


def rounded_avg(col: str | Column, scale: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return tie_safe_round(F.avg(c), scale)


def count_by(df: DataFrame, col: str, out: str = "count", descending: bool = True) -> DataFrame:
    """Frequency of each value (value_counts), most frequent first, value as tie-break."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(out))
    order = [F.col(out).desc(), F.col(col).asc_nulls_last()] if descending else [F.col(col).asc_nulls_last()]
    return counts.orderBy(*order)


def distinct_keys(df: DataFrame, cols: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """``SELECT DISTINCT cols FROM df WHERE not_null IS NOT NULL``."""
    out = df
    for c in not_null:
        out = out.where(F.col(c).isNotNull())
    return out.select(*cols).distinct()


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of one column, sorted."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def nunique(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    return df.agg(F.countDistinct(col).alias(out))


def value_bounds(df: DataFrame, col: str, lo_default: int = 0, hi_default: int = 1_000_000) -> DataFrame:
    """Integer-truncated min/max of a column (defaults when every value is null)."""
    return df.agg(
        F.coalesce(F.min(col).cast("long"), F.lit(lo_default).cast("long")).alias(f"min_{col}"),
        F.coalesce(F.max(col).cast("long"), F.lit(hi_default).cast("long")).alias(f"max_{col}"),
    )


def approx_median(col: str) -> Column:
    """``percentile_approx(col, 0.5)``: an actual element (the lower median for even counts)."""
    return F.percentile_approx(F.col(col), 0.5)
