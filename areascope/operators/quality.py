"""Data-quality checks (not_null, unique, accepted_values) as Spark jobs.

Each check returns its violation count. ``run_checks`` evaluates every not_null / accepted_values
check of one table in a single aggregation pass, and each unique check as one grouped count, then
returns one row per check: (model, column_name, test, violations).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    column: str
    test: str  # "not_null" | "unique" | "accepted_values"
    values: tuple = ()


def not_null(column: str) -> Check:
    return Check(column, "not_null")


def unique(column: str) -> Check:
    return Check(column, "unique")


def accepted_values(column: str, values: Sequence) -> Check:
    return Check(column, "accepted_values", tuple(values))


def violation_expr(check: Check) -> Column:
    """Per-row violation flag for a row-local check (nulls pass accepted_values)."""
    c = F.col(check.column)
    if check.test == "not_null":
        return c.isNull()
    if check.test == "accepted_values":
        return c.isNotNull() & ~c.isin(*check.values)
    raise ValueError(check.test)


def unique_violations(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Key values that occur more than once (null keys ignored)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    keyed = df
    for c in cols:
        keyed = keyed.where(F.col(c).isNotNull())
    return keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def run_checks(model: str, df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check with its violation count (bigint)."""
    row_checks = [c for c in checks if c.test != "unique"]
    parts = []
    if row_checks:
        sums = df.agg(*[
            F.sum(F.when(violation_expr(c), F.lit(1)).otherwise(F.lit(0))).cast("long").alias(f"_c{i}")
            for i, c in enumerate(row_checks)
        ])
        stacked = sums.select(F.explode(F.array(*[
            F.struct(F.lit(model).alias("model"), F.lit(c.column).alias("column_name"),
                     F.lit(c.test).alias("test"), F.coalesce(F.col(f"_c{i}"), F.lit(0).cast("long")).alias("violations"))
            for i, c in enumerate(row_checks)
        ])).alias("s")).select("s.*")
        parts.append(stacked)
    for c in checks:
        if c.test == "unique":
            dup = unique_violations(df, c.column).agg(F.count(F.lit(1)).cast("long").alias("violations"))
            parts.append(dup.select(F.lit(model).alias("model"), F.lit(c.column).alias("column_name"),
                                    F.lit("unique").alias("test"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- checks while a table is written
class CheckFailed(RuntimeError):
    """Checks of a model that found violations: ``found`` is a list of (model, column, test, violations)."""

    def __init__(self, found: Sequence[tuple[str, str, str, int]]):
        self.found = list(found)
        super().__init__("; ".join(f"{m}.{c}: {t} fails on {n} rows" for m, c, t, n in self.found))


def observed_checks(checks: Sequence[Check]) -> dict[str, Column]:
    """Violation counts of the row checks as aggregates to observe while the table is written."""
    return {f"{c.test}:{c.column}:{i}": F.count(F.when(violation_expr(c), F.lit(1))) for i, c in enumerate(checks) if c.test != "unique"}


def observed_violations(model: str, checks: Sequence[Check], metrics: Mapping[str, int], stored: DataFrame) -> list[tuple[str, str, str, int]]:
    """(model, column, test, violations) of each check: row checks from the metrics, unique checks by one count of the stored keys
    (which reads that column alone)."""
    out = []
    for i, c in enumerate(checks):
        if c.test == "unique":
            n = unique_violations(stored, c.column).count()
        else:
            n = int(metrics.get(f"{c.test}:{c.column}:{i}") or 0)
        out.append((model, c.column, c.test, n))
    return out
