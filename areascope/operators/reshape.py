"""Reshaping: wide-to-long, column selection helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_columns(df: DataFrame, meta_cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """(metadata columns present in df, every other column). Schema-only, no job."""
    ids = [c for c in meta_cols if c in df.columns]
    rest = [c for c in df.columns if c not in ids]
    return ids, rest


def unpivot_panel(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str,
                  value_type: str = "double", drop_null: bool = True) -> DataFrame:
    """Wide -> long (melt) with ``DataFrame.unpivot``; value columns are cast to one type first and
    rows with a null value are dropped (months with no data)."""
    typed = df.select(*ids, *[F.col(f"`{c}`").cast(value_type).alias(c) for c in values])
    long = typed.unpivot(list(ids), list(values), variable, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long


def select_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project the listed columns that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


def rename_snake(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the mapped columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))
