"""Monthly panel operators: reference dates, rows at the latest date, and one-pass lookbacks.

The reference shape finds "value k months ago" with one left self-join per offset. Here every
lookback is a single conditional aggregate: the panel is cut to the handful of dates that matter
(``date IN (ref, ref-1m, ref-6m, ref-12m)``, a scan-side filter), then one ``groupBy(key)`` with
``max(when(date = d_k, value))`` per offset. One shuffle of ~4 rows per key replaces k self-joins
of the full panel.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lookback offsets (months) used by the trend and yield models.
LOOKBACK_MONTHS = {"30d": 1, "6m": 6, "1yr": 12}


def latest_date(df: DataFrame, date: str = "date") -> Column:
    """``max(date)`` as a scalar-subquery Column (evaluated once, never joined)."""
    return df.select(F.max(date)).scalar()


def latest_date_value(df: DataFrame, date: str = "date") -> Column:
    """``max(date)`` computed now and returned as a literal Column.

    One scalar comes back to the driver (on a stored parquet table Spark can answer it from file
    footers). Because the result is a literal, ``date IN (ref, ref - 1m, ...)`` filters are pushed
    into the scan and prune date partitions: a lookback reads 4 months, not the whole history.
    """
    value = df.agg(F.max(date)).first()[0]
    return F.lit(value).cast("date") if value is not None else F.lit(None).cast("date")


def common_latest_value(dfs: Iterable[DataFrame], date: str = "date") -> Column:
    """Earliest of the per-table latest dates, computed now, as a literal (nulls skipped)."""
    values = [df.agg(F.max(date)).first()[0] for df in dfs]
    present = [v for v in values if v is not None]
    return F.lit(min(present)).cast("date") if present else F.lit(None).cast("date")


def common_latest(dfs: Iterable[DataFrame], date: str = "date") -> Column:
    """Earliest of the per-table latest dates (``min`` over a union of ``max``), null-skipping."""
    refs = [latest_date(df, date) for df in dfs]
    return refs[0] if len(refs) == 1 else F.least(*refs)


def at_latest(df: DataFrame, date: str = "date", ref: Column | None = None) -> DataFrame:
    """Rows whose date equals the latest (or the given) reference date."""
    ref = latest_date(df, date) if ref is None else ref
    return df.where(F.col(date) == ref)


def months_back(ref: Column, k: int, align: str = "exact") -> Column:
    """Reference date ``k`` months back. ``exact`` keeps the day of month (add_months semantics)."""
    return F.add_months(ref, -k)


def _date_match(date_col: Column, target: Column, align: str) -> Column:
    if align == "exact":
        return date_col == target
    if align == "month":
        return F.trunc(date_col, "month") == F.trunc(target, "month")
    raise ValueError(f"align must be 'exact' or 'month', not {align!r}")


def lookback(
    panel: DataFrame,
    key: str | list[str],
    value: str,
    ref: Column,
    offsets: Mapping[str, int],
    current: str = "current_value",
    carry: Iterable[str] = (),
    date: str = "date",
    align: str = "exact",
) -> DataFrame:
    """One row per key that has a row at ``ref``: its current value, carried attributes, and the
    value at ``ref - k`` months for each ``{name: k}`` in ``offsets`` (null when absent).

    Assumes (key, date) is unique (check with ``quality.unique``); duplicates are collapsed with
    ``max`` instead of multiplying rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    d = F.col(date)
    targets = {name: months_back(ref, k) for name, k in offsets.items()}
    if align == "exact":
        keep = d.isin(ref, *targets.values())
    else:
        keep = F.trunc(d, "month").isin(*[F.trunc(t, "month") for t in [ref, *targets.values()]])
    is_now = _date_match(d, ref, align)
    aggs = [F.max(F.when(is_now, F.col(value))).alias(current)]
    aggs += [F.max(F.when(is_now, F.col(c))).alias(c) for c in carry]
    aggs += [F.max(F.when(_date_match(d, t, align), F.col(value))).alias(name) for name, t in targets.items()]
    return panel.where(keep).groupBy(*keys).agg(*aggs).where(F.col(current).isNotNull())


def multi_series_lookback(
    series: Mapping[str, tuple[DataFrame, str]],
    key: str,
    ref: Column,
    offsets: Mapping[str, int],
    carry_from: str | None = None,
    carry: Iterable[str] = (),
    date: str = "date",
    align: str = "exact",
) -> DataFrame:
    """Lookbacks for several panels sharing a key in ONE shuffle.

    ``series`` maps an output prefix to (panel, value column). The panels are cut to the needed
    dates, stacked with ``unionByName`` (one value column each, null elsewhere) and grouped once.
    Output columns: ``{prefix}`` for the value at ``ref`` and ``{prefix}_{name}`` per offset;
    ``carry`` columns are taken from the ``carry_from`` series at ``ref``. Keys absent from every
    series at ``ref`` still appear (with null current values); callers filter.
    """
    carry = list(carry)
    d = F.col(date)
    targets = {name: months_back(ref, k) for name, k in offsets.items()}
    parts = []
    for prefix, (df, value) in series.items():
        cols = [F.col(key), F.col(date), F.col(value).alias(f"_v_{prefix}")]
        cols += [(F.col(c) if prefix == carry_from else F.lit(None).cast("string")).alias(c) for c in carry]
        if align == "exact":
            keep = d.isin(ref, *targets.values())
        else:
            keep = F.trunc(d, "month").isin(*[F.trunc(t, "month") for t in [ref, *targets.values()]])
        parts.append(df.where(keep).select(*cols))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    is_now = _date_match(d, ref, align)
    aggs = []
    for prefix in series:
        v = F.col(f"_v_{prefix}")
        aggs.append(F.max(F.when(is_now, v)).alias(prefix))
        aggs += [F.max(F.when(_date_match(d, t, align), v)).alias(f"{prefix}_{name}") for name, t in targets.items()]
    if carry_from is not None:
        src = F.col(f"_v_{carry_from}").isNotNull()
        aggs += [F.max(F.when(is_now & src, F.col(c))).alias(c) for c in carry]
    return stacked.groupBy(key).agg(*aggs)


def self_join_lookback(
    panel: DataFrame, key: str, value: str, offsets: Mapping[str, int], date: str = "date",
    current: str = "current_value",
) -> DataFrame:
    """The reference-shaped plan (one left self-join per offset). Kept only as the equivalence
    baseline for tests and the bench; ``lookback`` is the operator to use."""
    ref = latest_date(panel, date)
    cur = panel.where(F.col(date) == ref).select(F.col(key), F.col(value).alias(current), F.col(date).alias("_ref"))
    out = cur
    for name, k in offsets.items():
        past = panel.select(F.col(key).alias(f"_k_{name}"), F.col(date).alias(f"_d_{name}"), F.col(value).alias(name))
        out = out.join(
            past,
            (out[key] == past[f"_k_{name}"]) & (past[f"_d_{name}"] == F.add_months(out["_ref"], -k)),
            "left",
        ).drop(f"_k_{name}", f"_d_{name}")
    return out.drop("_ref")
