"""Numeric column helpers: rounding, safe division, percent change, clamps, weighted scores."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shift applied before rounding a computed double so that a value that is a
# decimal tie (x.xx5) rounds the same way whatever the engine or the float summation order.
TIE_EPSILON = 1e-9

# Decimal type used for scores (0-100 with one decimal) in weighted sums.
SCORE_DECIMAL = "decimal(6,1)"
# Decimal type used for two-decimal percentages entering a rescale.
PCT_DECIMAL = "decimal(18,2)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tie_safe_round(c, n: int = 0) -> Column:
    """``round`` half away from zero for computed doubles: the value is moved 1e-9 away from zero
    first, so a decimal tie rounds the same however the double was summed. Differs from plain
    ``round`` only within 1e-9 of a tie."""
    c = _col(c)
    return F.round(c + F.lit(TIE_EPSILON) * F.signum(c), n)


def money_change(current, past, n: int = 0) -> Column:
    """Rounded difference of two amounts with two decimals, in exact decimal arithmetic (ties round
    half away from zero), as double."""
    return F.round(_col(current).cast(PCT_DECIMAL) - _col(past).cast(PCT_DECIMAL), n).cast("double")


def round_half_even(c, n: int = 0) -> Column:
    """Banker's rounding (what pandas ``Series.round`` does)."""
    return F.bround(_col(c), n)


def safe_div(num, den) -> Column:
    """``num / nullif(den, 0)``: null instead of a division-by-zero error."""
    return _col(num) / F.nullif(_col(den), F.lit(0))


def pct_change(current, past, scale: int = 2) -> Column:
    """Rounded percent change ``(current - past) / past * 100``; null when past is null or 0."""
    return tie_safe_round(change_ratio(current, past) * 100, scale)


def change_ratio(current, past) -> Column:
    """Unrounded ``(current - past) / nullif(past, 0)``."""
    return safe_div(_col(current) - _col(past), past)


def default(c, value) -> Column:
    """``coalesce(c, value)``."""
    return F.coalesce(_col(c), F.lit(value))


def clamp(c, lo, hi) -> Column:
    """``least(greatest(c, lo), hi)``; greatest/least skip nulls, so a null input gives ``lo``."""
    return F.least(F.greatest(_col(c), F.lit(lo)), F.lit(hi))


def scale_clip(c, lo: int, hi: int) -> Column:
    """Map ``[lo, hi]`` linearly to ``[0, 100]`` and clamp, in exact decimal arithmetic.

    ``(c - lo) / (hi - lo) * 100`` is written as ``(c - lo) * (100 / (hi - lo))`` so the factor is an
    exact decimal (5 for a +/-10 range, 10 for 0-10) and ties round the same on every engine.
    Null input becomes 0 (the clamp skips nulls).
    """
    factor = Decimal(100) / Decimal(hi - lo)
    if factor == factor.to_integral_value():
        factor = Decimal(int(factor))
    scaled = (_col(c).cast(PCT_DECIMAL) - F.lit(Decimal(lo))) * F.lit(factor)
    return F.least(F.greatest(scaled, F.lit(Decimal(0))), F.lit(Decimal(100)))


def as_score(c) -> Column:
    """A 0-100, one-decimal score as an exact decimal."""
    return _col(c).cast(SCORE_DECIMAL)


def weighted_sum(parts: list[tuple[Column, str]]) -> Column:
    """Exact decimal ``sum(part * weight)``; weights are given as decimal strings ("0.30")."""
    total = None
    for part, weight in parts:
        term = part * F.lit(Decimal(weight))
        total = term if total is None else total + term
    return total


def weighted_score(parts: list[tuple[Column, str]], scale: int = 1) -> Column:
    """Weighted composite score rounded half-up to ``scale`` decimals, returned as double."""
    return F.round(weighted_sum(parts), scale).cast("double")


def share_pct(hits, total, scale: int = 1) -> Column:
    """``hits * 100.0 / total`` rounded, as double."""
    return tie_safe_round(_col(hits).cast("double") * F.lit(100.0) / _col(total), scale)
