"""Key cleaning: postal codes, ZIP+4, header dates, map lookups with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_zip(c, width: int = 5) -> Column:
    """Left-pad with '0' to ``width``; longer strings are kept whole (``lpad`` alone truncates)."""
    s = _col(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def zip5(c) -> Column:
    """ZIP+4 -> ZIP: the part before the first '-'."""
    return F.split(_col(c).cast("string"), "-", 2).getItem(0)


def school_zip(mailing, location) -> Column:
    """Mailing ZIP, else location ZIP, cut at '-' and padded. Missing both gives null (the staging
    filter then drops the row) instead of the literal strings the pandas path produced."""
    raw = F.coalesce(_col(mailing).cast("string"), _col(location).cast("string"))
    cleaned = zip5(raw)
    return F.when(cleaned.isNull() | (cleaned == F.lit("")), F.lit(None).cast("string")).otherwise(pad_zip(cleaned))


def header_date(c) -> Column:
    """Parse a month column header (``2024-01-31``) into a date."""
    return F.to_date(_col(c))


def tag(map_col, key: str, default: str | None = None) -> Column:
    """``map[key]`` with an optional default."""
    v = _col(map_col)[key]
    return v if default is None else F.coalesce(v, F.lit(default))


def matches_any(c, patterns: list[str]) -> Column:
    """``c LIKE p1 OR c LIKE p2 ...``."""
    c = _col(c)
    expr = None
    for p in patterns:
        term = c.like(p)
        expr = term if expr is None else (expr | term)
    return expr
