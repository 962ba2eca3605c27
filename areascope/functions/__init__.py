"""Column -> Column helpers. All are built-in Spark expressions (no Python UDFs)."""

from areascope.functions.keys import header_date, matches_any, pad_zip, school_zip, tag, zip5
from areascope.functions.labels import (
    classify_amenity,
    investment_signal,
    level_diversity,
    price_momentum,
    price_trend,
    school_level_name,
    school_trend,
    threshold_label,
    tier,
    yield_tier,
    yield_trend,
)
from areascope.functions.numeric import (
    as_score,
    change_ratio,
    clamp,
    default,
    pct_change,
    round_half_even,
    safe_div,
    scale_clip,
    share_pct,
    tie_safe_round,
    weighted_score,
    weighted_sum,
)

__all__ = [name for name in dir() if not name.startswith("_")]
