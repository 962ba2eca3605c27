"""DataFrame -> DataFrame building blocks."""

from areascope.operators.aggregates import (
    approx_median,
    category_counts,
    count_by,
    count_when,
    distinct_keys,
    nunique,
    rounded_avg,
    sorted_distinct,
    value_bounds,
)
from areascope.operators.panel import (
    LOOKBACK_MONTHS,
    at_latest,
    common_latest,
    common_latest_value,
    latest_date,
    latest_date_value,
    lookback,
    multi_series_lookback,
)
from areascope.operators.ranking import percent_rank_scores, rank_within
from areascope.operators.reshape import drop_missing, rename_snake, select_available, split_columns, unpivot_panel

__all__ = [name for name in dir() if not name.startswith("_")]
