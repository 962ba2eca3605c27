"""Report queries behind the dashboard and the documented SQL (R-02..R-17), as DataFrame functions
over the marts. Filters are predicates on the stored marts (pushed into the scan); only top-k and
small summaries are meant to be collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions import labels as L
from areascope.functions.keys import matches_any
from areascope.functions.numeric import tie_safe_round
from areascope.operators.aggregates import count_by, count_when, sorted_distinct, value_bounds
from areascope.operators.reshape import drop_missing, select_available

# Columns shown by each dashboard table.
TOP_ZIP_COLS = ("zip_code", "city", "state", "metro", "home_value", "monthly_rent", "gross_rental_yield",
                "price_change_1yr_pct", "neighborhood_score", "school_score", "livability_score", "livability_tier",
                "metro_rank")
TOP_INVESTMENT_COLS = ("zip_code", "city", "state", "metro", "home_value", "monthly_rent", "gross_rental_yield",
                       "annual_appreciation_rate", "investment_score", "cash_on_cash_estimate", "investment_signal")
METRO_TABLE_COLS = ("metro", "zip_count", "median_home_value", "avg_monthly_rent", "avg_rental_yield",
                    "avg_appreciation_rate", "avg_neighborhood_score", "avg_school_score", "avg_livability_score",
                    "pct_appreciating")
# Dashboard defaults.
PRICE_CEILING_DEFAULT = 500_000
PRICE_SLIDER_MAX = 2_000_000
HISTOGRAM_BINS = 30


def state_list(market: DataFrame) -> DataFrame:
    return sorted_distinct(market, "state")


def metro_list(market: DataFrame, states: Sequence[str] = ()) -> DataFrame:
    """Metros, limited to the selected states when any are selected."""
    base = market.where(F.col("state").isin(*states)) if states else market
    return sorted_distinct(base, "metro")


def price_bounds(market: DataFrame) -> DataFrame:
    """Slider bounds: integer min/max of home value and the default selected range."""
    b = value_bounds(market, "home_value")
    lo, hi = F.col("min_home_value"), F.col("max_home_value")
    return b.select(
        lo.alias("min_price"),
        F.least(hi, F.lit(PRICE_SLIDER_MAX).cast("long")).alias("slider_max"),
        lo.alias("default_low"),
        F.least(F.lit(PRICE_CEILING_DEFAULT).cast("long"), hi).alias("default_high"),
    )


def search(market: DataFrame, states: Sequence[str] = (), metros: Sequence[str] = (), price: tuple[float, float] | None = None,
           min_livability: float = 0, min_neighborhood: float = 0, min_school: float = 0, min_yield: float = 0) -> DataFrame:
    """The buyer search: membership filters only when a selection exists, inclusive price range,
    minimum scores, and a yield floor only when it is positive (nulls drop only then)."""
    out = market
    if states:
        out = out.where(F.col("state").isin(*states))
    if metros:
        out = out.where(F.col("metro").isin(*metros))
    if price is not None:
        out = out.where(F.col("home_value").between(price[0], price[1]))
    out = out.where((F.col("livability_score") >= min_livability) & (F.col("neighborhood_score") >= min_neighborhood)
                    & (F.col("school_score") >= min_school))
    if min_yield > 0:
        out = out.where(F.col("gross_rental_yield") >= min_yield)
    return out


def kpis(filtered: DataFrame) -> DataFrame:
    """Row count and the four means, rounded as displayed."""
    return filtered.agg(
        F.count(F.lit(1)).alias("zip_codes"),
        tie_safe_round(F.avg("home_value"), 0).alias("avg_home_value"),
        tie_safe_round(F.avg("monthly_rent"), 0).alias("avg_monthly_rent"),
        tie_safe_round(F.avg("gross_rental_yield"), 2).alias("avg_rental_yield"),
        tie_safe_round(F.avg("livability_score"), 1).alias("avg_livability"),
    )


def top_by(df: DataFrame, order_col: str, n: int | None, cols: Sequence[str] = (), tie_break: str = "zip_code") -> DataFrame:
    """Top-n by a column (descending), with a tie-break so the cut is deterministic."""
    ordered = df.orderBy(F.col(order_col).desc_nulls_last(), F.col(tie_break).asc())
    ordered = ordered.limit(n) if n is not None else ordered
    return select_available(ordered, cols) if cols else ordered


def top_zips(filtered: DataFrame, n: int = 50) -> DataFrame:
    return top_by(filtered, "livability_score", n, TOP_ZIP_COLS)


def livability_histogram(filtered: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins of livability between its min and max, counted per tier."""
    bounds = filtered.agg(F.min("livability_score").alias("lo"), F.max("livability_score").alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor((F.col("livability_score") - lo) / width)
    binned = F.when(hi == lo, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    return (filtered.where(F.col("livability_score").isNotNull())
            .groupBy(binned.alias("bin"), "livability_tier")
            .agg(F.count(F.lit(1)).alias("zip_count"),
                 F.min("livability_score").alias("bin_min_score"),
                 F.max("livability_score").alias("bin_max_score")))


def sample_rows(df: DataFrame, required: Sequence[str], n: int, cols: Sequence[str] = (), key: str = "zip_code") -> DataFrame:
    """First n rows with the required columns present, in key order (repeatable head)."""
    base = drop_missing(df, required).orderBy(key).limit(n)
    return select_available(base, cols) if cols else base


def signal_counts(invest: DataFrame, states: Sequence[str] = (), metros: Sequence[str] = ()) -> DataFrame:
    """One row: the number of areas per investment signal (zeros included)."""
    out = invest
    if states:
        out = out.where(F.col("state").isin(*states))
    if metros:
        out = out.where(F.col("metro").isin(*metros))
    names = ("strong_buy", "buy", "hold", "watch")
    return out.agg(*[count_when(F.col("investment_signal") == s).alias(n) for s, n in zip(L.SIGNALS, names)])


def signal_distribution(invest: DataFrame) -> DataFrame:
    return count_by(invest, "investment_signal")


def metro_ranking(metros: DataFrame, n: int | None = None, cols: Sequence[str] = METRO_TABLE_COLS) -> DataFrame:
    return top_by(metros, "avg_livability_score", n, cols, tie_break="metro")


def trend_counts(filtered: DataFrame) -> DataFrame:
    return count_by(filtered, "price_trend")


def yield_tier_counts(filtered: DataFrame) -> DataFrame:
    return count_by(filtered.where(F.col("yield_tier").isNotNull()), "yield_tier")


# ---------------------------------------------------------------- documented SQL (R-16)

def doc_top_livable(market: DataFrame, n: int = 10) -> DataFrame:
    return top_by(market, "livability_score", n, ("zip_code", "city", "state", "metro", "home_value", "monthly_rent",
                                                  "gross_rental_yield", "neighborhood_score", "school_score",
                                                  "livability_score", "livability_tier", "metro_rank"))


def doc_strong_buys(invest: DataFrame, n: int = 10) -> DataFrame:
    return top_by(invest.where(F.col("investment_signal") == "STRONG BUY"), "investment_score", n,
                  ("zip_code", "city", "state", "metro", "home_value", "monthly_rent", "gross_rental_yield",
                   "annual_appreciation_rate", "investment_score", "cash_on_cash_estimate", "investment_signal"))


def doc_compare_metros(metros: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return top_by(metros.where(matches_any(F.col("metro"), list(patterns))), "avg_livability_score", None,
                  METRO_TABLE_COLS, tie_break="metro")


def doc_affordable_good_schools(market: DataFrame, max_value: float = 300_000, min_school: float = 70, n: int = 20) -> DataFrame:
    return top_by(market.where((F.col("home_value") < max_value) & (F.col("school_score") >= min_school)),
                  "livability_score", n,
                  ("zip_code", "city", "state", "metro", "home_value", "school_score", "school_tier", "livability_score"))


def doc_high_yield_appreciating(invest: DataFrame, min_yield: float = 8, min_appreciation: float = 3) -> DataFrame:
    base = invest.where((F.col("gross_rental_yield") >= min_yield) & (F.col("annual_appreciation_rate") > min_appreciation))
    return top_by(base, "investment_score", None, ("zip_code", "city", "state", "home_value", "gross_rental_yield",
                                                   "price_change_1yr_pct", "investment_signal"))


# ---------------------------------------------------------------- dashboard widgets (R-17)

def metro_averages(market: DataFrame, col: str, out: str, scale: int) -> DataFrame:
    return (market.where(F.col("metro").isNotNull()).groupBy("metro")
            .agg(tie_safe_round(F.avg(col), scale).alias(out)))


def zips_by_tier(market: DataFrame) -> DataFrame:
    return count_by(market, "livability_tier")


def levels(mart: DataFrame) -> DataFrame:
    """KPIs, tier counts and price-trend counts for all areas, for each state and for each (state, metro), in one aggregation
    (grouping sets: the rows are expanded threefold before the map-side combine, and scanned once). ``level`` tells the rows of all
    areas from those of a state or metro that is null."""
    count = lambda cond, name: F.count(F.when(cond, F.lit(1))).alias(name)
    tiers = [count(F.col("livability_tier") == t, f"tier_{t[0].lower()}") for t in L.LIVABILITY_TIERS]
    trends = [count(F.col("price_trend") == t, t) for t in L.PRICE_TRENDS]
    sets = mart.groupingSets([[], ["state"], ["state", "metro"]], "state", "metro")
    table = sets.agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("areas"), F.count("gross_rental_yield").alias("areas_with_yield"),
                     tie_safe_round(F.avg("livability_score"), 1).alias("avg_livability"), tie_safe_round(F.avg("home_value"), 0).alias("avg_home_value"),
                     F.max("livability_score").alias("top_livability"), *tiers, *trends)
    level = F.when(F.col("_set") == 3, "all").when(F.col("_set") == 1, "state").otherwise("metro")
    # without an area there is no row, not even of the grand total
    return table.where("areas > 0").withColumn("level", level).drop("_set")
