"""Label rules (searched CASE expressions) used by the models.

Every rule is a plain ``when`` chain, so it stays inside whole-stage codegen. Comparisons against
null fall through to the last branch, as in SQL CASE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score tier cut-offs (inclusive lower bounds) and the label sets that use them.
TIER_BOUNDS = (80, 60, 40, 20)
QUALITY_TIERS = ("excellent", "good", "average", "below_average", "poor")
LIVABILITY_TIERS = ("A - Premium", "B - Good", "C - Average", "D - Below Average", "F - Poor")

# Price trend thresholds on the unrounded 1-year change ratio (strict >).
PRICE_TREND_BOUNDS = (0.05, 0.01, -0.01, -0.05)
PRICE_TRENDS = ("strong_appreciation", "moderate_appreciation", "stable", "moderate_decline", "strong_decline")

# Yield tiers (inclusive lower bounds on the rounded yield, percent).
YIELD_BOUNDS = (8, 6, 4, 2)
YIELD_TIERS = ("premium", "strong", "average", "below_average", "low")

# Investment signals.
SIGNALS = ("STRONG BUY", "BUY", "HOLD", "WATCH")

# School level codes 1-4 and their names; anything else is Unknown.
SCHOOL_LEVELS = {1: "Primary", 2: "Middle", 3: "High", 4: "Other"}

# Amenity tag rules, checked in this order.
PARK_LEISURE = ("park", "garden", "nature_reserve")
ENTERTAINMENT_AMENITY = ("cinema", "theatre")
DINING_AMENITY = ("restaurant", "cafe", "fast_food", "bar")
AMENITY_TAGS = ("leisure", "shop", "amenity", "tourism")
AMENITY_CATEGORIES = ("parks", "shopping", "entertainment", "dining")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def threshold_label(c, bounds, labels, strict: bool = False) -> Column:
    """First label whose bound ``c`` reaches (``>=``, or ``>`` when strict); else the last label."""
    c = _col(c)
    expr = None
    for bound, label in zip(bounds, labels):
        cond = (c > F.lit(bound)) if strict else (c >= F.lit(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[len(bounds)]))


def tier(score, labels=QUALITY_TIERS) -> Column:
    """Score tier at 80/60/40/20."""
    return threshold_label(score, TIER_BOUNDS, labels)


def price_trend(ratio, null_label: str | None = None) -> Column:
    """Trend from the unrounded 1-year ratio; a null ratio gets ``null_label``, or lands in the last
    label as in the reference."""
    label = threshold_label(ratio, PRICE_TREND_BOUNDS, PRICE_TRENDS, strict=True)
    return label if null_label is None else F.when(_col(ratio).isNull(), F.lit(null_label)).otherwise(label)


def price_momentum(annualised_short, long) -> Column:
    return F.when(_col(annualised_short) > _col(long), F.lit("accelerating")).otherwise(F.lit("decelerating"))


def yield_tier(current_yield) -> Column:
    return threshold_label(current_yield, YIELD_BOUNDS, YIELD_TIERS)


def yield_trend(current_yield, past_yield) -> Column:
    cur, past = _col(current_yield), _col(past_yield)
    return (F.when(cur > past, F.lit("improving"))
            .when(cur < past, F.lit("compressing"))
            .otherwise(F.lit("stable")))


def school_trend(str_change, enrollment_change) -> Column:
    s, e = _col(str_change), _col(enrollment_change)
    return (F.when((s < -1) & (e > 0), F.lit("improving"))
            .when((s > 1) & (e < 0), F.lit("declining"))
            .otherwise(F.lit("stable")))


def investment_signal(gross_yield, appreciation, neighborhood) -> Column:
    y, a, n = _col(gross_yield), _col(appreciation), _col(neighborhood)
    return (F.when((y >= 6) & (a > 2) & (n >= 50), F.lit(SIGNALS[0]))
            .when((y >= 4) & (a > 0) & (n >= 30), F.lit(SIGNALS[1]))
            .when((y >= 3) & (a > -2), F.lit(SIGNALS[2]))
            .otherwise(F.lit(SIGNALS[3])))


def school_level_name(level) -> Column:
    level = _col(level)
    expr = None
    for code, name in SCHOOL_LEVELS.items():
        cond = level == F.lit(code)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("Unknown"))


def level_diversity(primary, middle, high) -> Column:
    """33.3 + 33.3 + 33.4 points for having primary / middle / high schools (exact decimal)."""
    from decimal import Decimal

    def pts(c, v):
        return F.when(_col(c) > 0, F.lit(Decimal(v))).otherwise(F.lit(Decimal("0.0")))

    return F.round(pts(primary, "33.3") + pts(middle, "33.3") + pts(high, "33.4"), 1)


def classify_amenity(tags) -> tuple[Column, Column]:
    """(category, amenity_type) from a map-tag dictionary (or a struct of ``AMENITY_TAGS``), first matching rule wins; null when no rule fits."""
    t = _col(tags)
    leisure, shop, amenity, tourism = (t[key] for key in AMENITY_TAGS)
    is_park = leisure.isin(*PARK_LEISURE)
    is_shop = (shop.isNotNull() & (shop != F.lit(""))) | (amenity == F.lit("marketplace"))
    is_ent = amenity.isin(*ENTERTAINMENT_AMENITY) | (leisure == F.lit("fitness_centre")) | (tourism == F.lit("museum"))
    is_dining = amenity.isin(*DINING_AMENITY)
    category = (F.when(is_park, F.lit("parks"))
                .when(is_shop, F.lit("shopping"))
                .when(F.coalesce(is_ent, F.lit(False)), F.lit("entertainment"))
                .when(is_dining, F.lit("dining")))
    kind = (F.when(is_park, leisure)
            .when(is_shop, F.coalesce(shop, F.lit("marketplace")))
            .when(F.coalesce(is_ent, F.lit(False)), F.coalesce(amenity, leisure, tourism))
            .when(is_dining, amenity))
    return category, kind
