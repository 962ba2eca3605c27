"""The declared checks of the models (Q-01..Q-03), for queries that count them and builds that stop on them."""

from __future__ import annotations

from collections.abc import Iterable

from areascope.functions import labels as L
from areascope.operators.quality import Check

# The 35 declared checks, per model: (model, [(column, test, accepted values)]).
CHECKS = {
    "stg_home_values": [("zip_code", "not_null"), ("date", "not_null"), ("home_value", "not_null")],
    "stg_rental_prices": [("zip_code", "not_null"), ("date", "not_null"), ("rental_price", "not_null")],
    "stg_amenities": [("zip_code", "not_null"), ("amenity_category", "not_null"),
                      ("amenity_category", "accepted_values", L.AMENITY_CATEGORIES)],
    "stg_schools": [("nces_school_id", "not_null"), ("zip_code", "not_null"), ("year", "not_null"),
                    ("year", "accepted_values", (2017, 2022))],
    "int_price_trends": [("zip_code", "unique"), ("zip_code", "not_null"), ("price_trend", "accepted_values", L.PRICE_TRENDS)],
    "int_rental_yield": [("zip_code", "unique"), ("zip_code", "not_null"), ("yield_tier", "accepted_values", L.YIELD_TIERS)],
    "int_neighborhood_score": [("zip_code", "unique"), ("zip_code", "not_null"),
                               ("neighborhood_tier", "accepted_values", L.QUALITY_TIERS)],
    "int_school_score": [("zip_code", "unique"), ("zip_code", "not_null"), ("school_tier", "accepted_values", L.QUALITY_TIERS)],
    "market_intelligence": [("zip_code", "unique"), ("zip_code", "not_null"), ("livability_score", "not_null"),
                            ("livability_tier", "accepted_values", L.LIVABILITY_TIERS)],
    "investment_hotspots": [("zip_code", "unique"), ("zip_code", "not_null"),
                            ("investment_signal", "accepted_values", L.SIGNALS)],
    "area_comparison": [("metro", "unique"), ("metro", "not_null"), ("avg_livability_score", "not_null")],
}

# Raw tables hold real violations: months without rent, part types without a category, other school
# years, one area with many amenities.
RAW_CHECKS = {
    "raw_rental_prices": [("rental_price", "not_null"), ("zip_code", "unique")],
    "raw_amenities": [("amenity_category", "not_null"), ("zip_code", "unique"), ("amenity_category", "accepted_values", ("parks", "dining"))],
    "raw_schools": [("student_teacher_ratio", "not_null"), ("year", "accepted_values", (2017, 2022)), ("nces_school_id", "unique")],
}


def declared(specs: Iterable[tuple]) -> list[Check]:
    return [Check(s[0], s[1], tuple(s[2]) if len(s) > 2 else ()) for s in specs]


def stored_checks(raw: bool = True) -> dict[str, list[Check]]:
    """Checks of every model that a build writes. Raw tables break theirs (see above), so a build that stops leaves them out."""
    models = {m: declared(s) for m, s in CHECKS.items() if not m.startswith("stg_")}
    return {**models, **({m: declared(s) for m, s in RAW_CHECKS.items()} if raw else {})}
