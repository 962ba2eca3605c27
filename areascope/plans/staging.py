"""Staging: typed projections and row filters over the raw tables (P-01..P-07, C-16).

Raw inputs may be dirty (strings, NaN, empty strings). ANSI Spark raises on ``cast('' as int)``,
``'' = 1`` and ``cast(NaN as int)``, so every cast at this boundary is a ``try_cast`` and NaN is
normalised to null before any comparison (``NaN > 0`` is true in Spark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.functions.labels import school_level_name

PANEL_TEXT = ("zip_code", "city", "state", "state_name", "metro", "county")


_INTEGRAL = ("int", "bigint", "smallint", "tinyint")


class _Caster:
    """Casts for one raw table: ``try_cast`` for dirty input, the bare column when it already has
    the target type (a bare column keeps partition pruning and filter pushdown working)."""

    def __init__(self, df: DataFrame):
        self.types = dict(df.dtypes)

    def t(self, c: str, t: str) -> Column:
        if self.types.get(c) == t and t != "double":
            return F.col(c)
        return F.col(c).try_cast(t)

    def num(self, c: str, t: str = "double") -> Column:
        """try_cast to double, NaN -> null, then to the target type; integer columns carry no NaN
        and pass through."""
        if self.types.get(c) in _INTEGRAL:
            return F.col(c) if self.types[c] == t else F.col(c).try_cast(t)
        d = F.col(c).try_cast("double")
        d = F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
        return d if t == "double" else d.try_cast(t)


def _cols(df: DataFrame) -> set[str]:
    return set(df.columns)


def _opt(df: DataFrame, c: str, t: str) -> Column:
    return (_Caster(df).t(c, t) if c in _cols(df) else F.lit(None).cast(t)).alias(c)


def stage_panel(raw: DataFrame, value: str) -> DataFrame:
    """Typed monthly panel; keeps rows with a positive value and a key."""
    cx = _Caster(raw)
    # a double is compared as it is, so that "> 0" reaches the scan; NaN counts as larger than 0
    positive = (F.col(value) > 0) & ~F.isnan(value) if cx.types.get(value) == "double" else cx.num(value) > 0
    kept = raw.where(positive & F.col("zip_code").isNotNull())
    return kept.select(
        *[_opt(raw, c, "string") for c in PANEL_TEXT],
        cx.t("date", "date").alias("date"),
        (F.col(value) if cx.types.get(value) == "double" else cx.num(value)).alias(value),
        _opt(raw, "region_id", "int"),
        _opt(raw, "size_rank", "int"),
    )


def stage_home_values(raw: DataFrame) -> DataFrame:
    return stage_panel(raw, "home_value")


def stage_rental_prices(raw: DataFrame) -> DataFrame:
    return stage_panel(raw, "rental_price")


def stage_amenities(raw: DataFrame) -> DataFrame:
    cx = _Caster(raw)
    kept = raw.where(F.col("zip_code").isNotNull() & F.col("amenity_category").isNotNull())
    return kept.select(
        cx.t("zip_code", "string").alias("zip_code"),
        cx.t("amenity_name", "string").alias("amenity_name"),
        cx.t("amenity_type", "string").alias("amenity_type"),
        cx.t("amenity_category", "string").alias("amenity_category"),
        cx.num("latitude").alias("latitude"),
        cx.num("longitude").alias("longitude"),
        cx.t("city", "string").alias("city"),
        cx.t("state_name", "string").alias("state_name"),
    )


def stage_schools(raw: DataFrame) -> DataFrame:
    """Typed school records with a level label. The filter reads the raw enrollment (after NaN
    normalisation), before the integer cast, as the reference's WHERE does."""
    cx = _Caster(raw)
    enrollment = cx.num("enrollment")
    kept = raw.where(F.col("zip_code").isNotNull() & enrollment.isNotNull() & (enrollment > 0))
    level = cx.num("school_level", "int")
    return kept.select(
        cx.t("nces_school_id", "string").alias("nces_school_id"),
        cx.t("school_name", "string").alias("school_name"),
        cx.t("zip_code", "string").alias("zip_code"),
        cx.t("city", "string").alias("city"),
        cx.t("state", "string").alias("state"),
        level.alias("school_level"),
        cx.num("enrollment", "int").alias("enrollment"),
        cx.num("teachers_fte").alias("teachers_fte"),
        cx.num("free_lunch", "int").alias("free_lunch"),
        cx.num("charter", "int").alias("charter"),
        cx.num("magnet", "int").alias("magnet"),
        cx.num("title_i", "int").alias("title_i"),
        cx.num("latitude").alias("latitude"),
        cx.num("longitude").alias("longitude"),
        cx.num("year", "int").alias("year"),
        cx.num("student_teacher_ratio").alias("student_teacher_ratio"),
        cx.num("free_lunch_pct").alias("free_lunch_pct"),
        school_level_name(level).alias("school_level_name"),
    )
