"""Wiring: raw tables -> staging -> intermediate -> marts.

Staging is a lazy view over the stored raw tables (Catalyst inlines and prunes it). Intermediate
models (one row per area) and marts are written once to the shared checkpoint folder, so every
consumer reads stored files instead of re-running their lineage. Intermediate models are bucketed by
postal code, so the marts assemble them without a shuffle. The declared checks of a stored model are
counted while it is written; with ``stop`` a violation ends the build before anything reads the model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from areascope.plans import intermediate as I
from areascope.plans import marts as M
from areascope.operators.quality import Check, CheckFailed, observed_checks, observed_violations
from areascope.plans import staging as S
from areascope.session import Stored, materialize, store
from areascope.sources import adapter, landed


@dataclass
class Layers:
    spark: SparkSession
    raw_home_values: DataFrame
    raw_rental_prices: DataFrame
    raw_amenities: DataFrame
    raw_schools: DataFrame
    checks: Mapping[str, Sequence[Check]] = field(default_factory=dict)
    stop: bool = False
    stored: dict[str, Stored] = field(default_factory=dict)
    violations: dict[str, list[tuple[str, str, str, int]]] = field(default_factory=dict)

    @classmethod
    def from_benchmark(cls, spark: SparkSession, sf_dir: str, checks: Mapping[str, Sequence[Check]] | None = None,
                       stop: bool = False) -> "Layers":
        """Raw tables derived from the benchmark tables. They are the stored raw layer (the
        reference lands them as tables too); each is written once, on first use."""
        return BenchmarkLayers(spark, sf_dir, checks, stop)

    def _store(self, name: str, df: DataFrame, **how) -> DataFrame:
        """Write a model with its checks counted on the way; a violation raises ``CheckFailed`` if ``stop`` is set."""
        checks = self.checks.get(name, ())
        kept = store(df, name, metrics=observed_checks(checks), **how)
        found = observed_violations(name, checks, kept.metrics, kept.df)
        self.stored[name], self.violations[name] = kept, found
        failed = [f for f in found if f[3]]
        if self.stop and failed:
            raise CheckFailed(failed)
        return kept.df

    # staging
    @cached_property
    def stg_home_values(self) -> DataFrame:
        return S.stage_home_values(self.raw_home_values)

    @cached_property
    def stg_rental_prices(self) -> DataFrame:
        return S.stage_rental_prices(self.raw_rental_prices)

    @cached_property
    def stg_amenities(self) -> DataFrame:
        return S.stage_amenities(self.raw_amenities)

    @cached_property
    def stg_schools(self) -> DataFrame:
        return S.stage_schools(self.raw_schools)

    # intermediate: one row per area each; written once per Layers object so the market mart, the
    # reports and the quality checks reuse them instead of re-deriving them from the raw layer
    @cached_property
    def price_trends(self) -> DataFrame:
        return self._store("int_price_trends", I.price_trends(self.stg_home_values), bucket_by=("zip_code",))

    @cached_property
    def rental_yield(self) -> DataFrame:
        return self._store("int_rental_yield", I.rental_yield(self.stg_rental_prices, self.stg_home_values), bucket_by=("zip_code",))

    @cached_property
    def neighborhood_score(self) -> DataFrame:
        return self._store("int_neighborhood_score", I.neighborhood_score(self.stg_amenities), bucket_by=("zip_code",))

    @cached_property
    def school_score(self) -> DataFrame:
        return self._store("int_school_score", I.school_score(self.stg_schools), bucket_by=("zip_code",))

    # marts: stored tables (reports and the two downstream marts read the stored market table)
    @cached_property
    def market_intelligence(self) -> DataFrame:
        mart = M.market_intelligence(self.price_trends, self.rental_yield, self.neighborhood_score, self.school_score)
        return self._store("market_intelligence", mart)

    @cached_property
    def investment_hotspots(self) -> DataFrame:
        return self._store("investment_hotspots", M.investment_hotspots(self.market_intelligence))

    @cached_property
    def area_comparison(self) -> DataFrame:
        return self._store("area_comparison", M.area_comparison(self.market_intelligence))


class BenchmarkLayers(Layers):
    """Layers whose raw tables are derived from the benchmark tables and materialised on
    first use, so a query touching only the value panel never builds the school table."""

    def __init__(self, spark: SparkSession, sf_dir: str, checks: Mapping[str, Sequence[Check]] | None = None, stop: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir
        self.checks, self.stop, self.stored, self.violations = checks or {}, stop, {}, {}

    @cached_property
    def area_dimension(self) -> DataFrame:
        """One row per area, read by all four raw tables: written once."""
        return materialize(adapter.dimension(self.spark, self.sf_dir), "dim_area")

    @cached_property
    def monthly_cells(self) -> DataFrame:
        """Value and rent of each (area, month), read by both panels: one scan of the lines."""
        return materialize(adapter.monthly_cells(self.spark, self.sf_dir), "monthly_cells")

    @cached_property
    def raw_home_values(self) -> DataFrame:
        raw = adapter.raw_home_values(self.spark, self.sf_dir, self.area_dimension, self.monthly_cells)
        return self._store("raw_home_values", raw, partition_by=("date",))

    @cached_property
    def raw_rental_prices(self) -> DataFrame:
        raw = adapter.raw_rental_prices(self.spark, self.sf_dir, self.area_dimension, self.monthly_cells)
        return self._store("raw_rental_prices", raw, partition_by=("date",))

    @cached_property
    def raw_amenities(self) -> DataFrame:
        return self._store("raw_amenities", adapter.raw_amenities(self.spark, self.sf_dir, self.area_dimension))

    @cached_property
    def raw_schools(self) -> DataFrame:
        return self._store("raw_schools", adapter.raw_schools(self.spark, self.sf_dir, self.area_dimension),
                           partition_by=("year",), rebalance=False)     # its lines are, before they get their names

    # landed files, written once as a fetcher would
    @cached_property
    def landed_wide_csv(self) -> str:
        return landed.land_wide_csv(self.raw_home_values, "home_value", "wide")

    @cached_property
    def landed_amenities(self) -> str:
        return landed.land_documents(landed.amenity_documents(self.spark, self.sf_dir, self.area_dimension), "amenities")

    @cached_property
    def landed_schools(self) -> str:
        return landed.land_documents(landed.school_documents(self.spark, self.sf_dir, self.area_dimension), "schools")
