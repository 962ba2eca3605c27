"""areascope: place-over-time analytics (value/rent panels, amenities, schools) on Spark DataFrames.

Layout
------
functions/  Column -> Column helpers (rounding, clamps, labels, key cleaning)
operators/  DataFrame -> DataFrame building blocks (one-pass lookback, distributed ranks,
            conditional counts, data-quality checks)
sources/    ingestion (wide CSV, JSON pages, lookups), profiles, and the adapter that derives
            the four domain tables from the benchmark tables
plans/      the layered models: staging -> intermediate -> marts, plus report queries
streaming/  incremental ingestion of landed API pages with Structured Streaming
"""

__version__ = "0.1.0"
