"""Distinct counts that add up: exact bitmaps of dense ids, kept for each cell and combined over any span.

``count(DISTINCT id)`` of a month cannot be added to that of another. A bitmap of the ids can: ids are dealt to bitmaps of
32,768 bits, each cell (a month of a metro, say) keeps the bitmaps that it has bits in, and the ids of any union of cells are the
set bits of their OR. A cell's rows are bounded by the ids, not by the facts, and bitmaps are built map-side before
the shuffle, so a hot cell is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_bitmaps(df: DataFrame, cells: Sequence[str], id_col: str) -> DataFrame:
    """(cells..., ``bucket``, ``bits``): the ids of each cell. Ids are integers from 0 on; a null id is in no bitmap, a negative one ends the job."""
    known = df.where(F.col(id_col).isNotNull()).withColumn("_id", F.when(F.col(id_col) >= 0, F.col(id_col).cast("long")).otherwise(
        F.raise_error(F.lit(f"{id_col} is negative")).cast("long")))
    return known.groupBy(*cells, F.bitmap_bucket_number("_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))


def distinct_over(bitmaps: DataFrame, by: Sequence[str | Column], out: str = "n") -> DataFrame:
    """Number of distinct ids of each group of ``by`` over all its cells, from the stored bitmaps alone."""
    named = [F.col(c) if isinstance(c, str) else c for c in by]
    merged = bitmaps.groupBy(*named, "bucket").agg(F.bitmap_or_agg("bits").alias("_bits"))
    names = [c for c in merged.columns if c not in ("bucket", "_bits")]
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("_bits")).cast("long").alias(out))
