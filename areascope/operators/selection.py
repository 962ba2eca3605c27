"""Exact quantiles of groups of any size by distributed selection.

A sketch gives a value near the quantile, and collecting a group's values to sort them puts a group in one task. Here the
distinct values of all groups are counted once and stored; then each round cuts the range that still holds a
group's quantile into ``WAYS`` parts, counts them (map-side combined), and keeps the part that the wanted rank falls into. A part
is a range of values, so ties and hot values are one counted row, and no task ever holds a group. The rounds end
when every range is one value: a double has at most 2**64 of them, and the cut points are values of a sketch of the
range, so a round leaves about a ``WAYS``-th of the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areascope.session import materialize, store

#: Parts of a range in each round; accuracy of the sketch that places the cuts.
WAYS, ACCURACY = 256, 1000


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float = 0.5, out: str = "quantile", ways: int = WAYS) -> DataFrame:
    """(by..., ``out``): the smallest value of each group that at least ``q`` of its non-null values do not exceed
    (``percentile_disc``). Groups without a value have none. Null group keys are a group; NaN is the largest value."""
    if not 0 < q <= 1:
        raise ValueError("q must be in (0, 1]")
    by = list(by)
    counts = materialize(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "quantile-counts")
    # one row for each group: the wanted rank among the values that are left, from 1
    wanted = materialize(counts.groupBy(*by).agg(F.sum("_n").alias("_all")).select(*by, F.ceil(F.col("_all") * F.lit(q)).cast("long").alias("_rank")), "quantile-ranks")
    points = "array(" + ", ".join(repr(i / ways) for i in range(1, ways + 1)) + ")"
    real = "if(isnan(_v), null, _v)" if dict(counts.dtypes)["_v"] in ("double", "float") else "_v"
    # the smallest value is a cut as well, so a range always shrinks, whatever the sketch rounds
    cuts = F.expr(f"array_sort(array_distinct(array_append(coalesce(percentile_approx({real}, {points}, {ACCURACY}), array(min(_v))), min(_v))))")
    left = counts
    while True:
        held = _same(left, left.groupBy(*by).agg(cuts.alias("_cuts")), by)                                        # at most ``ways`` + 1 cuts of a group
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        placed = materialize(held.select(*by, "_v", "_n", part.alias("_part")), "quantile-parts")
        sums = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_values"))
        ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)               # at most ``ways`` + 1 rows
        sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
        hit = _same(sums, wanted, by).where((F.col("_rank") > F.col("_ahead")) & (F.col("_rank") <= F.col("_ahead") + F.col("_sum")))
        kept = store(hit.select(*by, "_part", (F.col("_rank") - F.col("_ahead")).alias("_rank"), "_values"), "quantile-ranges",
                     metrics={"more": F.count(F.when(F.col("_values") > 1, F.lit(1)))})
        wanted = kept.df.select(*by, "_rank")
        left = materialize(_same(placed, kept.df.select(*by, F.col("_part").alias("_hit")), by).where(F.col("_part") == F.col("_hit")).select(*by, "_v", "_n"), "quantile-left")
        if not kept.metrics.get("more"):
            return left.select(*by, F.col("_v").alias(out))


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on equal group keys, null being one; the columns of ``left`` and the others of ``right``."""
    other = right.toDF(*[f"_by_{c}" if c in by else c for c in right.columns])
    cond = F.lit(True)
    for c in by:
        cond = cond & left[c].eqNullSafe(other[f"_by_{c}"])
    return left.join(other, cond).drop(*[f"_by_{c}" for c in by])
