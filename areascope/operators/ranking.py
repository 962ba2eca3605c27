"""Exact rank / percent_rank without a single-task window.

``percent_rank() OVER (ORDER BY x)`` with no PARTITION BY sends every row to one task
(``SinglePartition``), and ``rank() OVER (PARTITION BY metro ...)`` sorts a whole metro in one task,
so one hot metro holding a third of the rows becomes one giant task. Both are rebuilt here from
distributed pieces that only ever see *distinct values*; there is one path for every size:

1. ``groupBy(partition, value).count()`` - partial aggregation map-side, so a value repeated a
   billion times is one row (this also removes key skew). Nulls are counted apart.
2. Approximate quantiles of the distinct values give up to ``buckets - 1`` cut points. A value's
   bucket is the number of cut points below it, a monotone function of the value, so buckets are
   ordered and equal values always share one. The cuts only balance the work; results are exact.
   Buckets use a double key; the order inside a bucket is that of the value's own type, so long
   integers, dates, strings and NaN (the largest value, as in Spark) rank as in a window.
3. Within a (partition, bucket): a running sum of counts over the ordered distinct values gives the
   rows strictly before each value inside its bucket (window partitioned by bucket, never global).
4. Per partition: a running sum over the (at most ``buckets + 1``) bucket totals gives each
   bucket's offset and the partition's row count.
5. rows_before = offset + in-bucket running sum; ``rank = rows_before + 1`` and
   ``percent_rank = rows_before / (n - 1)`` (0 when n = 1), exactly SQL's tie semantics. Nulls come
   first when ascending and last when descending (Spark's and the reference's order).
6. One join for each ranked column brings the ranks back to the rows, on (partition, value). Values that the
   counts know to be hot are ranked by a broadcast of at most ``HOT`` values, and their rows are salted.

The counts and the running sums - distinct values only - are stored; cut points and totals are observed while the counts are written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areascope.functions.numeric import tie_safe_round
from areascope.session import materialize, store

# Buckets for each shuffle partition of the session, and the most of them.
BUCKETS_PER_PARTITION, MOST_BUCKETS = 4, 4096
# Accuracy of the quantile sketch used for bucket cut points (balance only, not exactness).
CUT_ACCURACY = 2000
# A value is hot if one row in so many holds it; its rows, ranked by a broadcast, go on under so many keys.
HOT, SALTS = 64, 64


def _equal(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs."""
    cond = None
    for lc, rc in pairs:
        term = left[lc].eqNullSafe(right[rc])
        cond = term if cond is None else (cond & term)
    return cond


def _bucket_key(value: Column, dtype: str) -> Column:
    """A double that never falls when the value rises; only used to place values in buckets."""
    if dtype == "date":
        return F.unix_date(value).cast("double")
    if dtype.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if dtype == "string" or dtype.startswith(("varchar", "char")):
        head = F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return value.cast("double")


def _with_bucket(counts: DataFrame, buckets: int) -> DataFrame:
    """``_b`` = number of cut points in the array ``_cuts`` below ``_key``: binary search over the sorted cuts
    (``buckets - 1`` of them) in log2(buckets) steps. The steps are lateral column aliases of one
    projection."""
    steps, prev, step, i = [F.lit(0).alias("_s0")], "_s0", buckets // 2, 0
    while step >= 1:
        i += 1
        probe = F.col(prev) + F.lit(step)
        below = F.coalesce(F.element_at("_cuts", probe) < F.col("_key"), F.lit(False))
        steps.append(F.when(below, probe).otherwise(F.col(prev)).alias(f"_s{i}"))
        prev, step = f"_s{i}", step // 2
    return counts.select("*", *steps).withColumnRenamed(prev, "_b").drop(*[f"_s{j}" for j in range(i)])


def _percentages(buckets: int) -> str:
    return "array(" + ", ".join(repr(k / buckets) for k in range(1, buckets)) + ")"


def _ranks(counts: DataFrame, parts: list[str], dtype: str, ascending: bool, buckets: int | None, groups: int = 1) -> tuple[DataFrame, int, int]:
    """``counts`` has ``parts``, ``_v`` (unique in its partition, null allowed), ``_rows`` and, for several ``groups`` that get cut
    points of their own, their number ``_m``. Returns it with ``_before`` (rows strictly ahead) and ``_n`` (rows of the partition);
    all rows counted; and the rows of the commonest value.

    Two small tables of distinct values are stored: the counts, whose cut points, sum and maximum are observed while they are
    written, and the running sums in the buckets."""
    if buckets is None:
        wanted = BUCKETS_PER_PARTITION * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(MOST_BUCKETS, 1 << max(1, (wanted - 1).bit_length()))
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two >= 2")
    group = F.col("_m") if groups > 1 else F.lit(0)
    key = F.when(F.col("_key").isNotNull() & ~F.isnan("_key"), F.col("_key"))
    sketches = {f"cuts{g}": F.percentile_approx(F.when(group == g, key), F.expr(_percentages(buckets)), CUT_ACCURACY) for g in range(groups)}
    kept = store(counts.withColumn("_key", _bucket_key(F.col("_v"), dtype)), "rank-counts",
                 metrics={**sketches, "total": F.sum("_rows"), "top": F.max("_rows")})
    arrays = ["array(" + ", ".join(f"double('{c!r}')" for c in kept.metrics.get(f"cuts{g}") or []) + ")" for g in range(groups)]
    arrays = [a if a != "array()" else "cast(null as array<double>)" for a in arrays]
    cuts = F.expr(arrays[0]) if groups == 1 else F.element_at(F.expr(f"array({', '.join(arrays)})"), F.col("_m") + 1)
    counts = _with_bucket(kept.df.withColumn("_cuts", cuts), buckets).drop("_cuts", "_key")
    # buckets and values in rank order, nulls at their end
    place = F.col("_b") if ascending else -F.col("_b")
    counts = counts.withColumn("_b", F.when(F.col("_v").isNull(), F.lit(-1 if ascending else 1)).otherwise(place))
    order = F.col("_v").asc() if ascending else F.col("_v").desc()
    in_bucket = Window.partitionBy(*parts, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(counts.withColumn("_in_b", F.coalesce(F.sum("_rows").over(in_bucket), F.lit(0))), "rank-sums")
    by_part = Window.partitionBy(*parts)
    ahead = by_part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy(*parts, "_b").agg(F.sum("_rows").alias("_b_rows")).select(
        *[F.col(p).alias(f"_t_{p}") for p in parts], F.col("_b").alias("_t_b"),
        F.coalesce(F.sum("_b_rows").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_b_rows").over(by_part).alias("_n"))
    joined = sums.join(totals, _equal(sums, totals, [*[(p, f"_t_{p}") for p in parts], ("_b", "_t_b")]))
    ranks = joined.select(*parts, "_v", "_rows", (F.col("_offset") + F.col("_in_b")).alias("_before"), "_n")
    return ranks, int(kept.metrics.get("total") or 0) // groups, int(kept.metrics.get("top") or 0)


def _join_back(rows: DataFrame, ranks: DataFrame, pairs: Sequence[tuple[str, str]], total: int, top: int, out: str) -> DataFrame:
    """``rows`` with the column ``out`` of ``ranks`` (which has ``_rows``), joined on ``pairs``. Its strategy is left to AQE, which
    broadcasts few ranks and beyond that shuffles the rows once.

    Keys that hold at least one of ``HOT`` rows, if the counts know any, are ranked by a broadcast (at most ``HOT`` keys); their rows
    pass the main join under a salt, so no key of it is hot."""
    keys = [r for _, r in pairs]
    if top * HOT < total:
        return rows.join(ranks, _equal(rows, ranks, pairs), "left").select(*rows.columns, out)
    hot_names = {k: f"_hot{k}" for k in [*keys, out]}
    is_hot = F.col("_rows") * HOT >= total
    hot = F.broadcast(ranks.where(is_hot).select(*[F.col(k).alias(n) for k, n in hot_names.items()]))
    marked = rows.join(hot, _equal(rows, hot, [(a, hot_names[b]) for a, b in pairs]), "left")
    found = F.col(hot_names[out])
    salt = F.when(found.isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + 1).otherwise(0).cast("int")
    marked = marked.select(*rows.columns, found.alias("_found"), salt.alias("_salt"))
    cold = ranks.where(~is_hot).select(*keys, out, F.lit(0).alias("_r_salt"))
    joined = marked.join(cold, _equal(marked, cold, pairs) & (marked["_salt"] == cold["_r_salt"]), "left")
    return joined.select(*rows.columns, F.coalesce(F.col(out), F.col("_found")).alias(out))


def _pct(before: Column, n: Column) -> Column:
    return F.when(n > 1, before.cast("double") / (n - 1).cast("double")).otherwise(F.lit(0.0))


def percent_rank_scores(
    df: DataFrame,
    specs: Mapping[str, tuple],
    scale: int | None = 1,
    buckets: int | None = None,
    reuse_input: bool = True,
) -> DataFrame:
    """Add ``round(percent_rank() OVER (ORDER BY col [DESC]) * 100, scale)`` for each
    ``{out: (col, ascending[, scale])}``, over the whole DataFrame, without a global window.

    Columns of one type and direction share one stacked count. A scale of None returns the raw 0-1 fraction.
    ``reuse_input`` writes ``df`` once first, since it is read by the counts and the joins back.
    """
    specs = dict(specs)
    names = list(specs)
    if reuse_input:
        df = materialize(df, "rank-input")
    types = dict(df.dtypes)
    groups: dict[tuple[str, bool], list[str]] = {}
    for name in names:
        col, asc = specs[name][:2]
        groups.setdefault((types[col], bool(asc)), []).append(name)

    keyed = [c for c in df.columns if c not in specs]
    inputs = {n: f"_in_{n}" for n in names}
    out = df.select(*keyed, *[F.col(specs[n][0]).alias(inputs[n]) for n in names])
    for (dtype, asc), members in groups.items():
        stacked = df.select(F.posexplode(F.array(*[F.col(specs[n][0]) for n in members])).alias("_m", "_v"))
        counts = stacked.groupBy("_m", "_v").agg(F.count(F.lit(1)).alias("_rows"))
        ranks, total, top = _ranks(counts, ["_m"], dtype, asc, buckets, len(members))
        for i, name in enumerate(members):
            own = ranks.where(F.col("_m") == i).select(F.col("_v").alias("_rv"), "_rows", _pct(F.col("_before"), F.col("_n")).alias(f"_p_{name}"))
            out = _join_back(out, own, [(inputs[name], "_rv")], total, top, f"_p_{name}").drop(inputs[name])
    scores = []
    for name in names:
        pr = F.col(f"_p_{name}")
        spec_scale = specs[name][2] if len(specs[name]) > 2 else scale
        scores.append((pr if spec_scale is None else tie_safe_round(pr * 100, spec_scale)).alias(name))
    return out.select(*keyed, *scores)


def rank_within(
    df: DataFrame,
    partition_by: str | Sequence[str],
    order_col: str,
    out: str = "rank",
    descending: bool = True,
    buckets: int | None = None,
    reuse_input: bool = True,
) -> DataFrame:
    """Add ``rank() OVER (PARTITION BY p ORDER BY order_col [DESC])`` as ``out`` (int).

    Ties share a rank; null partition keys form one partition; null order values sort last when
    descending and first when ascending. No task ever holds a whole partition.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    if reuse_input:
        df = materialize(df, "rank-input")
    counts = df.groupBy(*parts, F.col(order_col).alias("_v")).agg(F.count(F.lit(1)).alias("_rows"))
    ranks, total, top = _ranks(counts, parts, dict(df.dtypes)[order_col], not descending, buckets)
    ranks = ranks.select(*[F.col(p).alias(f"_r_{p}") for p in parts], F.col("_v").alias("_r_order"), "_rows", (F.col("_before") + 1).cast("int").alias("_rank"))
    rows = _join_back(df, ranks, [*[(p, f"_r_{p}") for p in parts], (order_col, "_r_order")], total, top, "_rank")
    return rows.select(*df.columns, F.col("_rank").alias(out))
