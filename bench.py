"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Runs in build order, like a model build followed by the dashboard: ``raw_layer`` derives and
writes the four raw tables from the benchmark tables; staging and intermediate models are views
over them; the three marts are stored tables (the market mart is built once and read by the two
downstream marts and the reports). Each timing is the incremental wall time of executing that
query's full plan into Spark's ``noop`` sink (every stage runs, every row is produced; rows are not
shipped into this Python process).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from areascope import registry  # noqa: E402
from areascope.operators.panel import latest_date_value, lookback, self_join_lookback  # noqa: E402
from areascope.operators.ranking import percent_rank_scores  # noqa: E402
from areascope.plans.build import build_raw_layer  # noqa: E402
from areascope.session import local_session  # noqa: E402

LAGS = {"value_30d_ago": 1, "value_6m_ago": 6, "value_1yr_ago": 12}
HEADLINE = [
    "price_trends", "rental_yield", "neighborhood_score", "school_score", "livability", "investment",
    "area_comparison", "lookback_sparse", "percentile_scores", "value_rank_by_month", "unpivot_panel",
    "amenity_json_flatten", "school_json_flatten", "map_to_zip", "top_zips", "buyer_search", "kpis", "signal_counts",
    "dq_unique", "build_marts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    times: dict[str, float] = {}
    # untimed warm-up: JVM class loading and code generation for a trivial shuffle
    spark.range(1000).groupBy("id").count().collect()

    t0 = time.time()
    p = registry.layers(spark, sf_dir)
    build_raw_layer(p)   # four independent writes as concurrent jobs
    times["raw_layer"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        t = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    # the reference's own plan shapes on the same stored panel, for comparison (not part of the total)
    total = round(sum(times.values()), 3)
    hv = p.stg_home_values
    shapes = {
        "shape_one_pass_lookback": lambda: lookback(hv, "zip_code", "home_value", latest_date_value(hv), LAGS),
        "shape_self_join_lookback": lambda: self_join_lookback(hv, "zip_code", "home_value", LAGS),
        "shape_bucketed_percent_rank": lambda: percent_rank_scores(hv, {"pr": ("home_value", True)}, reuse_input=False),
        "shape_window_percent_rank": lambda: hv.select("*", F.percent_rank().over(Window.orderBy("home_value")).alias("pr")),
    }
    for name, make in shapes.items():
        t = time.time()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
