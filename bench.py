"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the cores.
Each query runs from the tables to a sink that reads every output row; caches are
dropped in between, so nothing is shared across queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelforge.plans.catalog import QUERIES
from panelforge.session import local_session

HEADLINE = (
    "price_upsert_old_wins", "disclosure_upsert_new_wins", "clean_prices_chain", "sector_index", "price_features",
    "cross_asset_features", "sector_fundamentals", "pca_residual_target", "train_test_sets", "ensemble_by_rank",
    "sector_single_feature_models", "long_short_performance", "daily_numerai", "quantile_bin_returns", "metric_suite",
    "daily_profit_by_sector", "trade_report_levels", "deposits_rolled_forward", "orders_netted", "tradable_weights",
    "label_agreement", "pairs_within_distance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
