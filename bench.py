"""Headline timings: one JSON line on stdout.

Reads ``$BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]``. Every query runs
whole and its full result is produced; plan building and stored intermediates are inside the time.
``queries`` and ``value`` are the second pass over all queries, ``first_pass`` the one that also pays
for starting Python workers and compiling code.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from contract import bindings as b
from contract import curve_queries as cq
from contract import evaluate_queries as eq
from contract import panel_queries as pq
from curvewalk.operators.folds import WalkForward
from curvewalk.plans.backtest import gaussian_backtest, ridge_backtest
from curvewalk.session import local_session

SERIES = "c_nationkey"


def nation_panel(spark: SparkSession, sf: str) -> DataFrame:
    return b.panel(spark, sf, SERIES)


def ridge_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Six priors, four targets, every window of 25 series."""
    return ridge_backtest(nation_panel(spark, sf), b.PLAN, b.FEATURES, b.TARGETS).forecasts


def ridge_long_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Window 2000, at least 1000, a refit every 30 predictions; six priors, four targets, 25 series."""
    return ridge_backtest(nation_panel(spark, sf), WalkForward(2000, 1000, 30), b.FEATURES, b.TARGETS).forecasts


def gaussian_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Exact process, three kernels, evidence climbed from the grid's best, the last 120 windows of 25 series."""
    plan = WalkForward(b.PLAN.window, b.PLAN.min_window, b.PLAN.refit_every, last_n=120)
    return gaussian_backtest(nation_panel(spark, sf), plan, b.FEATURES, b.TARGETS).forecasts


# Headline queries by name.
HEADLINES = {
    "load_panel": nation_panel,
    "positions": pq.c1_positions,
    "moving_averages": pq.d3_moving_average,
    "sample_percentiles_1000_draws": cq.e3_percentile,
    "mean_curves_1000_draws": cq.e7_mean_curves_wide,
    "curve_fit": cq.e9_curve_fit,
    "basic_metrics": eq.h1_basic,
    "ks_two_sample": eq.h5_ks_two_sample,
    "all_metrics": eq.h11_all_metrics,
    "ridge_walk_forward": ridge_walk_forward,
    "ridge_window_2000": ridge_long_windows,
    "gaussian_walk_forward": gaussian_walk_forward,
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").count().collect()
    passes = []
    for _ in range(2):
        times = {}
        for name, run in HEADLINES.items():
            started = time.perf_counter()
            run(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
        passes.append(times)
    first, times = passes
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first_pass": first,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
