"""The driver's tables read as curves, panels, forecasts and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvewalk.operators.candidates import KernelGrid
from curvewalk.operators.curve import COEFFICIENTS, curve_points
from curvewalk.operators.features import derive, future, lag, moving_average, spreads
from curvewalk.operators.folds import WalkForward
from curvewalk.operators.panel import load_panel, with_positions
from curvewalk.operators.scan import ID_GRANULE, ordered_scan, over_blocks
from curvewalk.sources.tables import materialize

PLAN = WalkForward(window=250, min_window=100, refit_every=30)
#: A window whose kernel matrix SQL can invert, and one value of each hyper-parameter of its processes.
NARROW = WalkForward(window=12, min_window=12, refit_every=30)
ONE = KernelGrid(length=(0.05,), mixture=(1.0,), period=(1.0,), constant=(0.1,), noise=(1e-4,), restarts=0)
FEATURES = ["beta0", "beta1", "beta2", "lambda_", "beta0_lag", "beta0_moving_avg_5", "slope_spread"]
TARGETS = ["beta0_future_val", "beta1_future_val", "beta2_future_val", "lambda_future_val"]
FORECAST_KEYS = ["segment"]
FORECAST_ORDER = ["date", "order_key"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def forecast_granules() -> list[Column]:
    """Date, then id range: order keys are unique, so the last level holds at most ID_GRANULE rows."""
    return [F.col("date"), F.expr(f"order_key div {ID_GRANULE}")]


def _coefficients() -> list[Column]:
    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    status = F.col("o_orderstatus")
    return [
        (0.02 + F.avg("o_totalprice") / 1e7).alias("beta0"),
        (-0.01 - 0.01 * share(status == "F")).alias("beta1"),
        (-0.005 + 0.01 * share(F.col("o_orderpriority").startswith("1"))).alias("beta2"),
        (0.3 + 0.1 * share(status == "O") + 1e-3 * F.least(F.count("*"), F.lit(50))).alias("lambda_"),
    ]


def daily_curve(spark: SparkSession, sf: str) -> DataFrame:
    """One coefficient row per date over all orders."""
    orders = table(spark, sf, "orders")
    return (
        orders.groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(*_coefficients())
        .select(F.lit("ALL").alias("series_id"), "date", *COEFFICIENTS)
    )


def curves(spark: SparkSession, sf: str, series: str = "c_mktsegment") -> DataFrame:
    """One coefficient row per customer group and date."""
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.groupBy(
        F.col(series).cast("string").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(*_coefficients())


def positioned_curves(spark: SparkSession, sf: str, series: str = "c_mktsegment") -> DataFrame:
    """Positions need two passes, so the curves are stored once instead of aggregated twice."""
    return with_positions(materialize(curves(spark, sf, series), "curves"))


def featured(spark: SparkSession, sf: str, series: str = "c_mktsegment") -> DataFrame:
    """Curves with features and 7-row-ahead labels, incomplete rows still in."""
    derived = derive(
        positioned_curves(spark, sf, series),
        {"beta0_lag": lag("beta0"), "beta0_moving_avg_5": moving_average("beta0", 5)}
        | {f"{c.rstrip('_')}_future_val": future(c, 7) for c in COEFFICIENTS},
    )
    return spreads(derived, {"slope_spread": ("beta1", "beta2")}).drop("pos", "pos_total")


def panel(spark: SparkSession, sf: str, series: str = "c_mktsegment") -> DataFrame:
    """Complete rows, positioned afterwards and stored: every fold operator reads it again."""
    complete = load_panel(featured(spark, sf, series), FEATURES, TARGETS)
    return materialize(with_positions(complete), "panel")


def forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("order_key"),
        (F.col("o_totalprice") / 1e5).alias("y_true"),
    )


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast pairs: the mean of the previous 10 values with the spread of the previous 30."""
    placed = ordered_scan(forecast_rows(spark, sf), FORECAST_KEYS, FORECAST_ORDER, forecast_granules())
    return over_blocks(
        placed,
        FORECAST_KEYS,
        {
            "y_pred": lambda w: F.avg("y_true").over(w.rowsBetween(-10, -1)),
            "y_std": lambda w: F.stddev_samp("y_true").over(w.rowsBetween(-30, -1)),
        },
        back=30,
    )


def stored_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast pairs as the stored result table that evaluation reads, often more than once."""
    return materialize(forecasts(spark, sf).drop("pos", "pos_total"), "forecasts")


def observed_yields(spark: SparkSession, sf: str) -> DataFrame:
    """Observed percent yields by date and tenor."""
    return curve_points(daily_curve(spark, sf))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding ``a`` beside the mean vector ``b`` of its label."""
    base = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("a")
    )
    means = (
        base.select("label", F.posexplode("a").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("items"))
        .select("label", F.col("items.x").alias("b"))
    )
    return base.join(means, "label")
