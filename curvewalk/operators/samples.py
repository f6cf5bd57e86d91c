"""Predictive samples: point forecast plus scaled hashed normals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvewalk.functions import hashed_normal


def draw_table(spark: SparkSession, targets: list[str], n_samples: int) -> DataFrame:
    """``(sample_id, z_<target>...)``: the same draws for every date, as with one fixed seed."""
    ids = spark.range(n_samples).select(F.col("id").cast("int").alias("sample_id"))
    return ids.select(
        "sample_id", *[hashed_normal(F.col("sample_id"), t).alias(f"z_{t}") for t in targets]
    )


def draw_samples(
    forecast: DataFrame, targets: list[str], kept: list[str], n_samples: int = 1000, scale: float | None = None
) -> DataFrame:
    """``n_samples`` rows per forecast row, one column per target.

    Means are in ``prediction_<target>``; the spread is ``std_<target>``, or ``scale`` when given.
    Each forecast row expands in place and picks its draws by sample id from a table of
    ``n_samples`` rows; Spark knows that table's size and chooses the join.
    """
    draws = draw_table(forecast.sparkSession, targets, n_samples)

    def spread(target: str) -> Column:
        return F.lit(scale) if scale is not None else F.col(f"std_{target}")

    ids = F.sequence(F.lit(0), F.lit(n_samples - 1))
    return (
        forecast.withColumn("sample_id", F.explode(ids))
        .join(draws, "sample_id")
        .select(
            *kept,
            "sample_id",
            *[(F.col(f"prediction_{t}") + spread(t) * F.col(f"z_{t}")).alias(t) for t in targets],
        )
    )


def samples_long(samples: DataFrame, targets: list[str], kept: list[str]) -> DataFrame:
    return samples.unpivot([*kept, "sample_id"], targets, "target", "value")


def samples_wide(long: DataFrame, targets: list[str], kept: list[str]) -> DataFrame:
    """Long samples back to one row per draw; targets are listed, so no pass to find them."""
    return (
        long.groupBy(*kept, "sample_id").pivot("target", targets).agg(F.first("value"))
    )
