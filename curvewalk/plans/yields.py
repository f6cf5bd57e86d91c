"""From stored coefficient samples and forecasts to yields: one job per output table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvewalk.operators.curve import COEFFICIENTS, mean_yields, point_yields, sample_yields
from curvewalk.sources import tables


Targets = list[str] | dict[str, str]


def coefficient_of(targets: Targets) -> dict[str, str]:
    """Which target is which coefficient, by name: a target starts with its coefficient's name.

    Targets with other names are given as a mapping to coefficients.
    """
    found = {}
    if isinstance(targets, dict):
        if sorted(targets.values()) != sorted(COEFFICIENTS):
            raise ValueError(f"targets must map to {COEFFICIENTS}, each once: {targets}")
        return targets
    for coefficient in COEFFICIENTS:
        stem = coefficient.rstrip("_")
        own = [t for t in targets if t == coefficient or t == stem or t.startswith(f"{stem}_")]
        if len(own) != 1:
            raise ValueError(f"no single target for {coefficient}: {own}; targets are {targets}")
        found[own[0]] = coefficient
    return found


def coefficient_names(samples: DataFrame, targets: Targets) -> DataFrame:
    """Rename target columns to curve coefficients, in whatever order they are listed."""
    return samples.withColumnsRenamed(coefficient_of(targets))


def transform_samples(
    spark: SparkSession, root: str, horizon: str, targets: Targets, max_group: int | None = 1000
) -> None:
    """Write sample yields with percentiles and mean yields below ``root`` for one horizon."""
    group = ["horizon", "series_id", "date"]
    samples = coefficient_names(tables.read_samples(spark, f"{root}/samples", horizon), targets)
    tables.write_table(sample_yields(samples, group, max_group), f"{root}/sample_yields", ["horizon"])
    tables.write_table(mean_yields(samples, group), f"{root}/mean_yields", ["horizon"])


def transform_forecasts(spark: SparkSession, root: str, horizon: str, targets: Targets) -> None:
    """Write actual and predicted yields of the stored long forecasts."""
    long = tables.read_samples(spark, f"{root}/results", horizon)
    parts = [
        F.max(F.when(F.col("target") == t, F.col(part))).alias(f"{part}_{c}")
        for t, c in coefficient_of(targets).items()
        for part in ("actual", "prediction")
    ]
    keys = ["horizon", "series_id", "date"]
    wide = long.groupBy(*keys).agg(*parts)
    tables.write_table(point_yields(wide, keys), f"{root}/yield_results", ["horizon"])


def transform_horizon(
    spark: SparkSession, root: str, horizon: str, targets: Targets, max_group: int | None = 1000
) -> None:
    """Every yield table of a horizon; a failing step raises."""
    transform_samples(spark, root, horizon, targets, max_group)
    transform_forecasts(spark, root, horizon, targets)
