"""Panels: one row per (series_id, date), complete rows, dense positions, lookups, description."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewalk.functions import clean
from curvewalk.operators.scan import ordered_scan
from curvewalk.operators.selection import order_statistics

KEY = ["series_id"]


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep rows where every listed column is present; NaN counts as missing."""
    return df.na.drop(subset=columns)


def load_panel(
    df: DataFrame, features: list[str], targets: list[str], key: list[str] | None = None
) -> DataFrame:
    """Project to key, date, features and targets, then drop incomplete rows."""
    wanted = list(dict.fromkeys([*features, *targets]))
    return complete_rows(df.select(*(key or KEY), "date", *wanted), wanted)


def with_positions(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Dense 0-based ``pos`` per series in date order, and ``pos_total`` rows per series.

    The scan cuts a series by year, so a task never holds more than one series-year.
    """
    return ordered_scan(df, keys or KEY, ["date"], [F.year("date")])


def position_slice(df: DataFrame, start: int, end: int, columns: list[str]) -> DataFrame:
    """Rows with ``start <= pos < end`` of every series."""
    return df.filter((F.col("pos") >= start) & (F.col("pos") < end)).select(
        *KEY, "date", "pos", *columns
    )


def at_position(df: DataFrame, position: int, columns: list[str]) -> DataFrame:
    """The row at one position of every series; a position past the end of a series raises."""
    inside = F.col("pos_total") > position
    guard = F.assert_true(inside, F.lit(f"position {position} is out of bounds"))
    return (
        df.filter((F.col("pos") == position) | (~inside & (F.col("pos") == F.col("pos_total") - 1)))
        .filter(F.coalesce(guard.cast("boolean"), F.lit(True)))
        .select(*KEY, "date", "pos", *columns)
    )


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def within_dates_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``df`` dated inside the first and last date of ``other``, both included.

    The two bounds are scalar subqueries: no join, and Parquet can use them as filters.
    """
    bounds = date_range(other)
    low = bounds.select("min_date").scalar()
    high = bounds.select("max_date").scalar()
    return df.filter(F.col("date").between(low, high))


def describe(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max of every column.

    Quartiles interpolate linearly between the two nearest order statistics, which are found by counting cells: no table
    of values is shuffled or buffered. A column without values has count 0.
    """
    keys = keys or []
    by = [*keys, "column_name"]
    long = df.select(*keys, *columns).unpivot(keys, columns, "column_name", "value")
    moments = long.select(*by, clean("value").alias("value")).groupBy(*by).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    places = {f"{q}_low": partial(_place, share) for q, share in shares.items()}
    places |= {f"{q}_high": partial(_place, share, above=True) for q, share in shares.items()}
    found = order_statistics(df, keys, columns, places)
    blend = []
    for q, share in shares.items():
        part = (F.col("n") - 1) * F.lit(share) - _place(share, F.col("n"))
        blend.append((F.col(f"{q}_low") + (F.col(f"{q}_high") - F.col(f"{q}_low")) * part).alias(q))
    return moments.join(found, by, "left").select(*by, "count", "mean", "std", "min", *blend, "max")


def _place(share: float, n: Column, above: bool = False) -> Column:
    """The order statistic at or just below a share of n values, or the one above."""
    low = F.floor((n - 1) * F.lit(share))
    return F.least(low + 1, n - 1) if above else low
