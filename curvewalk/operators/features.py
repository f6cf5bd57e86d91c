"""Derived panel columns. Any number of derivations share one block shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvewalk.functions import clean
from curvewalk.operators.panel import KEY
from curvewalk.operators.scan import decayed_mean, over_blocks


@dataclass(frozen=True)
class Derivation:
    """A window function that looks so many rows back and ahead, or a mean of everything before that decays."""

    build: Callable | None = None
    back: int = 0
    ahead: int = 0
    decayed: tuple[str, float] | None = None


def future(column: str, rows: int) -> Derivation:
    """Label: the value ``rows`` rows later."""
    return Derivation(lambda w: F.lead(column, rows).over(w), ahead=rows)


def lag(column: str, rows: int = 1) -> Derivation:
    return Derivation(lambda w: F.lag(column, rows).over(w), back=rows)


def moving_average(column: str, rows: int) -> Derivation:
    """Trailing mean, NULL until ``rows`` values are present."""

    def build(w) -> Column:
        frame = w.rowsBetween(-(rows - 1), 0)
        return F.when(F.count(column).over(frame) == rows, F.avg(column).over(frame))

    return Derivation(build, back=rows - 1)


def exponential_average(column: str, span: int) -> Derivation:
    """Decayed mean with alpha = 2 / (span + 1) and weights renormalised at the series start; see ``decayed_mean``."""
    if span < 2:
        raise ValueError("span must be at least 2; with span 1 the average is the column itself")
    return Derivation(decayed=(column, 1.0 - 2.0 / (span + 1)))


def average_spread(column: str, short: int, long: int) -> Derivation:
    """Short trailing mean minus long trailing mean."""
    a, b = moving_average(column, short), moving_average(column, long)
    return Derivation(lambda w: a.build(w) - b.build(w), back=max(a.back, b.back))


def derive(df: DataFrame, derivations: Mapping[str, Derivation], keys: list[str] | None = None) -> DataFrame:
    """Append derived columns to a panel that carries ``pos``; NaN counts as missing and becomes NULL.

    Derivations over neighbouring rows share one pass over blocks; a decayed mean takes one of its own.
    """
    numbers = {f.name: clean(f.name) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    out, near = df.withColumns(numbers), {n: d for n, d in derivations.items() if not d.decayed}
    for name, derivation in derivations.items():
        if derivation.decayed:
            out = decayed_mean(out, keys or KEY, *derivation.decayed, name)
    if near:
        builds = {n: d.build for n, d in near.items()}
        out = over_blocks(out, keys or KEY, builds, back=max(d.back for d in near.values()), ahead=max(d.ahead for d in near.values()))
    return out.select(*df.columns, *derivations)


def spreads(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Differences of two columns, e.g. a curve spread or ``spread_A_vs_B``."""
    return df.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in pairs.items()})
