"""Nelson-Siegel curve values, sample curves, percentile ranks, mean curves and curve fitting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvewalk.functions import clean, ratio
from curvewalk.operators.scan import UNPLACED, value_runs
from curvewalk.session import task_count
from curvewalk.sources.tables import materialize

# Tenor names and maturities in years.
TENORS = (
    ("DGS1MO", 0.083),
    ("DGS3MO", 0.25),
    ("DGS6MO", 0.5),
    ("DGS1", 1.0),
    ("DGS2", 2.0),
    ("DGS3", 3.0),
    ("DGS5", 5.0),
    ("DGS7", 7.0),
    ("DGS10", 10.0),
    ("DGS20", 20.0),
    ("DGS30", 30.0),
)
TENOR_NAMES = [name for name, _ in TENORS]
COEFFICIENTS = ["beta0", "beta1", "beta2", "lambda_"]


def tenors() -> Column:
    """The tenor dimension as an array literal, to explode without a join."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(name).alias("tenor"), F.lit(years).alias("maturity")
            )
            for i, (name, years) in enumerate(TENORS)
        ]
    )


def nelson_siegel(maturity: Column, beta0: Column, beta1: Column, beta2: Column, lam: Column) -> Column:
    scaled = lam * maturity
    decay = F.exp(-scaled)
    slope = ratio(1.0 - decay, scaled)
    return beta0 + beta1 * slope + beta2 * (slope - decay)


def yields_percent(prefix: str = "", suffix: str = "") -> list[Column]:
    """Eleven percent-yield columns from the four coefficient columns, matched by name."""
    betas = [F.col(f"{prefix}{c}") for c in COEFFICIENTS]
    return [
        (nelson_siegel(F.lit(years), *betas) * 100).alias(f"{name}{suffix}") for name, years in TENORS
    ]


def curve_points(df: DataFrame) -> DataFrame:
    """Long curves: one row per input row and tenor with ``yield_pct``."""
    kept = [c for c in df.columns if c not in COEFFICIENTS]
    return (
        df.withColumn("t", F.explode(tenors()))
        .select(
            *kept,
            F.col("t.ordinal").alias("ordinal"),
            F.col("t.tenor").alias("tenor"),
            (nelson_siegel(F.col("t.maturity"), *[F.col(c) for c in COEFFICIENTS]) * 100).alias("yield_pct"),
        )
    )


def percentile_ranks(df: DataFrame, group: list[str], value: str, max_group: int | None) -> DataFrame:
    """Average-tie percentile rank of ``value`` within ``group``.

    Rows whose value is NULL or NaN, or whose group is NULL, keep a NULL percentile and count for no
    other row. ``max_group`` says that the caller knows a bound on rows per group, such as the number
    of draws per date; then one window does it. With ``None`` the group may be any size and ranks come
    from a value scan. The result is the same.
    """
    ranked = clean(value)
    for name in group:
        ranked = F.when(F.col(name).isNotNull(), ranked)
    tagged = df.withColumn("_ranked", ranked)
    if max_group is not None:
        missing = F.col("_ranked").isNull()
        ordered = W.partitionBy(*group).orderBy(missing, "_ranked")
        # Frames of one and the same order share its sort.
        ties = F.count("_ranked").over(ordered.rangeBetween(W.currentRow, W.currentRow))
        whole = F.count("_ranked").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        place = ratio(F.rank().over(ordered) + (ties - 1) / 2, whole)
        return tagged.withColumn("percentile", F.when(~missing, place)).drop("_ranked")
    runs = value_runs(tagged.filter("_ranked is not null"), group, "_ranked").select(
        *group,
        "_ranked",
        ((F.col("n") + (F.col("n_here") + 1) / 2) / F.col("n_total")).alias("percentile"),
    )
    return tagged.join(runs, [*group, "_ranked"], "left").drop("_ranked").select(*df.columns, "percentile")


def sample_yields_wide(samples: DataFrame, group: list[str], max_group: int | None = 1000) -> DataFrame:
    """One row per draw: eleven yields and eleven ``_percentile`` columns, average-tie ranks among the draws of its group.

    ``max_group`` is the bound on draws per group that the caller knows; a group beyond it raises. The draws of a group
    are ranked at all tenors by one sort in one task, a row per draw goes in and comes out. With ``None`` groups may
    have any size and ranks come from value scans. A missing yield, or a group with a NULL in its key, has no percentile.
    """
    kept = [c for c in samples.columns if c not in COEFFICIENTS]
    if max_group is None:
        ids = F.monotonically_increasing_id().alias("_draw")
        long = percentile_ranks(curve_points(materialize(samples.select(ids, "*"), "draws")), [*group, "tenor"], "yield_pct", None)
        picked = []
        for name in TENOR_NAMES:
            here = F.when(F.col("tenor") == name, F.struct("yield_pct", "percentile"))
            picked.append(F.first(here, ignorenulls=True).alias(name))
        wide = long.groupBy("_draw", *kept).agg(*picked)
        both = [c for t in TENOR_NAMES for c in (F.col(f"{t}.yield_pct").alias(t), F.col(f"{t}.percentile").alias(f"{t}_percentile"))]
        return wide.select(*kept, *both)
    unplaced = F.expr(" or ".join(f"`{c}` is null" for c in group))
    salt = F.when(unplaced, 1 + F.pmod(F.xxhash64(*samples.columns), F.lit(UNPLACED))).otherwise(F.lit(0).cast("long"))
    rows = samples.select(*kept, *[F.col(c).cast("double").alias(c) for c in COEFFICIENTS], salt.alias("_salt"))
    names = [n for t in TENOR_NAMES for n in (t, f"{t}_percentile")]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{n}` double" for n in names])

    def rank(draws: pa.Table) -> pa.Table:
        placed = draws["_salt"][0].as_py() == 0
        if placed and draws.num_rows > max_group:
            raise ValueError(f"a group has {draws.num_rows} draws, more than max_group={max_group}")
        values = curve_values(*(draws[c].to_numpy() for c in COEFFICIENTS))
        ranks = average_ranks(values) if placed else np.full_like(values, np.nan)
        columns = [draws[c] for c in kept]
        for i in range(len(TENOR_NAMES)):
            columns += [pa.array(v[i], from_pandas=True) for v in (values, ranks)]
        return pa.table(columns, names=[*kept, *names])

    return rows.groupBy(*group, "_salt").applyInArrow(rank, schema)


def curve_values(beta0: np.ndarray, beta1: np.ndarray, beta2: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Percent yields, axes tenor, draw; NaN where a coefficient is missing or lambda is 0."""
    scaled = lam * np.array([[years] for _, years in TENORS])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        decay = np.exp(-scaled)
        slope = (1.0 - decay) / np.where(scaled == 0, np.nan, scaled)
        return (beta0 + beta1 * slope + beta2 * (slope - decay)) * 100


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Average-tie rank of each value in its row, as a share of the row's values; NaN has none and counts for none."""
    order = np.argsort(values, axis=1)  # NaN last
    ordered = np.take_along_axis(values, order, axis=1)
    place = np.broadcast_to(np.arange(values.shape[1]), values.shape)
    new = np.ones(values.shape, dtype=bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    end = np.ones(values.shape, dtype=bool)
    end[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(end, place, values.shape[1])[:, ::-1], axis=1)[:, ::-1]
    there = ~np.isnan(ordered)
    shares = np.where(there, ((first + last) / 2 + 1) / np.maximum(there.sum(axis=1, keepdims=True), 1), np.nan)
    out = np.empty_like(shares)
    np.put_along_axis(out, order, shares, axis=1)
    return out


def sample_yields(samples: DataFrame, group: list[str], max_group: int | None = 1000) -> DataFrame:
    """Every draw as a curve, one row per tenor, with its percentile among the draws of its group."""
    kept = [c for c in samples.columns if c not in COEFFICIENTS]
    if max_group is None:
        return percentile_ranks(curve_points(samples), [*group, "tenor"], "yield_pct", None)
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(t).alias("tenor"),
                F.col(t).alias("yield_pct"),
                F.col(f"{t}_percentile").alias("percentile"),
            )
            for i, t in enumerate(TENOR_NAMES)
        ]
    )
    return sample_yields_wide(samples, group, max_group).select(*kept, F.inline(points))


def mean_yields(samples: DataFrame, group: list[str]) -> DataFrame:
    """Mean curve per group: eleven averages straight from the coefficients, no fan-out."""
    betas = [F.col(c) for c in COEFFICIENTS]
    return samples.groupBy(*group).agg(
        *[F.avg(nelson_siegel(F.lit(years), *betas) * 100).alias(name) for name, years in TENORS]
    )


def point_yields(forecast: DataFrame, kept: list[str]) -> DataFrame:
    """``<tenor>_actual`` and ``<tenor>_prediction`` from wide coefficient forecasts."""
    return forecast.select(
        *kept, *yields_percent("actual_", "_actual"), *yields_percent("prediction_", "_prediction")
    )


def to_long_yields(wide: DataFrame, kept: list[str], name: str = "yield_pct") -> DataFrame:
    return wide.unpivot(kept, TENOR_NAMES, "tenor", name)


def compare_curves(observed: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Observed against mean predicted yields per date and tenor, with the error."""
    a = to_long_yields(observed, keys, "actual")
    p = to_long_yields(predicted, keys, "prediction")
    return a.join(p, [*keys, "tenor"]).withColumn("error", F.col("actual") - F.col("prediction"))


DIPS, CLOSE, GRID, FINER, ROOTS = 5, 3, 481, 64, 72
FIT = "beta0 double, beta1 double, beta2 double, lambda_ double"


def _loadings(scaled: np.ndarray) -> np.ndarray:
    """Columns (1, slope, curvature) of the curve for lambda times maturity; points are the axis before them."""
    slope = -np.expm1(-scaled) / scaled
    return np.stack([np.ones_like(scaled), slope, slope - np.exp(-scaled)], axis=-1)


def _weak(r: np.ndarray) -> np.ndarray:
    """Columns that hardly differ from those before them: their directions are rounding and reach nothing."""
    size = np.abs(np.diagonal(r, axis1=-2, axis2=-1))
    return size < 1e-12 * size.max(axis=-1, keepdims=True)


@lru_cache(maxsize=256)
def _across(lams: bytes, years: bytes) -> np.ndarray:
    """Directions that the loadings of each lambda don't reach, axes lambda, point, direction."""
    lam, at = np.frombuffer(lams), np.frombuffer(years)
    whole, r = np.linalg.qr(_loadings(lam[:, None] * at), mode="complete")
    whole[:, :, :3] *= _weak(r[:, :3])[:, None, :]
    return whole


def _misfits(lams: np.ndarray, years: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of squared residuals of the best betas, axes curve, lambda. The loadings of a lambda are factored once; what
    no betas reach is the part of a curve in the space across them, so residuals are one matrix product."""
    across = _across(lams.tobytes(), years.tobytes())
    out = np.empty((len(y), len(lams)))
    for at in range(0, len(y), 1024):
        parts = y[at : at + 1024] @ across.transpose(1, 0, 2).reshape(len(years), -1)
        out[at : at + 1024] = (parts.reshape(len(parts), len(lams), -1) ** 2).sum(axis=2)
    return out


def _left(scaled: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residuals, betas, orthonormal loadings) of each curve for its lambda times maturity."""
    q, r = np.linalg.qr(_loadings(scaled))
    weak = _weak(r)
    q = q * ~weak[:, None, :]
    reached = np.einsum("cpk,cp->ck", q, y)
    betas = np.linalg.solve(np.where(weak[:, :, None], np.eye(3), r), reached[:, :, None])[:, :, 0]
    return y - np.einsum("cpk,ck->cp", q, reached), betas, q


def _slope(log_lam: np.ndarray, years: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Half the derivative of each curve's residual by the logarithm of its lambda.

    The best betas' own change has no part in it. Where the curvature is small, the loadings' derivative lies nearly in
    their own space, and only what lies across keeps its digits.
    """
    scaled = np.exp(log_lam)[:, None] * years
    left, betas, q = _left(scaled, y)
    decay = np.exp(-scaled)
    bent = decay + np.expm1(-scaled) / scaled  # of the slope loading; the curvature's has scaled * decay more
    moved = betas[:, 1:2] * bent + betas[:, 2:3] * (bent + scaled * decay)
    across = moved - np.einsum("cpk,ck->cp", q, np.einsum("cpk,cp->ck", q, moved))
    return -(left * across).sum(axis=1)


def _bottoms(low: np.ndarray, high: np.ndarray, years: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the residuals' slopes vanish between the logarithms low and high: secants that give way at the end
    that stays (Illinois), halving every other step."""
    low, high, open_ = low.copy(), high.copy(), np.arange(len(low))
    at_low, at_high, kept = _slope(low, years, y), _slope(high, years, y), np.zeros(len(low), dtype=int)
    middle = (low + high) / 2
    for step in range(ROOTS):
        a, b, fa, fb = low[open_], high[open_], at_low[open_], at_high[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            secant = b - fb * (b - a) / (fb - fa)
        inside = np.isfinite(secant) & (secant > a) & (secant < b) & (step % 2 == 0)
        at = np.where(inside, secant, (a + b) / 2)
        here = _slope(at, years, y[open_])
        right = here > 0
        again = np.where(right, kept[open_] == 1, kept[open_] == -1)  # the same end moves twice in a row
        middle[open_], kept[open_] = at, np.where(right, 1, -1)
        high[open_], at_high[open_] = np.where(right, at, b), np.where(right, here, np.where(again, fb / 2, fb))
        low[open_], at_low[open_] = np.where(right, a, at), np.where(right, np.where(again, fa / 2, fa), here)
        open_ = open_[(high[open_] - low[open_] > 1e-12) & (here != 0)]
        if not len(open_):
            break
    return middle


def _dips(heights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the deepest local minima of each row."""
    around = np.pad(heights, ((0, 0), (1, 1)), constant_values=np.inf)
    dips = np.where((heights <= around[:, :-2]) & (heights <= around[:, 2:]), heights, np.inf)
    places = np.argsort(dips, axis=1)[:, :most]
    row, nth = np.nonzero(np.isfinite(np.take_along_axis(dips, places, axis=1)))
    return row, places[row, nth]


def _solve_alike(years: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lambda of each curve of the same maturities."""
    grid = np.linspace(np.log(1e-6), np.log(1e6), GRID)
    tried = _misfits(np.exp(grid), years, y)
    # The residual can have several dips; the deepest ones on the grid are all followed to their bottoms.
    curve, starts = _dips(tried, DIPS)
    parts = []
    for at in np.unique(starts):  # a finer grid, as two dips can be close
        mine = curve[starts == at]
        fine = np.linspace(grid[max(at - 2, 0)], grid[min(at + 2, GRID - 1)], FINER + 1)
        which, spot = _dips(_misfits(np.exp(fine), years, y[mine]), CLOSE)
        parts.append((mine[which], fine[np.maximum(spot - 1, 0)], fine[spot], fine[np.minimum(spot + 1, FINER)]))
    curve, low, least, high = (np.concatenate(x) for x in zip(*parts))
    # Where the slope's sign is rounding, the finer grid's best stays.
    found = np.concatenate([_bottoms(low, high, years, y[curve]), least])
    curve = np.concatenate([curve, curve])
    left, *_ = _left(np.exp(found)[:, None] * years, y[curve])
    order = np.lexsort(((left * left).sum(axis=1), curve))
    first = np.r_[True, curve[order][1:] != curve[order][:-1]]
    return np.exp(found[order[first]])


def solve_curves(years: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(betas, lambda) of each curve; axes curve, point; real marks points that aren't padding.

    The curve is linear in the betas once lambda is fixed. Lambda is looked for on a log grid over twelve decades, then
    where the residual's slope vanishes in the DIPS deepest dips. Curves of the same maturities share the factors.
    """
    lam = np.empty(len(y))
    designs, which = np.unique(np.column_stack([years, real]), axis=0, return_inverse=True)
    for i, design in enumerate(designs):
        mine, there = np.flatnonzero(which == i), design[years.shape[1] :] > 0
        lam[mine] = _solve_alike(design[: years.shape[1]][there], y[np.ix_(mine, there)])
    load = _loadings(lam[:, None] * years) * real[:, :, None]
    betas = np.einsum("ckp,cp->ck", np.linalg.pinv(load, rcond=1e-13), y)
    return betas, lam


def fit_curves(points: DataFrame, keys: list[str]) -> DataFrame:
    """Nelson-Siegel coefficients per curve from long ``(keys, maturity, y)`` rows, y a fraction.

    Points with a missing value or a maturity that isn't positive are left out. A curve with fewer than
    four different maturities left does not determine four coefficients: its key stays, with NULLs.
    One curve's points come together, a batch of curves is solved at once.
    """
    usable = clean("y").isNotNull() & (clean("maturity") > 0)
    point = F.when(usable, F.struct(F.col("maturity").cast("double").alias("maturity"), F.col("y").cast("double").alias("y")))
    points = points.repartition(task_count(points), *keys)  # few bytes, much work
    curves = points.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("points"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in curves.select(*keys).schema)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.full((len(batch), 4), np.nan)
            rows = [[(p["maturity"], p["y"]) for p in points] for points in batch["points"]]
            solvable = [i for i, r in enumerate(rows) if len({m for m, _ in r}) >= 4]
            if solvable:
                width = max(len(rows[i]) for i in solvable)
                years, y, real = np.ones((3, len(solvable), width))
                for at, i in enumerate(solvable):
                    n = len(rows[i])
                    years[at, :n], y[at, :n] = zip(*rows[i])
                    y[at, n:] = real[at, n:] = 0.0
                betas, lam = solve_curves(years, y, real)
                found[solvable] = np.column_stack([betas, lam])
            out = batch[keys].copy()
            for i, name in enumerate(COEFFICIENTS):
                out[name] = found[:, i]
            yield out

    fitted = curves.mapInPandas(solve, f"{kept}, {FIT}")
    return fitted.select(*keys, *[clean(c).alias(c) for c in COEFFICIENTS])
