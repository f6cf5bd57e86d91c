"""Gaussian-process candidates, one bounded group of neighbouring folds per task.

A group holds ``per_group * stride + window`` rows by construction, whatever the size of the series.
Each fold is fitted exactly by one eigen-decomposition per kernel shape: the constant and noise factors
only rescale eigenvalues, so the best ones for a shape cost no extra matrix work. Shapes are searched from the best
of a grid by projected quasi-Newton steps along the gradient of the evidence. With ``inducing`` given, the process is
the low-rank one on that many evenly spaced rows, at the grid's values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewalk.operators.candidates import (
    BOUNDS,
    EXTRA_KERNELS,
    KERNELS,
    NUGGET,
    RELEVANCE_KERNEL,
    KernelGrid,
    check_candidates,
)
from curvewalk.operators.folds import WalkForward, fold_groups, only_folds, training_rows
from curvewalk.operators.panel import KEY
from curvewalk.operators.ridge import bounds, folds_per_group
from curvewalk.session import task_count

FIT_SCHEMA = (
    "series_id string, fold bigint, family string, candidate string, ordinal int, n_train bigint, "
    "params map<string,double>, log_marginal_likelihood double, cosine_similarity double, "
    "euclidean_rmse double, r2_avg double, r2_flat double, "
    "predictions array<struct<pos: bigint, mean: array<double>, std: double>>"
)
FIT_COLUMNS = [
    "series_id", "fold", "family", "candidate", "ordinal", "n_train", "params", "log_marginal_likelihood",
    "cosine_similarity", "euclidean_rmse", "r2_avg", "r2_flat", "predictions",
]
LOG_2PI = float(np.log(2 * np.pi))


def inducing_positions(window: int, inducing: int) -> list[int]:
    """Evenly spaced row offsets inside a training window."""
    count = min(window, inducing)
    return [i * window // count for i in range(count)]


def kernel_rows(panel: DataFrame, plan: WalkForward, features: list[str], inducing: int) -> DataFrame:
    """Training rows beside their fold's inducing rows: ``squared`` distances per (row, inducing).

    Each row meets a fixed number of inducing rows, so output grows with the rows alone.
    """
    offsets = inducing_positions(plan.window, inducing)
    rows = training_rows(panel.select(*KEY, "pos", "pos_total", *features), plan)
    rows = rows.withColumn("offset", F.col("pos") - plan.fit_start(F.col("fold")))
    point = F.array(*features)
    centres = (
        rows.filter(F.col("offset").isin(offsets))
        .groupBy(*KEY, "fold")
        .agg(F.array_sort(F.collect_list(F.struct("offset", point.alias("x")))).alias("centres"))
    )
    apart = F.aggregate(
        F.zip_with(point, F.col("centre.x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )
    return (
        rows.join(centres, [*KEY, "fold"])
        .withColumn("centre", F.explode("centres"))
        .select(*KEY, "fold", "pos", "offset", F.col("centre.offset").alias("inducing_offset"), apart.alias("squared"))
    )


def _kernel(kernel: str, shape: dict[str, float]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Kernel of (squared distances, inner products)."""
    length = shape.get("length", 1.0)
    rbf = lambda d2, ip: np.exp(-d2 / (2 * length**2))

    def wave(d2, ip):
        return np.exp(-2 * (np.sin(np.pi * np.sqrt(d2) / shape["period"]) / length) ** 2)

    return {
        "RBF": rbf,
        "ExpSineSquared": wave,
        "RationalQuadratic": lambda d2, ip: (1 + d2 / (2 * shape["mixture"] * length**2)) ** -shape["mixture"],
        "Matern": lambda d2, ip: (1 + np.sqrt(3 * d2) / length) * np.exp(-np.sqrt(3 * d2) / length),
        "Combined_RBF_ExpSine": lambda d2, ip: rbf(d2, ip) * wave(d2, ip),
        "DotProduct": lambda d2, ip: length**2 + ip,
        "RBF_ARD": lambda d2, ip: np.exp(-d2 / 2),  # of rows divided by their lengths
    }[kernel]


def _slopes(kernel: str, shape: dict[str, float], d2: np.ndarray, k: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the kernel matrix by the logarithms of its shape's values; of RBF_ARD see ``_Rows``."""
    length = shape.get("length", 1.0)
    if kernel == "DotProduct":
        return {"length": np.full_like(k, 2 * length**2)}
    if kernel == "Matern":
        r = np.sqrt(3 * d2) / length
        return {"length": r * r * np.exp(-r)}
    if kernel == "RationalQuadratic":
        a = shape["mixture"]
        part = d2 / (2 * a * length**2)
        return {"length": k * 2 * a * part / (1 + part), "mixture": k * a * (part / (1 + part) - np.log1p(part))}
    found = {"length": np.zeros_like(k)}
    if kernel in ("RBF", "Combined_RBF_ExpSine"):
        found["length"] += k * d2 / length**2
    if kernel in ("ExpSineSquared", "Combined_RBF_ExpSine"):
        angle = np.pi * np.sqrt(d2) / shape["period"]
        found["length"] += k * 4 * np.sin(angle) ** 2 / length**2
        found["period"] = k * 4 * np.sin(angle) * np.cos(angle) * angle / length**2
    return found


def kernel_values(kernel: str, squared: Column, **shape: float) -> Column:
    """Kernel value as a column of squared distances, by the same code as the fits."""

    @F.pandas_udf("double")
    def value(gaps: pd.Series) -> pd.Series:
        return pd.Series(_kernel(kernel, shape)(gaps.to_numpy(float), np.zeros(len(gaps))))

    return value(squared)


def _products(a: np.ndarray, b: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and inner products; distances of centred rows keep their digits at any level."""
    u, v = a - centre, b - centre
    gap = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * u @ v.T
    return np.clip(gap, 0.0, None), a @ b.T


def _scores(y: np.ndarray, f: np.ndarray) -> dict[str, float]:
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = (y * f).sum(1) / (np.linalg.norm(y, axis=1) * np.linalg.norm(f, axis=1))
        sse = ((y - f) ** 2).sum(0)
        spread = np.where(np.ptp(y, axis=0) > 0, ((y - y.mean(0)) ** 2).sum(0), 0.0)  # a mean may round
        found = {
            "cosine_similarity": cosine.mean(),
            "euclidean_rmse": np.sqrt(sse.sum() / len(y)),
            "r2_avg": (1 - sse / spread).mean(),
            "r2_flat": 1 - sse.sum() / ((y - y.mean()) ** 2).sum(),
        }
    return {k: float(v) if np.isfinite(v) else None for k, v in found.items()}


class _Rows:
    """Training rows of a fold, the rows to forecast, and the rows that the kernel features come from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ahead: np.ndarray, inducing: int | None):
        self.x, self.y, self.ahead, self.exact = x, y, ahead, inducing is None
        self.z = x if self.exact else x[inducing_positions(len(x), inducing)]
        self.centre, self.yy = x.mean(0), float((y * y).sum())
        self.near = self._apart(None)

    def _apart(self, lengths: np.ndarray | None) -> tuple:
        """Squared distances and inner products: among features' rows, to training rows, to rows ahead, of those to themselves."""
        x, z, ahead, centre = self.x, self.z, self.ahead, self.centre
        if lengths is not None:
            x, z, ahead, centre = x / lengths, z / lengths, ahead / lengths, centre / lengths
        zz = _products(z, z, centre)
        own = (np.zeros(len(ahead)), (ahead * ahead).sum(1))
        return zz, (zz if self.exact else _products(x, z, centre)), _products(ahead, z, centre), own

    def apart(self, shape: dict[str, float]) -> tuple:
        return self._apart(np.array([shape[n] for n in shape])) if "length_0" in shape else self.near

    def shapes(self, kernel: str, grid: KernelGrid) -> list[dict[str, float]]:
        """The grid's shapes; one length for each feature begins with equal ones."""
        if kernel != RELEVANCE_KERNEL:
            return grid.shapes(kernel)
        return [{f"length_{i}": s["length"] for i in range(self.x.shape[1])} for s in grid.shapes(kernel)]

    def slopes(self, kernel: str, shape: dict[str, float], k: np.ndarray):
        """Name and derivative of each of the shape's values, one at a time."""
        if kernel != RELEVANCE_KERNEL:
            yield from _slopes(kernel, shape, self.near[0][0], k).items()
            return
        for i, name in enumerate(shape):
            u = (self.x[:, i] - self.centre[i]) / shape[name]
            yield name, k * (u[:, None] - u[None]) ** 2


class _Exact:
    """The process on all training rows for one shape: eigenvalues of its kernel matrix and turned targets.

    A kernel of distances needn't be positive in many dimensions; scales at which the whole matrix isn't are ruled out.
    """

    def __init__(self, kernel: str, shape: dict[str, float], rows: _Rows):
        self.kernel, (apart, _, self.ahead, self.own) = _kernel(kernel, shape), rows.apart(shape)
        self.matrix = self.kernel(*apart)
        self.values, self.vectors = np.linalg.eigh(self.matrix)
        self.turned = self.vectors.T @ rows.y
        self.power, self.targets = (self.turned * self.turned).sum(1), rows.y.shape[1]

    def heights(self, constants: np.ndarray, noises: np.ndarray) -> np.ndarray:
        """Evidence at each constant and noise; they only rescale eigenvalues."""
        scales = constants[:, None, None] * self.values + (noises + NUGGET)[None, :, None]
        sound = (scales > 0).all(-1)
        scales = np.where(sound[..., None], scales, 1.0)
        found = -0.5 * ((self.power / scales).sum(-1) + self.targets * (np.log(scales).sum(-1) + len(self.values) * LOG_2PI))
        return np.where(sound, found, -np.inf)

    def height(self, x: np.ndarray) -> tuple:
        """(evidence, its gradient, constant, noise) at the logarithms of both scales."""
        constant, noise = np.exp(x)
        a = constant * self.values + noise + NUGGET
        if a[0] <= 0:
            return -np.inf, np.zeros(2), constant, noise
        pushed = self.power / a**2 - self.targets / a
        found = -0.5 * ((self.power / a).sum() + self.targets * (np.log(a).sum() + len(a) * LOG_2PI))
        return found, 0.5 * np.array([constant * (self.values * pushed).sum(), noise * pushed.sum()]), constant, noise

    def predict(self, constant: float, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fitted training targets, means ahead, variances ahead)."""
        weights = self.turned / (a := constant * self.values + noise + NUGGET)[:, None]
        ahead = constant * self.kernel(*self.ahead) @ self.vectors
        variance = constant * self.kernel(*self.own) - (ahead**2 / a).sum(1) + noise
        return self.vectors @ (constant * self.values[:, None] * weights), ahead @ weights, variance.clip(0.0)


class _LowRank:
    """The process on inducing rows for one shape."""

    def __init__(self, kernel: str, shape: dict[str, float], rows: _Rows):
        self.kernel, (zz, xz, self.ahead, self.own) = _kernel(kernel, shape), rows.apart(shape)
        values, vectors = np.linalg.eigh(self.kernel(*zz))
        kept = values > max(1e-12 * values[-1], 1e-300)
        self.root = vectors[:, kept] / np.sqrt(values[kept])  # features are kernel values with the inducing rows times this
        phi = self.kernel(*xz) @ self.root
        stretch, self.turn = np.linalg.eigh(phi.T @ phi)
        self.values, self.train = np.clip(stretch, 0.0, None), phi @ self.turn
        self.pull, self.yy, (self.n, self.targets) = self.train.T @ rows.y, rows.yy, rows.y.shape

    def heights(self, constants: np.ndarray, noises: np.ndarray) -> np.ndarray:
        power = (self.pull * self.pull).sum(1)
        scales = constants[:, None, None] * self.values + (noises + NUGGET)[None, :, None]
        misfit = (self.yy - constants[:, None] * (power / scales).sum(-1)) / (noises + NUGGET)
        volume = np.log(scales).sum(-1) + (self.n - len(self.values)) * np.log(noises + NUGGET) + self.n * LOG_2PI
        return -0.5 * (misfit + self.targets * volume)

    def predict(self, constant: float, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = constant * self.values + noise + NUGGET
        weights = constant * self.pull / a[:, None]
        ahead = self.kernel(*self.ahead) @ self.root
        turned = ahead @ self.turn
        left = constant * (self.kernel(*self.own) - (ahead**2).sum(1)).clip(0.0)
        return self.train @ weights, turned @ weights, left + (noise + NUGGET) * constant * (turned**2 / a).sum(1) + noise


def climb(
    value: Callable[[np.ndarray], tuple], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 30, least: float = 1e-7
) -> tuple:
    """Projected quasi-Newton ascent inside a box. ``value(x)`` starts with (height, gradient); returns its best result.

    Coordinates held by the box are left out of a step; curvature is learned from the gradients (BFGS), steps are
    shortened until they gain enough, and the ascent ends when a step gains less than least of the height.
    """
    x = np.clip(start, low, high)
    found, shape = value(x), np.eye(len(x))
    for _ in range(steps):
        height, slope = found[0], found[1]
        free = ~(((x <= low) & (slope < 0)) | ((x >= high) & (slope > 0)))
        if not free.any():
            break
        step = np.zeros(len(x))
        step[free] = shape[np.ix_(free, free)] @ slope[free]
        if step @ slope <= 0:
            shape, step = np.eye(len(x)), np.where(free, slope, 0.0)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        for _ in range(12):
            there = np.clip(x + step, low, high)
            tried = value(there)
            if np.isfinite(tried[0]) and tried[0] >= height + 1e-4 * slope @ (there - x) and tried[0] > height:
                break
            step = step / 2
        else:
            break
        moved, bent = there - x, slope - tried[1]
        if moved @ bent > 1e-12:
            rho, one = 1.0 / (moved @ bent), np.eye(len(x))
            left = one - rho * np.outer(moved, bent)
            shape = left @ shape @ left.T + rho * np.outer(moved, moved)
        x, found = there, tried
        if found[0] - height < least * max(1.0, abs(height)):
            break
    return found


def _box(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.log([BOUNDS[n.split("_")[0]] for n in names])
    return bounds[:, 0], bounds[:, 1]


def _profile(kernel: str, shape: dict[str, float], rows: _Rows, grid: KernelGrid) -> tuple:
    """(evidence, gradient by log shape, constant, noise, shape, process) at the shape's best scales.

    At those the evidence doesn't change with the scales, so its gradient is the one at fixed scales.
    """
    process = _Exact(kernel, shape, rows)
    height, constant, noise = _on_grid(process, grid)
    if not np.isfinite(height):
        return -np.inf, np.zeros(len(shape)), constant, noise, shape, process
    start = np.log([constant, noise])
    height, _, constant, noise = climb(process.height, start, *_box(["constant", "noise"]), least=1e-12)
    a, vectors = constant * process.values + noise + NUGGET, process.vectors
    alpha = vectors @ (process.turned / a[:, None])
    weights = 0.5 * constant * (alpha @ alpha.T - process.targets * (vectors / a) @ vectors.T)
    slope = np.array([(weights * d).sum() for _, d in rows.slopes(kernel, shape, process.matrix)])
    return height, slope, constant, noise, shape, process


def _on_grid(process: _Exact | _LowRank, grid: KernelGrid) -> tuple[float, float, float]:
    """(evidence, constant, noise) of the best scales of the grid."""
    constants, noises = np.array(grid.constant), np.array(grid.noise)
    heights = process.heights(constants, noises)
    c, s = np.unravel_index(np.argmax(heights), heights.shape)
    return float(heights[c, s]), float(constants[c]), float(noises[s])


def _search(kernel: str, rows: _Rows, grid: KernelGrid) -> tuple:
    """(evidence, constant, noise, shape, process) of the grid's best shape, or of a better one reached from its best few."""
    tried = []
    for shape in rows.shapes(kernel, grid):
        process = (_Exact if rows.exact else _LowRank)(kernel, shape, rows)
        tried.append((*_on_grid(process, grid), shape, process))
    tried.sort(key=lambda t: -t[0])
    best = tried[0]
    if not (rows.exact and grid.restarts):
        return best
    names = list(best[3])
    for start in [t[3] for t in tried[: grid.restarts]]:
        found = climb(
            lambda x: _profile(kernel, dict(zip(names, np.exp(x).tolist())), rows, grid),
            np.log([start[name] for name in names]),
            *_box(names),
        )
        if found[0] > best[0]:
            best = found[0], *found[2:]
    return best


def fit_fold(
    x: np.ndarray, y: np.ndarray, ahead: np.ndarray, kernel: str, inducing: int | None, grid: KernelGrid
) -> dict:
    """Best (shape, constant, noise) of one kernel by evidence, its scores and its predictions.

    Without inducing the process is exact and the evidence is never below the grid's. A fold's result depends on its own
    rows alone.
    """
    rows = _Rows(x, y, ahead, inducing)
    evidence, constant, noise, shape, process = _search(kernel, rows, grid)
    fitted, mean, variance = process.predict(constant, noise)
    return {
        "params": {**shape, "constant": constant, "noise": noise},
        "log_marginal_likelihood": float(evidence) if np.isfinite(evidence) else None,
        **_scores(y, fitted),
        "mean": mean,
        "std": np.sqrt(variance),
    }


def _folds(group: pd.DataFrame, plan: WalkForward, per_group: int, features: list[str], targets: list[str], standardize: bool):
    """(fold, training x, training y, x ahead, positions ahead) of each of a group's folds, rows sorted by position."""
    folds, lows, highs = bounds(group, plan, per_group)
    pos, start = group["pos"].to_numpy(), int(group["_start"].iloc[0])
    x, y = group[features].to_numpy(float), group[targets].to_numpy(float)
    for fold, low, high in zip(folds, lows, highs):
        at = start + fold * plan.stride
        ahead = (pos >= at) & (pos < at + plan.stride) & ((pos - start) % plan.step == 0)
        xt, xa = x[low:high], x[ahead]
        if standardize:
            centre, scale = xt.mean(0), xt.std(0)
            scale[scale == 0] = 1.0
            xt, xa = (xt - centre) / scale, (xa - centre) / scale
        yield fold, xt, y[low:high], xa, pos[ahead]


def fit_predict(
    panel: DataFrame,
    plan: WalkForward,
    features: list[str],
    targets: list[str],
    kernels: tuple[str, ...] = KERNELS,
    grid: KernelGrid | None = None,
    inducing: int | None = None,
    standardize: bool = False,
    per_group: int | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """One row per (series, fold, kernel) with scores and the fold's own predictions.

    The process is exact unless a number of inducing rows is given. A task holds window / stride folds by
    default, so a row is copied about twice. Fit and forecast happen in the task that holds the window, so no fitted
    matrix is shuffled. ``only`` (series_id, fold) names the folds wanted, if not all are.
    """
    check_candidates(kernels, [*KERNELS, *EXTRA_KERNELS])
    grid = grid or KernelGrid()
    per_group = per_group or folds_per_group(plan)
    rows = fold_groups(panel.select(*KEY, "pos", "pos_total", *dict.fromkeys([*features, *targets])), plan, per_group)
    rows = only_folds(rows, plan, per_group, only)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        made = []
        for fold, x, y, ahead, places in _folds(group, plan, per_group, features, targets, standardize):
            for ordinal, kernel in enumerate(kernels):
                got = fit_fold(x, y, ahead, kernel, inducing, grid)
                mean, std = got.pop("mean"), got.pop("std")
                points = [{"pos": int(q), "mean": m.tolist(), "std": float(s)} for q, m, s in zip(places, mean, std)]
                made.append(
                    {
                        "series_id": group["series_id"].iloc[0],
                        "fold": fold,
                        "family": "gaussian",
                        "candidate": kernel,
                        "ordinal": ordinal,
                        "n_train": len(x),
                        **got,
                        "params": {k: float(v) for k, v in got["params"].items()},
                        "predictions": points,
                    }
                )
        return pd.DataFrame(made, columns=FIT_COLUMNS)

    keys = [*KEY, "fold_group"]
    return rows.repartition(task_count(rows), *keys).groupBy(*keys).applyInPandas(fit, FIT_SCHEMA)


def predict_stored(
    panel: DataFrame,
    plan: WalkForward,
    fits: DataFrame,
    features: list[str],
    targets: list[str],
    inducing: int | None = None,
    standardize: bool = False,
) -> DataFrame:
    """Predictions of fitted processes (series_id, fold, candidate, params) for all rows of their folds, without a search.

    The rows of a fold and its fits come together by group of neighbouring folds; one factorisation a fit.
    """
    per_group = folds_per_group(plan)
    rows = fold_groups(panel.select(*KEY, "pos", "pos_total", *dict.fromkeys([*features, *targets])), plan, per_group)
    rows = only_folds(rows, plan, per_group, fits.select(*KEY, "fold").distinct())
    slim = fits.select(*KEY, F.expr(f"fold div {per_group}").alias("fold_group"), "fold", "candidate", "params")
    columns = ["series_id", "fold", "candidate", "pos", *[f"prediction_{t}" for t in targets], *[f"std_{t}" for t in targets]]

    def run(group: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(group) and len(fitted):
            by_fold = dict(list(fitted.groupby("fold")))
            for fold, x, y, ahead, places in _folds(group.sort_values("pos"), plan, per_group, features, targets, standardize):
                for fit in by_fold[fold].itertuples() if fold in by_fold else ():
                    params = dict(fit.params)
                    constant, noise = params.pop("constant"), params.pop("noise")
                    shape = {n: params[n] for n in sorted(params, key=lambda n: (n.split("_")[0], int((n + "_0").split("_")[1])))}
                    process = (_Exact if inducing is None else _LowRank)(fit.candidate, shape, _Rows(x, y, ahead, inducing))
                    _, mean, variance = process.predict(constant, noise)
                    std = np.sqrt(variance)
                    made += [(fit.series_id, fold, fit.candidate, int(q), *m, *[s] * len(targets)) for q, m, s in zip(places, mean, std)]
        return pd.DataFrame(made, columns=columns)

    schema = "series_id string, fold bigint, candidate string, pos bigint, " + ", ".join(f"`{c}` double" for c in columns[4:])
    keys, tasks = [*KEY, "fold_group"], task_count(rows)
    left, right = (df.repartition(tasks, *keys).groupBy(*keys) for df in (rows, slim))
    return left.cogroup(right).applyInPandas(run, schema)


def identities(panel: DataFrame, plan: WalkForward, fits: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """How far the results of ``fit_predict`` are from what their hyper-parameters imply, by a plain solve of each window.

    One row per (series, fold, candidate) of an exact process: the largest residual of (K + noise) weights = targets, the
    relative gap of the evidence, the largest gaps of means and deviations ahead, and whether all values lie in BOUNDS.
    """
    per_group = folds_per_group(plan)
    rows = fold_groups(panel.select(*KEY, "pos", "pos_total", *dict.fromkeys([*features, *targets])), plan, per_group)
    rows = only_folds(rows, plan, per_group, None)
    slim = fits.select(
        *KEY, F.expr(f"fold div {per_group}").alias("fold_group"), "fold", "candidate", "params", "log_marginal_likelihood", "predictions"
    )
    columns = ["series_id", "fold", "candidate", "residual", "evidence_gap", "mean_gap", "std_gap", "inside"]

    def check(x: np.ndarray, y: np.ndarray, ahead: np.ndarray, fit) -> tuple:
        params = dict(fit.params)
        lengths = np.array([params[f"length_{i}"] for i in range(x.shape[1])]) if "length_0" in params else np.ones(x.shape[1])
        k = _kernel(fit.candidate, params)

        def matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            u, v = (a - x.mean(0)) / lengths, (b - x.mean(0)) / lengths
            return params["constant"] * k(((u[:, None] - v[None]) ** 2).sum(-1), a @ b.T)

        whole = matrix(x, x) + (params["noise"] + NUGGET) * np.eye(len(x))
        root = np.linalg.cholesky(whole)
        weights = np.linalg.solve(whole, y)
        evidence = -0.5 * ((y * weights).sum() + y.shape[1] * (2 * np.log(np.diag(root)).sum() + len(x) * LOG_2PI))
        cross = matrix(ahead, x)
        own = np.array([matrix(q[None], q[None])[0, 0] for q in ahead])
        variance = own - (np.linalg.solve(root, cross.T) ** 2).sum(0) + params["noise"]
        mean, std = np.array([list(p["mean"]) for p in fit.predictions]), np.array([p["std"] for p in fit.predictions])
        inside = all(BOUNDS[n.split("_")[0]][0] * (1 - 1e-9) <= v <= BOUNDS[n.split("_")[0]][1] * (1 + 1e-9) for n, v in params.items())
        return (
            np.abs(whole @ weights - y).max(), abs(evidence - fit.log_marginal_likelihood) / max(1.0, abs(evidence)),
            np.abs(cross @ weights - mean).max(), np.abs(np.sqrt(variance.clip(0.0)) - std).max(), inside,
        )

    def run(group: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(group) and len(fitted):
            by_fold = dict(list(fitted.groupby("fold")))
            for fold, x, y, ahead, _ in _folds(group.sort_values("pos"), plan, per_group, features, targets, False):
                for fit in by_fold[fold].itertuples() if fold in by_fold else ():
                    made.append((fit.series_id, fold, fit.candidate, *check(x, y, ahead, fit)))
        return pd.DataFrame(made, columns=columns)

    schema = "series_id string, fold bigint, candidate string, residual double, evidence_gap double, mean_gap double, std_gap double, inside boolean"
    keys, tasks = [*KEY, "fold_group"], task_count(rows)
    left, right = (df.repartition(tasks, *keys).groupBy(*keys) for df in (rows, slim))
    return left.cogroup(right).applyInPandas(run, schema)


def predictions(fits: DataFrame, targets: list[str]) -> DataFrame:
    """Fitted rows opened up to one row per forecast position."""
    return fits.select(*KEY, "fold", "candidate", F.inline("predictions")).select(
        *KEY,
        "fold",
        "candidate",
        "pos",
        *[F.col("mean")[j].alias(f"prediction_{t}") for j, t in enumerate(targets)],
        *[F.col("std").alias(f"std_{t}") for t in targets],
    )


def process_importance(fits: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Importance of each feature by its inverse length, summing to 1; equal where a kernel has one length for all."""
    names = F.array(*[F.lit(f) for f in features])
    lengths = F.transform(F.array(*[F.lit(f"length_{i}") for i in range(len(features))]), lambda n: F.col("params")[n])
    own = F.transform(lengths, lambda v: 1.0 / (v + 1e-10))
    whole = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
    share = F.when(F.col("params")["length_0"].isNull(), F.transform(names, lambda _: F.lit(1.0 / len(features))))
    share = share.otherwise(F.transform(own, lambda v: v / whole))
    pairs = F.arrays_zip(names.alias("feature"), share.alias("importance"))
    return fits.select(*keys, F.inline(pairs).alias("feature", "importance"))
