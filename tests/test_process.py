from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewalk.operators import gaussian
from curvewalk.operators.candidates import BOUNDS, EXTRA_KERNELS, KERNELS, KernelGrid
from curvewalk.operators.folds import WalkForward
from curvewalk.plans.backtest import gaussian_backtest

ALL = [*KERNELS, *EXTRA_KERNELS]


def window(seed, n=35, p=3):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n + 4, p))
    y = np.column_stack([np.sin(x[:, 0]) + 0.1 * x[:, 1], np.cos(x[:, 0])]) + 0.1 * random.normal(size=(n + 4, 2))
    return x[:n], y[:n], x[n:]


def dense_kernel(kernel, a, b, p):
    if kernel == "RBF_ARD":
        lengths = np.array([p[f"length_{i}"] for i in range(a.shape[1])])
        return np.exp(-(((a / lengths)[:, None] - (b / lengths)[None]) ** 2).sum(-1) / 2)
    d2 = ((a[:, None] - b[None]) ** 2).sum(-1)
    rbf = lambda: np.exp(-d2 / (2 * p["length"] ** 2))
    wave = lambda: np.exp(-2 * (np.sin(np.pi * np.sqrt(d2) / p["period"]) / p["length"]) ** 2)
    return {
        "RBF": rbf,
        "ExpSineSquared": wave,
        "RationalQuadratic": lambda: (1 + d2 / (2 * p["mixture"] * p["length"] ** 2)) ** -p["mixture"],
        "Matern": lambda: (1 + np.sqrt(3 * d2) / p["length"]) * np.exp(-np.sqrt(3 * d2) / p["length"]),
        "Combined_RBF_ExpSine": lambda: rbf() * wave(),
        "DotProduct": lambda: p["length"] ** 2 + a @ b.T,
    }[kernel]()


def dense_evidence(kernel, x, y, p):
    full = p["constant"] * dense_kernel(kernel, x, x, p) + (p["noise"] + 1e-6) * np.eye(len(x))
    try:  # kernels of distances needn't be positive in several dimensions
        root = np.linalg.cholesky(full)
    except np.linalg.LinAlgError:
        return -np.inf
    volume = 2 * np.log(np.diag(root)).sum()
    return -0.5 * ((np.linalg.solve(root, y) ** 2).sum() + y.shape[1] * (volume + len(x) * np.log(2 * np.pi)))


def dense_optimum(kernel, x, y, names, seed):
    """Pattern search over all logarithms inside the bounds, from many starts."""
    random = np.random.default_rng(seed)
    low, high = np.log([BOUNDS[n.split("_")[0]] for n in names]).T
    height = lambda v: dense_evidence(kernel, x, y, dict(zip(names, np.exp(v))))
    best = -np.inf
    starts = random.uniform(low, high, (120, len(names)))
    for at in sorted(starts, key=height)[-6:]:
        here, step = height(at), 1.0
        while step > 1e-4:
            for i in range(len(names)):
                for sign in (step, -step):
                    there = np.clip(at + sign * np.eye(len(names))[i], low, high)
                    if (value := height(there)) > here:
                        at, here = there, value
                        break
                else:
                    continue
                break
            else:
                step /= 2
        best = max(best, here)
    return best


@pytest.mark.parametrize("kernel", ALL)
def test_gradient_equals_differences_of_the_dense_evidence(kernel):
    x, y, ahead = window(1)
    rows, grid = gaussian._Rows(x, y, ahead, None), KernelGrid()
    shape = {n: 0.7 + 0.2 * i for i, n in enumerate(rows.shapes(kernel, grid)[0])}
    height, slope, constant, noise, *_ = gaussian._profile(kernel, shape, rows, grid)
    scales = {"constant": constant, "noise": noise}
    assert np.isclose(height, dense_evidence(kernel, x, y, shape | scales), rtol=1e-7)
    for name, got in zip(shape, slope):
        up, down = (dense_evidence(kernel, x, y, shape | scales | {name: shape[name] * np.exp(d)}) for d in (1e-5, -1e-5))
        assert np.isclose(got, (up - down) / 2e-5, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("kernel", ALL)
@pytest.mark.parametrize("seed", [2, 5])
def test_search_reaches_a_dense_optimiser_inside_the_bounds(kernel, seed):
    x, y, ahead = window(seed)
    got = gaussian.fit_fold(x, y, ahead, kernel, None, KernelGrid())
    on_grid = gaussian.fit_fold(x, y, ahead, kernel, None, KernelGrid(restarts=0))
    params = got["params"]
    assert got["log_marginal_likelihood"] >= on_grid["log_marginal_likelihood"]
    assert np.isclose(got["log_marginal_likelihood"], dense_evidence(kernel, x, y, params), rtol=1e-6)
    want = dense_optimum(kernel, x, y, list(params), seed)
    assert got["log_marginal_likelihood"] >= want - 1e-4 * abs(want)
    for name, value in params.items():
        low, high = BOUNDS[name.split("_")[0]]
        assert low * (1 - 1e-9) <= value <= high * (1 + 1e-9)


def test_ascent_stops_at_the_box():
    centre = np.array([3.0, -1.0, 0.2])

    def value(v):
        return -((v - centre) ** 2 * [1, 10, 100]).sum(), -2 * (v - centre) * [1, 10, 100], v

    found = gaussian.climb(value, np.zeros(3), -np.ones(3), np.array([1.0, 1.0, 1.0]), least=1e-14)
    assert np.allclose(found[2], [1.0, -1.0, 0.2], atol=1e-5)


def test_a_planted_relevant_feature_ranks_first(spark):
    random = np.random.default_rng(4)
    frames = []
    for s, planted in (("a", 0), ("b", 2)):
        x = random.normal(size=(60, 3))
        pdf = pd.DataFrame(x, columns=["x0", "x1", "x2"])
        pdf["t0"], pdf["t1"] = np.sin(2 * x[:, planted]), np.cos(2 * x[:, planted])
        pdf["series_id"], pdf["pos"], pdf["pos_total"], pdf["date"] = s, range(60), 60, pd.date_range("2020-01-01", periods=60).date
        frames.append(pdf)
    panel = spark.createDataFrame(pd.concat(frames))
    features = ["x0", "x1", "x2"]
    run = gaussian_backtest(panel, WalkForward(45, 1, 10), features, ["t0", "t1"], kernels=("RBF_ARD",))
    found = run.importance().toPandas()
    for (s, _), part in found.groupby(["series_id", "fold"]):
        assert part.sort_values("importance").feature.iloc[-1] == {"a": "x0", "b": "x2"}[s]
        assert part.importance.sum() == pytest.approx(1) and part.importance.max() > 0.6
    alike = gaussian_backtest(panel, WalkForward(45, 1, 10), features, ["t0", "t1"], kernels=("RBF",)).importance()
    assert alike.filter(F.abs(F.col("importance") - 1 / 3) > 1e-12).count() == 0 and alike.count() == len(found)


def test_identities_hold_for_fits_and_show_what_is_off(spark):
    random = np.random.default_rng(9)
    pdf = pd.DataFrame(random.normal(size=(50, 3)), columns=["x0", "x1", "t0"])
    pdf["t0"] = np.sin(pdf.x0) + 0.1 * pdf.t0
    pdf["series_id"], pdf["pos"], pdf["pos_total"] = "a", range(50), 50
    panel, plan = spark.createDataFrame(pdf), WalkForward(30, 1, 10)
    fits = gaussian.fit_predict(panel, plan, ["x0", "x1"], ["t0"], ("RBF", "RBF_ARD", "DotProduct")).cache()
    gaps = ["residual", "evidence_gap", "mean_gap", "std_gap"]
    found = gaussian.identities(panel, plan, fits, ["x0", "x1"], ["t0"]).toPandas()
    assert len(found) == 6 and found.inside.all() and (found[gaps] < 1e-6).all().all()
    moved = fits.withColumn("log_marginal_likelihood", F.col("log_marginal_likelihood") + 1)
    moved = moved.withColumn("params", F.map_concat(F.map_filter("params", lambda k, v: k != "noise"), F.create_map(F.lit("noise"), F.lit(1e9))))
    off = gaussian.identities(panel, plan, moved, ["x0", "x1"], ["t0"]).toPandas()
    assert not off.inside.any() and (off.evidence_gap > 1e-6).all() and (off.std_gap > 1).all()
