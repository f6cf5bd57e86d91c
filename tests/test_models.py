from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewalk.operators import gaussian, ridge
from curvewalk.operators.candidates import KernelGrid, PRIORS
from curvewalk.operators.folds import WalkForward, training_rows
from curvewalk.operators.scores import best_candidates, score_rows
from curvewalk.plans.backtest import gaussian_backtest, ridge_backtest

FEATURES, TARGETS = ["x0", "x1", "x2"], ["t0", "t1"]


def panel_pdf(n=70, seed=3):
    rng = np.random.default_rng(seed)
    frames = []
    for s in ("a", "b"):
        x = rng.normal(size=(n, 3)).cumsum(0) / 5
        pdf = pd.DataFrame(x, columns=FEATURES)
        pdf["t0"] = 1 + x @ [0.5, -1.0, 0.2] + rng.normal(size=n) * 0.1
        pdf["t1"] = np.sin(x[:, 0]) + rng.normal(size=n) * 0.05
        pdf["series_id"], pdf["pos"], pdf["pos_total"] = s, range(n), n
        pdf["date"] = pd.date_range("2020-01-01", periods=n).date
        frames.append(pdf)
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def pdf():
    return panel_pdf()


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return spark.createDataFrame(pdf).cache()


def evidence_loop(x, y, prior):
    """One target, straight from the rows."""
    xc, yc = x - x.mean(0), y - y.mean()
    n, p = x.shape
    a, l, before = 1 / (y.var() + np.finfo(float).eps), 1.0, None

    def solve():
        return np.linalg.solve(xc.T @ xc + l / a * np.eye(p), xc.T @ yc)

    d = np.linalg.eigvalsh(xc.T @ xc)
    for _ in range(300):
        w = solve()
        sse = ((yc - xc @ w) ** 2).sum()
        gamma = (a * d / (l + a * d)).sum()
        l = (gamma + 2 * prior) / ((w**2).sum() + 2 * prior)
        a = (n - gamma + 2 * prior) / (sse + 2 * prior)
        if before is not None and np.abs(w - before).sum() < 1e-3:
            break
        before = w
    w = solve()
    cov = np.linalg.inv(a * xc.T @ xc + l * np.eye(p))
    return w, y.mean() - x.mean(0) @ w, a, cov


@pytest.mark.parametrize("plan", [WalkForward(30, 1, 10), WalkForward(25, 1, 10, embargo=2), WalkForward(20, 1, 6, step=2)])
def test_ridge_equals_the_loop_on_raw_rows(spark, panel, pdf, plan):
    run = ridge_backtest(panel, plan, FEATURES, TARGETS, store=False)
    fits = ridge.evidence_ridge(ridge.fold_grams(panel, plan, FEATURES, TARGETS), 3, 2).toPandas()
    train = training_rows(panel, plan).toPandas()
    scores = run.scores.toPandas().set_index(["series_id", "fold", "candidate"])
    assert len(fits) == train.groupby(["series_id", "fold"]).ngroups * len(PRIORS)
    for r in fits.itertuples():
        rows = train[(train.series_id == r.series_id) & (train.fold == r.fold)]
        assert len(rows) == plan.window == r.n_train
        x, y = rows[FEATURES].to_numpy(), rows[TARGETS].to_numpy()
        guess = []
        for j in range(2):
            w, b, a, _ = evidence_loop(x, y[:, j], PRIORS[r.candidate])
            assert np.allclose(r.coef[j], w, atol=1e-6)
            assert np.isclose(r.intercept[j], b, atol=1e-6) and np.isclose(r.noise[j], 1 / a, rtol=1e-5)
            guess.append(x @ w + b)
        f = np.array(guess).T
        cosine = ((y * f).sum(1) / np.linalg.norm(y, axis=1) / np.linalg.norm(f, axis=1)).mean()
        assert np.isclose(scores.loc[(r.series_id, r.fold, r.candidate), "cosine_similarity"], cosine)
    best = scores.reset_index().sort_values("cosine_similarity").groupby(["series_id", "fold"]).tail(1)
    chosen = best.set_index(["series_id", "fold"])["candidate"]
    for r in run.forecasts.toPandas().itertuples():
        assert chosen[(r.series_id, r.fold)] == r.candidate
        rows = train[(train.series_id == r.series_id) & (train.fold == r.fold)]
        x = rows[FEATURES].to_numpy()
        here = pdf[(pdf.series_id == r.series_id) & (pdf.pos == r.pos)][FEATURES].to_numpy()[0]
        w, b, a, cov = evidence_loop(x, rows["t0"].to_numpy(), PRIORS[r.candidate])
        away = here - x.mean(0)
        assert np.isclose(r.prediction_t0, here @ w + b, atol=1e-6)
        assert np.isclose(r.std_t0, np.sqrt(away @ cov @ away + 1 / a), rtol=1e-5)


@pytest.mark.parametrize(("window", "stride"), [(30, 10), (29, 10), (25, 3), (7, 7), (5, 9), (20, 1)])
def test_sliding_sums_equal_each_window_and_take_a_row_up_once(window, stride, monkeypatch):
    rng = np.random.default_rng(window)
    per_group = max(1, window // stride)
    z = np.column_stack([np.ones(window + per_group * stride), 1e8 + rng.normal(size=(window + per_group * stride, 3))])
    ends = window + stride * np.arange(per_group)
    got = list(ridge._sliding(z, ends - window, ends))
    assert len(got) == per_group
    for g, end in zip(got, ends):
        part = z[end - window : end]
        assert np.allclose(g, part.T @ part, rtol=1e-12)

    taken = []

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            taken.append(rows)
            return np.asarray(super().__getitem__(rows))

    list(ridge._sliding(z.view(Counted), ends - window, ends))
    rows = [i for part in taken[::2] for i in range(*part.indices(len(z)))]  # each product names its rows twice
    assert len(rows) == len(set(rows)) <= window + per_group * stride


@pytest.mark.parametrize("level", [0.0, 1e8])
def test_scores_from_sums_equal_scores_from_rows(spark, pdf, level):
    moved = pdf.copy()
    moved[[*FEATURES, *TARGETS]] += level
    panel = spark.createDataFrame(moved)
    plan = WalkForward(30, 1, 10)
    fits = ridge.fixed_ridge(ridge.fold_grams(panel, plan, FEATURES, TARGETS), {"a": 1e-3, "b": 0.5}, 3, 2).cache()
    keys = ["series_id", "fold", "candidate"]
    guesses = ridge.in_sample(panel, plan, fits, FEATURES, TARGETS)
    assert guesses.count() == fits.count() * plan.window
    want = score_rows(guesses, keys, [F.col(t) for t in TARGETS], [F.col(f"prediction_{t}") for t in TARGETS])
    want = want.toPandas().set_index(keys).sort_index()
    got = ridge.training_scores(panel, plan, fits, FEATURES, TARGETS).toPandas().set_index(keys).sort_index()
    for c in ("cosine_similarity", "euclidean_rmse", "r2_avg", "r2_flat"):
        assert np.allclose(got[c], want[c], rtol=1e-6, atol=1e-9)
    train = training_rows(panel, plan).toPandas()
    for r in fits.toPandas().itertuples():
        rows = train[(train.series_id == r.series_id) & (train.fold == r.fold)]
        x, y = rows[FEATURES].to_numpy(), rows[TARGETS].to_numpy()
        xc, yc = x - x.mean(0), y - y.mean(0)
        w = np.linalg.solve(xc.T @ xc + {"a": 1e-3, "b": 0.5}[r.candidate] * np.eye(3), xc.T @ yc)
        assert np.allclose(np.stack(r.coef), w.T, atol=1e-6)


def test_scoring_pairs_no_rows_with_fits(panel):
    plan = WalkForward(30, 1, 10)
    fits = ridge.evidence_ridge(ridge.fold_grams(panel, plan, FEATURES, TARGETS), 3, 2)
    text = ridge.training_scores(panel, plan, fits, FEATURES, TARGETS)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "CoGroup" in text


def test_scores_of_constant_targets_and_zero_rows_are_null(spark, pdf):
    flat = pdf.copy()
    flat["t0"], flat["t1"] = 0.0, 0.0
    plan = WalkForward(30, 1, 10)
    panel = spark.createDataFrame(flat)
    fits = ridge.fixed_ridge(ridge.fold_grams(panel, plan, FEATURES, TARGETS), {"a": 1.0}, 3, 2)
    for r in ridge.training_scores(panel, plan, fits, FEATURES, TARGETS).collect():
        assert r.cosine_similarity is None and r.r2_avg is None and r.r2_flat is None and r.euclidean_rmse == 0.0
    with pytest.raises(ValueError):
        ridge.fixed_ridge(fits, {"a": 0.0}, 3, 2)


def test_a_constant_shift_leaves_slopes_alone(panel):
    plan = WalkForward(30, 1, 10)
    moved = panel.withColumns({c: F.col(c) + 50.0 for c in [*FEATURES, *TARGETS]})
    a, b = (
        ridge.evidence_ridge(ridge.fold_grams(p, plan, FEATURES, TARGETS), 3, 2)
        .toPandas()
        .sort_values(["series_id", "fold", "candidate"])
        for p in (panel, moved)
    )
    left, right = np.array(a["coef"].tolist()), np.array(b["coef"].tolist())
    assert np.allclose([list(map(list, r)) for r in left], [list(map(list, r)) for r in right], atol=1e-5)


def dense_process(x, y, ahead, constant, length, noise):
    def k(a, b):
        return constant * np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * length**2))

    s2 = noise + 1e-6
    full = k(x, x) + s2 * np.eye(len(x))
    inverse = np.linalg.inv(full)
    cross = k(ahead, x)
    mean = cross @ inverse @ y
    variance = constant - np.einsum("ij,jk,ik->i", cross, inverse, cross) + noise
    logdet = np.linalg.slogdet(full)[1]
    lml = -0.5 * (np.trace(y.T @ inverse @ y) + y.shape[1] * (logdet + len(x) * np.log(2 * np.pi)))
    return mean, np.sqrt(variance), lml


def test_full_rank_process_equals_the_dense_one(pdf):
    rows = pdf[pdf.series_id == "a"]
    x, y = rows[FEATURES].to_numpy()[:40], rows[TARGETS].to_numpy()[:40]
    ahead = rows[FEATURES].to_numpy()[40:45]
    grid = KernelGrid(length=(0.8,), constant=(1.0,), noise=(1e-2,), restarts=0)
    got = gaussian.fit_fold(x, y, ahead, "RBF", 40, grid)
    mean, std, lml = dense_process(x, y, ahead, 1.0, 0.8, 1e-2)
    assert np.allclose(got["mean"], mean, atol=1e-6)
    assert np.allclose(got["std"], std, atol=1e-6)
    assert np.isclose(got["log_marginal_likelihood"], lml, rtol=1e-6)


def test_gaussian_backtest_covers_every_prediction(spark, panel, pdf):
    plan = WalkForward(30, 1, 10)
    grid = KernelGrid(length=(1.0, 3.0), mixture=(1.0,), period=(5.0,), constant=(1.0,), noise=(1e-3, 1e-1), restarts=0)
    run = gaussian_backtest(panel, plan, FEATURES, TARGETS, grid=grid, inducing=15)
    out = run.forecasts.toPandas()
    assert sorted(out[out.series_id == "a"]["pos"]) == list(range(30, 70))
    assert (out["std_t0"] > 0).all()
    summary = run.summary().toPandas()
    assert len(summary) == 8 and (summary["n_train"] == 30).all()
    best = run.best.toPandas().set_index(["series_id", "fold"])
    top = run.scores.toPandas().groupby(["series_id", "fold"])["cosine_similarity"].max()
    assert np.allclose(best["cosine_similarity"].sort_index(), top.sort_index())
    assert run.importance().filter("abs(importance - 1/3) > 1e-12").count() == 0
    exact = gaussian.fit_fold(
        *[pdf[(pdf.series_id == "b") & (pdf.pos < 30)][c].to_numpy() for c in (FEATURES, TARGETS)],
        pdf[(pdf.series_id == "b") & pdf.pos.between(30, 39)][FEATURES].to_numpy(),
        best.loc[("b", 0), "candidate"],
        15,
        grid,
    )
    mine = out[(out.series_id == "b") & (out.fold == 0)].sort_values("pos")
    assert np.allclose(mine["prediction_t1"], exact["mean"][:, 1])


def test_opt_in_kernels_and_unknown_names(panel):
    plan = WalkForward(30, 1, 20, last_n=1)
    grid = KernelGrid(length=(1.0,), period=(5.0,), constant=(1.0,), noise=(1e-2,))
    kernels = ("Matern", "DotProduct", "Combined_RBF_ExpSine")
    fits = gaussian.fit_predict(panel, plan, FEATURES, TARGETS, kernels, grid, inducing=10, standardize=True)
    assert sorted(r.candidate for r in fits.filter("series_id = 'a'").collect()) == sorted(kernels)
    with pytest.raises(ValueError):
        gaussian.fit_predict(panel, plan, FEATURES, TARGETS, ("Cubic",))
    with pytest.raises(ValueError):
        ridge_backtest(panel, plan, FEATURES, TARGETS, metric="accuracy")
    with pytest.raises(ValueError):
        ridge_backtest(panel, plan, FEATURES, TARGETS, priors={"alpha_7": 7.0})


def test_equal_scores_fall_back_to_cosine_then_grid_order(spark):
    rows = [("s", "late", 2, 0.9, 0.5), ("s", "early", 1, 0.9, 0.5), ("s", "far", 0, 0.8, 0.5), ("s", "none", 3, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, candidate string, ordinal int, cosine_similarity double, r2_avg double")
    assert best_candidates(df, ["k"], "r2_avg").head().candidate == "early"


def test_scores_of_a_zero_vector_and_constant_target(spark):
    df = spark.createDataFrame([("k", 0.0, 0.0, 1.0), ("k", 0.0, 2.0, 1.0)], "k string, y0 double, y1 double, p double")
    got = score_rows(df, ["k"], [F.col("y0"), F.col("y1")], [F.col("p"), F.col("p")]).head()
    assert got.cosine_similarity is None and got.r2_avg is None and got.n_train == 2
    assert np.isclose(got.euclidean_rmse, np.sqrt(2)) and got.r2_flat is not None
