"""Rows without an order, missing values and extreme levels: kept, left out of counts, or exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewalk.operators import curve, evaluate, features, gaussian, report, ridge
from curvewalk.operators.candidates import KernelGrid
from curvewalk.operators.folds import WalkForward
from curvewalk.operators.panel import describe, with_positions
from curvewalk.operators.scan import ordered_scan
from curvewalk.operators.scores import best_candidates
from curvewalk.plans.yields import coefficient_of


def test_metrics_count_rows_without_a_date(spark):
    rows = [("a", None if i % 3 == 0 else f"2021-01-{i + 1:02d}", float(i), i + 0.1 * (i % 4)) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, date string, y_true double, y_pred double")
    full = evaluate.all_metrics(df, ["k"], ["date"], [F.substring("date", 1, 7)]).head()
    errors = np.array([abs(p - y) for _, _, y, p in rows])
    assert full.basic.n_samples == 9 and np.isclose(full.basic.mae, errors.mean())
    assert full.directional.n_up_movements == 5  # of the six dated rows
    assert evaluate.compare_models(df, ["k"], ["date"], [F.substring("date", 1, 7)]).head().mae == full.basic.mae


def test_scan_keeps_rows_without_a_place(spark):
    rows = [("a", 3), ("a", None), (None, 1), ("a", 1), (None, None)]
    df = spark.createDataFrame(rows, "k string, d int")
    got = sorted((str(r.k), str(r.d), str(r.pos), str(r.pos_total)) for r in ordered_scan(df, ["k"], ["d"], [F.col("d")]).collect())
    none = "None"
    want = [("a", "1", "0", "2"), ("a", "3", "1", "2"), ("a", none, none, none), (none, "1", none, none), (none, none, none, none)]
    assert got == sorted(want)


@pytest.mark.parametrize("bound", [10, None])
def test_percentiles_keep_missing_values_out(spark, bound):
    df = spark.createDataFrame([("g", None), ("g", 1.0), ("g", 2.0), ("g", float("nan")), ("g", 2.0)], "g string, v double")
    got = [(str(r.v), r.percentile) for r in curve.percentile_ranks(df, ["g"], "v", bound).collect()]
    assert sorted(got, key=str) == sorted([("None", None), ("nan", None), ("1.0", 1 / 3), ("2.0", 2.5 / 3), ("2.0", 2.5 / 3)], key=str)


def test_curve_fit_finds_any_decay_and_keeps_unsolvable_keys(spark):
    years = [y for _, y in curve.TENORS]
    rows = []
    known = {"slow": (0.03, -0.02, 0.02, 0.05), "usual": (0.03, -0.02, 0.02, 0.5), "fast": (0.03, -0.02, 0.02, 8.0)}
    for key, (b0, b1, b2, lam) in known.items():
        for m in years:
            slope = (1 - np.exp(-lam * m)) / (lam * m)
            rows.append((key, m, float(b0 + b1 * slope + b2 * (slope - np.exp(-lam * m)))))
    rows += [("two", 1.0, 0.02), ("two", 2.0, 0.03), ("gaps", 1.0, None), ("gaps", None, 0.1), ("gaps", -1.0, 0.1)]
    df = spark.createDataFrame(rows, "key string, maturity double, y double")
    got = {r.key: r for r in curve.fit_curves(df, ["key"]).collect()}
    for key, want in known.items():
        assert np.allclose([got[key][c] for c in curve.COEFFICIENTS], want, rtol=1e-5, atol=1e-7), key
    assert all(got[k][c] is None for k in ("two", "gaps") for c in curve.COEFFICIENTS)


def test_every_bin_and_every_column(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.0), ("a", 4.0, 0.0), ("b", 1.0, 1.0)], "k string, y_true double, y_pred double")
    bins = report.residual_histogram(df, ["k"]).collect()
    assert sum(r.rows for r in bins if r.k == "a") == 3 and len(bins) == 60
    found = {r.column_name: r["count"] for r in describe(df.withColumn("void", F.lit(None).cast("double")), ["y_true", "void"]).collect()}
    assert found == {"y_true": 4, "void": 0}


def test_one_missing_value_does_not_spoil_the_rest(spark):
    x = pd.Series([1.0, 2.0, np.nan, 4.0, 5.0, 6.0, 3.0, 2.0])
    rows = [("a", f"2021-01-{i + 1:02d}", float(v)) for i, v in enumerate(x)]
    df = with_positions(spark.createDataFrame(rows, "series_id string, date string, x double").withColumn("date", F.to_date("date")))
    got = features.derive(df, {"e": features.exponential_average("x", 3), "m": features.moving_average("x", 2)}).orderBy("pos").toPandas()
    assert np.allclose(got["e"], x.ewm(span=3).mean()) and np.allclose(got["m"], x.rolling(2).mean(), equal_nan=True)
    rolled = report.rolling_mean(df, ["series_id"], "x", 2).orderBy("pos").toPandas()
    assert np.allclose(rolled["rolling_x"], x.rolling(2).mean(), equal_nan=True)


def test_a_nan_score_never_wins(spark):
    rows = [("s", "good", 0, 0.5, 0.1), ("s", "nan", 1, float("nan"), float("nan"))]
    df = spark.createDataFrame(rows, "k string, candidate string, ordinal int, cosine_similarity double, euclidean_rmse double")
    for metric in ("cosine_similarity", "euclidean_rmse"):
        assert best_candidates(df, ["k"], metric).head().candidate == "good"


def test_targets_are_matched_by_name():
    names = ["lambda_future_val", "beta2_future_val", "beta0_future_val", "beta1_future_val"]
    assert coefficient_of(names) == dict(zip(names, ["lambda_", "beta2", "beta0", "beta1"]))
    with pytest.raises(ValueError):
        coefficient_of(["beta0", "beta1", "beta2"])


@pytest.mark.parametrize("level", [1e6, 1e8])
def test_models_do_not_depend_on_the_level(spark, level):
    random = np.random.default_rng(5)
    x = random.normal(size=(60, 2))
    y = x @ np.array([[0.5, -1.0], [2.0, 0.3]]) + 0.1 * random.normal(size=(60, 2))
    rows = pd.DataFrame(np.column_stack([x, y]), columns=["f0", "f1", "t0", "t1"])
    rows["series_id"], rows["pos"], rows["pos_total"] = "a", np.arange(60), 60
    plan, found = WalkForward(30, 1, 10), []
    for shift in (0.0, level):
        moved = rows.copy()
        moved[["f0", "f1", "t0", "t1"]] += shift
        panel = spark.createDataFrame(moved).withColumns({"pos": F.col("pos").cast("long"), "pos_total": F.col("pos_total").cast("long")})
        fits = ridge.evidence_ridge(ridge.fold_grams(panel, plan, ["f0", "f1"], ["t0", "t1"]), 2, 2).toPandas()
        found.append(np.array([np.stack(c) for c in fits.sort_values(["fold", "ordinal"])["coef"]]))
    assert np.allclose(found[0], found[1], atol=1e-6)
    grid = KernelGrid(length=(1.0,), constant=(1.0,), noise=(1e-2,), restarts=0)
    a, b = (gaussian.fit_fold(x[:40] + s, y[:40], x[40:] + s, "RBF", None, grid) for s in (0.0, level))
    assert np.allclose(a["mean"], b["mean"], atol=1e-6) and np.isclose(a["log_marginal_likelihood"], b["log_marginal_likelihood"], rtol=1e-6)


@pytest.mark.parametrize("kernel", ["RBF", "RationalQuadratic", "ExpSineSquared"])
def test_exact_process_equals_a_dense_solve(kernel):
    random = np.random.default_rng(7)
    x, ahead = random.normal(size=(35, 3)), random.normal(size=(6, 3))
    y = np.sin(x[:, :2]) + 0.05 * random.normal(size=(35, 2))
    got = gaussian.fit_fold(x, y, ahead, kernel, None, KernelGrid(length=(0.5, 2.0), mixture=(1.0,), period=(4.0,), restarts=1))
    p = got["params"]

    def k(a, b):
        d2 = ((a[:, None] - b[None]) ** 2).sum(-1)
        shapes = {
            "RBF": lambda: np.exp(-d2 / (2 * p["length"] ** 2)),
            "RationalQuadratic": lambda: (1 + d2 / (2 * p["mixture"] * p["length"] ** 2)) ** -p["mixture"],
            "ExpSineSquared": lambda: np.exp(-2 * (np.sin(np.pi * np.sqrt(d2) / p["period"]) / p["length"]) ** 2),
        }
        return p["constant"] * shapes[kernel]()

    full = k(x, x) + (p["noise"] + 1e-6) * np.eye(35)
    solved = np.linalg.solve(full, y)
    assert np.allclose(got["mean"], k(ahead, x) @ solved, atol=1e-6)
    spread = p["constant"] - np.einsum("ij,ji->i", k(ahead, x), np.linalg.solve(full, k(x, ahead))) + p["noise"]
    assert np.allclose(got["std"], np.sqrt(spread), atol=1e-6)
    evidence = -0.5 * (np.trace(y.T @ solved) + 2 * (np.linalg.slogdet(full)[1] + 35 * np.log(2 * np.pi)))
    assert np.isclose(got["log_marginal_likelihood"], evidence, rtol=1e-6)
    assert 1e-2 <= p["length"] <= 1e2


def test_model_matrix_has_a_column_for_each_model(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0), ("b", 5.0, 6.0, 7.0, 8.0)], "model string, mae double, rmse double, mape double, directional_accuracy double")
    got = {r.metric: (r.a, r.b) for r in report.metric_matrix(df, ["model"], "model", ["a", "b"]).collect()}
    assert got == {"MAE": (1.0, 5.0), "RMSE": (2.0, 6.0), "MAPE": (3.0, 7.0), "Directional_Accuracy": (4.0, 8.0)}


def test_many_features_fit_in_one_pass(spark):
    random = np.random.default_rng(3)
    names = [f"f{i}" for i in range(120)]
    rows = pd.DataFrame(random.normal(size=(300, 120)), columns=names)
    rows["t0"] = rows[names] @ random.normal(size=120) + 1e-3 * random.normal(size=300)
    rows["series_id"], rows["pos"], rows["pos_total"] = "a", np.arange(300), 300
    panel = spark.createDataFrame(rows).withColumns({c: F.col(c).cast("long") for c in ("pos", "pos_total")})
    grams = ridge.fold_grams(panel, WalkForward(250, 1, 30), names, ["t0"])
    got = ridge.evidence_ridge(grams, 120, 1).filter("fold = 0 and ordinal = 0").head()
    train = rows[:250]
    x = np.column_stack([np.ones(250), train[names]])
    want = np.linalg.lstsq(x, train["t0"], rcond=None)[0]
    assert np.allclose(got.coef[0], want[1:], atol=1e-3) and got.n_train == 250
