from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewalk.functions import exact_kolmogorov_p, kolmogorov_p, normal_upper
from curvewalk.operators import evaluate as ev
from curvewalk.operators import report

SCHEMA = "k string, t int, y_true double, y_pred double, y_std double"
GRANULES = ["t div 4"]


def frame(spark, groups):
    rows = [(k, i, *r) for k, values in groups.items() for i, r in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def run_all(spark, groups):
    df = frame(spark, groups)
    got = ev.all_metrics(df, ["k"], ["t"], [F.expr(g) for g in GRANULES])
    return {r.k: r.asDict(recursive=True) for r in got.collect()}


nan = float("nan")


def test_small_groups_give_null_metrics(spark):
    got = run_all(
        spark,
        {
            "none": [(None, 1.0, 1.0), (nan, 2.0, 1.0)],
            "one": [(2.0, 1.0, 0.5)],
            "two": [(2.0, 1.0, 0.5), (3.0, 4.0, 0.5)],
        },
    )
    none, one, two = got["none"], got["one"], got["two"]
    assert none["basic"]["n_samples"] == 0 and none["basic"]["mae"] is None
    assert none["distribution"]["ks_statistic"] is None and none["uncertainty"]["coverage_95"] is None
    assert one["basic"]["mae"] == 1.0 and one["basic"]["r2"] is None
    assert one["directional"]["directional_accuracy"] is None and one["directional"]["n_up_movements"] == 0
    assert two["directional"]["directional_accuracy"] == 100.0
    for group in (one, two):
        assert group["distribution"]["bias"] is None and group["residual"]["residual_mean"] is None
        assert group["residual"]["shapiro_francia_w"] is None and group["distribution"]["ks_pvalue"] is None


def test_constant_and_zero_inputs(spark):
    got = run_all(
        spark,
        {
            "flat": [(1.0, 1.5, 0.1)] * 6,
            "zero": [(0.0, 1.0, 1.0), (0.0, 0.0, 1.0), (2.0, 1.0, 1.0), (4.0, 5.0, 1.0)],
        },
    )
    flat, zero = got["flat"], got["zero"]
    assert flat["basic"]["r2"] is None and flat["residual"]["autocorr_lag1"] is None
    assert flat["residual"]["variance_ratio"] is None and flat["residual"]["residual_std"] == 0.0
    assert flat["distribution"]["std_ratio"] is None and flat["distribution"]["ks_statistic"] == 1.0
    assert flat["directional"]["n_down_movements"] == 5 and flat["directional"]["up_accuracy"] is None
    assert np.isclose(zero["percentage"]["mape"], (50 + 25) / 2)


def test_against_numpy_with_missing_rows(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(size=61).cumsum(), rng.normal(size=61).cumsum()
    s = rng.random(61) + 0.1
    rows = list(zip(y.tolist(), p.tolist(), s.tolist()))
    rows[3], rows[17], rows[40] = (None, rows[3][1], 0.2), (rows[17][0], nan, 0.2), (rows[40][0], rows[40][1], None)
    got = run_all(spark, {"m": rows})["m"]
    y = np.array([nan if r[0] is None else r[0] for r in rows])
    p = np.array([r[1] for r in rows])
    s = np.array([nan if r[2] is None else r[2] for r in rows])
    keep = ~(np.isnan(y) | np.isnan(p))
    e = (y - p)[keep]
    dy, dp = np.diff(y), np.diff(p)
    seen = ~(np.isnan(dy) | np.isnan(dp))
    assert np.isclose(got["directional"]["directional_accuracy"], 100 * ((dy > 0) == (dp > 0))[seen].mean())
    assert np.isclose(got["residual"]["autocorr_lag1"], np.corrcoef(e[:-1], e[1:])[0, 1])
    half = len(e) // 2
    assert np.isclose(got["residual"]["variance_ratio"], e[half:].var() / e[:half].var())
    z = (e - e.mean()) / e.std()
    assert np.isclose(got["residual"]["residual_skewness"], (z**3).mean())
    assert np.isclose(got["residual"]["residual_kurtosis"], (z**4).mean() - 3)
    with_std = keep & ~np.isnan(s)
    inside = np.abs(y - p)[with_std] <= 1.96 * s[with_std]
    assert np.isclose(got["uncertainty"]["coverage_95"], 100 * inside.mean())
    grid = np.sort(np.concatenate([y[keep], p[keep]]))
    gap = [abs((y[keep] <= v).mean() - (p[keep] <= v).mean()) for v in grid]
    assert np.isclose(got["distribution"]["ks_statistic"], max(gap))
    assert 0.9 < got["residual"]["shapiro_francia_w"] <= 1.0


def test_forecast_without_standard_deviation(spark):
    df = frame(spark, {"a": [(1.0, 2.0, None), (2.0, 2.5, None), (4.0, 3.0, None)]}).drop("y_std")
    got = ev.all_metrics(df, ["k"], ["t"], [F.expr(g) for g in GRANULES]).head()
    assert got.uncertainty.coverage_95 is None and got.basic.n_samples == 3
    text = ev.metrics_json(ev.all_metrics(df, ["k"], ["t"], [F.expr(g) for g in GRANULES]), ["k"]).head()
    assert '"coverage_95":null' in text.metrics_json


def test_histogram_counts_every_residual(spark):
    values = [(float(i), 0.0, 1.0) for i in range(31)]
    df = frame(spark, {"a": values, "same": [(2.0, 1.0, 1.0)] * 4})
    got = report.residual_histogram(df, ["k"], bins=10).toPandas()
    a = got[got.k == "a"]
    assert a["rows"].sum() == 31 and a["bin"].max() == 9
    assert math.isclose((a["density"] * 3.0).sum(), 1.0)
    assert sorted(got[got.k == "same"]["rows"]) == [0] * 9 + [4]


def test_summary_report_keeps_missing_values_visible(spark):
    df = spark.createDataFrame([("s1", 0.5, nan), ("s2", 0.1, 2.0)], "series string, mae double, rmse double")
    got = {r.Bond_Index: r for r in report.summary_report(df, "series").collect()}
    assert got["s1"].MAE == 0.5 and got["s1"].RMSE is None and got["s1"].Best_Kernel == "Unknown"
    assert got["s2"].Predictions_Count is None


@pytest.mark.parametrize("rows", [1, 2, 3])
def test_qq_of_tiny_groups(spark, rows):
    df = frame(spark, {"a": [(float(i), 0.0, 1.0) for i in range(rows)]})
    got = report.normal_qq(df, ["k"]).orderBy("ordinal").toPandas()
    assert got["residual"].tolist() == [float(i) for i in range(rows)]
    assert np.isclose(got["quantile"].sum(), 0.0, atol=1e-6)


def test_exact_two_sample_p_equals_full_enumeration(spark):
    from itertools import combinations

    for n in (3, 5, 7):
        gaps = []
        for picked in combinations(range(2 * n), n):
            steps = np.where(np.isin(np.arange(2 * n), picked), 1, -1)
            gaps.append(np.abs(np.cumsum(steps)).max())
        gaps = np.array(gaps)
        rows = spark.range(n + 1).selectExpr("id", f"id / {n} as d", f"cast({n} as long) as n")
        for r in rows.select("id", exact_kolmogorov_p(F.col("d"), F.col("n")).alias("p")).collect():
            assert np.isclose(r.p, (gaps >= r.id).mean(), atol=1e-12)


def test_exact_two_sample_p_meets_the_asymptotic_one(spark):
    n = 10_000
    rows = spark.range(100, 201, 50).selectExpr(f"id / {n} as d", f"cast({n} as long) as n")
    far = kolmogorov_p(F.col("d"), F.col("n").cast("double"), F.col("n").cast("double"))
    for r in rows.select(exact_kolmogorov_p(F.col("d"), F.col("n")).alias("near"), far.alias("far")).collect():
        assert np.isclose(r.near, r.far, rtol=0.03)


def test_normal_upper_tail(spark):
    from math import erfc

    z = [-40.0, -8.0, -3.0, -0.5, 0.0, 0.1, 1.0, 1.959963984540054, 5.0, 7.0, 7.2, 12.0, 36.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", normal_upper(F.col("z")).alias("p")).collect()
    for r in got:
        assert np.isclose(r.p, erfc(r.z / 2**0.5) / 2, rtol=1e-6, atol=1e-300)


def test_normality_p_is_uniform_for_normal_rows_and_small_for_others(spark):
    random = np.random.default_rng(8)
    frames = [pd.DataFrame({"k": f"n{i}", "i": range(60), "e": random.normal(size=60)}) for i in range(300)]
    frames += [pd.DataFrame({"k": f"x{i}", "i": range(60), "e": random.exponential(size=60)}) for i in range(30)]
    frames += [pd.DataFrame({"k": "few", "i": range(4), "e": random.normal(size=4)})]
    pdf = pd.concat(frames)
    pdf["y_true"], pdf["y_pred"] = 100 + pdf["e"], 100.0
    got = ev.shapiro_francia(spark.createDataFrame(pdf), ["k"]).toPandas().set_index("k").shapiro_francia_p
    normal = got[got.index.str.startswith("n")]
    for share in (0.05, 0.25, 0.5, 0.75):
        assert abs((normal < share).mean() - share) < 3.5 * (share * (1 - share) / len(normal)) ** 0.5
    assert (got[got.index.str.startswith("x")] < 0.01).mean() > 0.9 and np.isnan(got["few"])
