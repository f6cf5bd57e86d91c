from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from curvewalk.operators import gaussian, ridge
from curvewalk.operators.candidates import KernelGrid
from curvewalk.operators.folds import WalkForward
from curvewalk.plans.backtest import continue_backtest, gaussian_backtest, ridge_backtest

from test_models import FEATURES, TARGETS, panel_pdf

PLAN = WalkForward(25, 1, 10)
GRID = KernelGrid(length=(1.0, 3.0), mixture=(1.0,), period=(5.0,), constant=(1.0,), noise=(1e-2,), restarts=1)
KERNELS = ("RBF", "RationalQuadratic")
OPTIONS = {"ridge": {}, "gaussian": {"kernels": KERNELS, "grid": GRID, "standardize": True}}


def upto(spark, sizes):
    """The panel's first rows of each series."""
    pdf = panel_pdf()
    parts = [pdf[(pdf.series_id == s) & (pdf.pos < n)].assign(pos_total=n) for s, n in sizes.items()]
    return spark.createDataFrame(pd.concat(parts))


def whole(spark, family, sizes):
    run = {"ridge": ridge_backtest, "gaussian": gaussian_backtest}[family]
    return run(upto(spark, sizes), PLAN, FEATURES, TARGETS, store=False, **OPTIONS[family])


def alike(a, b, keys):
    names = sorted(set(a.columns) & set(b.columns))
    left, right = (df.select(*names).toPandas().sort_values(keys).reset_index(drop=True) for df in (a, b))
    assert len(left) == len(right)
    for c in names:
        if str(left[c].dtype) == "float64":
            assert np.allclose(left[c], right[c], rtol=1e-9, atol=1e-12, equal_nan=True), c
        elif c not in ("params",):
            assert left[c].astype(str).tolist() == right[c].astype(str).tolist(), c


@pytest.mark.parametrize("family", ["ridge", "gaussian"])
def test_appended_dates_give_what_one_run_gives_and_refit_only_new_folds(spark, tmp_path, monkeypatch, family):
    fitted = []
    module, name = (ridge, "fold_grams") if family == "ridge" else (gaussian, "fit_predict")
    real = getattr(module, name)

    def counted(*args, **options):
        fitted.append(sorted((r.series_id, r.fold) for r in options["only"].collect()))
        return real(*args, **options)

    monkeypatch.setattr(module, name, counted)
    path = f"{tmp_path}/state"
    for sizes in ({"a": 44, "b": 20}, {"a": 45, "b": 20}, {"a": 46, "b": 20}, {"a": 70, "b": 61}, {"a": 70, "b": 61}):
        run = continue_backtest(upto(spark, sizes), PLAN, FEATURES, TARGETS, path, family, **OPTIONS[family])
    # 44 rows of a open folds 0 and 1; the 46th row opens fold 2; b has none until it has over 25 rows.
    assert fitted[0] == [("a", 0), ("a", 1)] and fitted[1] == [("a", 2)]
    assert fitted[2] == [("a", 3), ("a", 4), *[("b", i) for i in range(4)]] and len(fitted) == 3
    monkeypatch.setattr(module, name, real)
    want = whole(spark, family, sizes)
    alike(run.forecasts, want.forecasts, ["series_id", "pos"])
    alike(run.scores, want.scores, ["series_id", "fold", "candidate"])
    assert run.long().count() == 2 * want.forecasts.count() and run.importance().count() == 3 * want.best.count()


def test_a_lost_run_is_made_good(spark, tmp_path):
    path, sizes = f"{tmp_path}/state", {"a": 60, "b": 60}
    first = continue_backtest(upto(spark, {"a": 40, "b": 40}), PLAN, FEATURES, TARGETS, path)
    done = first.forecasts.toPandas()
    # A run that ended after its folds' scores were written, and one that ended before its forecasts were.
    first.scores.limit(3).write.mode("append").parquet(f"{path}/scores")
    ahead = continue_backtest(upto(spark, sizes), PLAN, FEATURES, TARGETS, f"{tmp_path}/other")
    kept = ahead.best.join(first.best.select("series_id", "fold"), ["series_id", "fold"], "left_anti")
    kept.write.mode("append").parquet(f"{path}/best")
    run = continue_backtest(upto(spark, sizes), PLAN, FEATURES, TARGETS, path)
    alike(run.forecasts, whole(spark, "ridge", sizes).forecasts, ["series_id", "pos"])
    assert len(done) == 30 and not run.scores.groupBy("series_id", "fold", "candidate").count().where("count > 1").count()


def test_nothing_to_do_and_wrong_arguments(spark, tmp_path):
    few = upto(spark, {"a": 10, "b": 5})
    assert continue_backtest(few, PLAN, FEATURES, TARGETS, f"{tmp_path}/state").forecasts.count() == 0
    with pytest.raises(ValueError):
        continue_backtest(few, WalkForward(25, 1, 10, last_n=1), FEATURES, TARGETS, f"{tmp_path}/x")
    with pytest.raises(ValueError):
        continue_backtest(few, PLAN, FEATURES, TARGETS, f"{tmp_path}/x", "forest")
