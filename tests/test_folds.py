from __future__ import annotations


import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewalk.operators.folds import WalkForward, fold_groups, prediction_rows, training_rows


def simulate(n, plan):
    """The sequential schedule: a counter that refits every ``refit_every`` predictions."""
    spots = list(range(max(plan.window, plan.min_window) + plan.embargo, n, plan.step))
    if plan.last_n is not None:
        spots = spots[-plan.last_n :] if plan.last_n else []
    ahead, training, fold = [], set(), -1
    for k, i in enumerate(spots):
        refit = k % plan.refit_every == 0
        if refit:
            fold += 1
            training |= {(fold, q) for q in range(i - plan.embargo - plan.window, i - plan.embargo)}
        ahead.append((k, i, fold, i - plan.embargo - plan.window, i - plan.embargo, refit))
    return ahead, training


def panel(spark, sizes):
    pdf = pd.concat([pd.DataFrame({"series_id": s, "pos": range(n), "pos_total": n}) for s, n in sizes.items()])
    return spark.createDataFrame(pdf)


PLANS = [
    WalkForward(20, 5, 10),
    WalkForward(7, 12, 3),
    WalkForward(25, 1, 10, step=3, embargo=4),
    WalkForward(10, 1, 7, last_n=1),
    WalkForward(10, 1, 4, step=2, last_n=5),
    WalkForward(9, 1, 50, embargo=2, last_n=100),
]


@pytest.mark.parametrize("plan", PLANS)
def test_closed_form_equals_the_counter_loop(spark, plan):
    sizes = {"long": 83, "short": 21, "tiny": 4}
    df = panel(spark, sizes)
    ahead = prediction_rows(df, plan).select("series_id", "k", "pos", "fold", "train_start", "train_end", "retrain")
    train = training_rows(df, plan).select("series_id", "fold", "pos")
    grouped = fold_groups(df, plan, 3).select("series_id", "fold_group", "pos")
    got_ahead = {tuple(r) for r in ahead.collect()}
    got_train = [tuple(r) for r in train.collect()]
    got_group = {tuple(r) for r in grouped.collect()}
    want_ahead, want_train = set(), set()
    for s, n in sizes.items():
        a, t = simulate(n, plan)
        want_ahead |= {(s, *row) for row in a}
        want_train |= {(s, *row) for row in t}
    assert got_ahead == want_ahead
    assert len(got_train) == len(set(got_train)) and set(got_train) == want_train
    for s, f, q in want_train:
        assert (s, f // 3, q) in got_group
    for s, _, q, f, *_ in want_ahead:
        assert (s, f // 3, q) in got_group


def test_no_training_row_reaches_its_predictions(spark):
    plan = WalkForward(15, 1, 6, embargo=3)
    df = panel(spark, {"a": 90})
    last = training_rows(df, plan).groupBy("fold").agg(F.max("pos").alias("last"), F.count("*").alias("n"))
    first = prediction_rows(df, plan).groupBy("fold").agg(F.min("pos").alias("first"))
    for r in last.join(first, "fold").collect():
        assert r.n == 15 and r.last == r.first - 3 - 1


def test_bad_settings_are_refused():
    for bad in ({"window": 0}, {"refit_every": 0}, {"step": 0}, {"embargo": -1}):
        with pytest.raises(ValueError):
            WalkForward(**bad)


