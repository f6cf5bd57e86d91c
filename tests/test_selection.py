from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewalk.operators import selection
from curvewalk.operators.selection import largest_gap, order_statistics


def rows(spark, seed):
    random = np.random.default_rng(seed)
    frames = []
    for key, n in (("hot", 4000), ("few", 7), ("one", 1), (None, 5)):
        pdf = pd.DataFrame({"k": key, "x": random.normal(size=n) * 10 ** random.uniform(-9, 9, n), "y": random.integers(-3, 4, n) / 3.0})
        pdf.loc[random.random(n) < 0.1, "y"] = np.nan
        pdf["z"] = 1e8 + random.normal(size=n) * 1e-3  # all in one coarse cell
        pdf.loc[pdf.index[: n // 2], "x"] = -2.5  # half of them tied
        frames.append(pdf)
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_statistics_equal_sorting(spark, seed):
    pdf, df = rows(spark, seed)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    places = {f"p{i}": (lambda n, s=s: F.floor((n - 1) * F.lit(s))) for i, s in enumerate(shares)}
    got = {(r.k, r.column_name): r for r in order_statistics(df, ["k"], ["x", "y", "z"], places).collect()}
    want = {(k, c): np.sort(part[c].dropna().to_numpy()) for k, part in pdf.dropna(subset="k").groupby("k") for c in "xyz"}
    assert set(got) == {key for key, v in want.items() if len(v)}
    for key, r in got.items():
        assert r.n == len(want[key])
        assert [r[f"p{i}"] for i in range(len(shares))] == [want[key][int(np.floor((r.n - 1) * s))] for s in shares]
    whole = order_statistics(df, [], ["y"], {"middle": lambda n: F.floor(n / 2)}).collect()
    assert len(whole) == 1 and whole[0].middle == np.sort(pdf.y.dropna())[pdf.y.count() // 2]


def test_order_statistics_shuffle_few_values(spark, monkeypatch):
    """What a pass counts after the first are the cells of the wanted places, not all values."""
    sizes = []
    real = selection.materialize
    monkeypatch.setattr(selection, "materialize", lambda df, name: (sizes.append(df.count()), real(df, name))[1])
    df = spark.range(20_000).selectExpr("'a' as k", "cast(hash(id) as double) as x")
    got = order_statistics(df, ["k"], ["x"], {"low": lambda n: F.lit(10), "high": lambda n: n - 1}).head()
    values = sorted(r.x for r in df.collect())
    assert (got.low, got.high) == (values[10], values[-1]) and max(sizes) <= 2


@pytest.mark.parametrize("kind", ["normal", "ties", "apart", "same", "one"])
def test_largest_gap_equals_comparing_all_values(spark, kind):
    random = np.random.default_rng(5)
    frames, want = [], {}
    for key, n, m in (("a", 900, 700), ("b", 40, 3)):
        x, y = random.normal(size=n), random.normal(0.2, 1.2, m)
        if kind == "ties":
            x, y = np.round(x), np.round(y)
        if kind == "apart":
            y = y + 100
        if kind == "same":
            y = np.resize(x, m) if m <= n else x
            x = x[:m]
        if kind == "one":
            x, y = np.zeros(n), np.zeros(m)
        points = np.unique(np.r_[x, y])
        gap = np.abs(np.searchsorted(np.sort(x), points, "right") / len(x) - np.searchsorted(np.sort(y), points, "right") / len(y)).max()
        want[key] = (gap, len(x), len(y))
        frames += [pd.DataFrame({"k": key, "v": x, "s": 1}), pd.DataFrame({"k": key, "v": y, "s": 0})]
    frames.append(pd.DataFrame({"k": [None, "a"], "v": [1.0, None], "s": [1, 0]}))
    df = spark.createDataFrame(pd.concat(frames)).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = {r.k: (r.gap, r.n_first, r.n_second) for r in largest_gap(df, ["k"], "v", F.col("s") == 1).collect()}
    assert set(got) == set(want)
    for key, (gap, n, m) in want.items():
        assert got[key][1:] == (n, m) and got[key][0] == pytest.approx(gap, abs=1e-12)
