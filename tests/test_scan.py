from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewalk.operators import scan
from curvewalk.operators.scan import expand_runs, ordered_scan, over_blocks, value_runs


def rows(seed=1, n=900):
    """Two thirds of all rows under one key, some values missing."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "key": np.where(rng.random(n) < 0.67, "hot", rng.choice(["a", "b", "c"], n)),
            "day": rng.integers(0, 40, n),
            "id": rng.permutation(n),
            "x": rng.normal(size=n).round(1),
        }
    )
    pdf.loc[rng.random(n) < 0.2, "x"] = None
    return pdf


def test_positions_and_carries_match_a_plain_pass(spark):
    pdf = rows()
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = ordered_scan(
        df,
        ["key"],
        ["day", "id"],
        [F.col("day"), F.expr("id div 64")],
        sums={"pos": F.lit(1), "vpos": F.col("x").isNotNull().cast("int")},
        carries={"earlier": (F.struct("x"), F.col("x").isNotNull()), "before": (F.struct("id"), F.lit(True))},
    ).toPandas()
    assert len(got) == len(pdf)
    want = pdf.sort_values(["key", "day", "id"])
    by = want.groupby("key")
    want["pos"] = by.cumcount()
    valid = want["x"].notna()
    want["vpos"] = valid.groupby(want["key"]).cumsum() - valid
    want["earlier"] = by["x"].transform(lambda s: s.ffill().shift())
    want["before"] = by["id"].shift()
    got = got.sort_values(["key", "day", "id"])
    assert got["pos"].tolist() == want["pos"].tolist()
    assert got["vpos"].tolist() == want["vpos"].tolist()
    assert (got["pos_total"].to_numpy() == by["id"].transform("count").to_numpy()).all()
    earlier = [np.nan if e is None else e["x"] for e in got["earlier"]]
    assert np.allclose(earlier, want["earlier"], equal_nan=True)
    before = [np.nan if e is None else e["id"] for e in got["before"]]
    assert np.allclose(before, want["before"], equal_nan=True)


def test_blocks_equal_whole_windows(spark):
    pdf = pd.DataFrame({"key": ["k"] * 100 + ["m"] * 3, "pos": [*range(100), *range(3)]})
    pdf["x"] = np.sin(pdf["pos"])
    got = over_blocks(
        spark.createDataFrame(pdf),
        ["key"],
        {
            "mean": lambda w: F.avg("x").over(w.rowsBetween(-4, 0)),
            "next": lambda w: F.lead("x", 3).over(w),
        },
        back=4,
        ahead=3,
        size=7,
    ).toPandas().sort_values(["key", "pos"])
    by = pdf.groupby("key")["x"]
    assert len(got) == len(pdf)
    assert np.allclose(got["mean"], by.transform(lambda s: s.rolling(5, min_periods=1).mean()))
    assert np.allclose(got["next"], by.shift(-3), equal_nan=True)


def test_value_runs_and_expansion_with_a_dominant_tie(spark):
    values = [0.0] * 40 + [-1e-20, 1e-20, 3.5, -7.0, 3.5, 1e300, 3.5000001]
    df = spark.createDataFrame([("k", v) for v in values] + [("single", 2.0)], "key string, value double")
    runs = value_runs(df, ["key"], "value")
    got = expand_runs(runs, limit=7).toPandas()
    k = got[got["key"] == "k"].sort_values("rank")
    assert k["rank"].tolist() == list(range(len(values)))
    assert k["value"].tolist() == sorted(values)
    assert got[got["key"] == "single"]["n_total"].tolist() == [1]


def test_no_task_sees_a_whole_hot_key(spark):
    """Granules bound the rows that one window group holds, however hot the key."""
    df = spark.range(50_000).select(F.lit("hot").alias("key"), F.col("id"))
    placed = ordered_scan(df, ["key"], ["id"], [F.expr("id div 1000")])
    text = placed._jdf.queryExecution().toString()
    assert "windowspecdefinition(key" in text
    biggest = placed.groupBy(F.expr("id div 1000")).count().agg(F.max("count")).head()[0]
    assert biggest == 1000
    assert placed.filter("pos != id").count() == 0


@pytest.mark.parametrize(("span", "n"), [(2, 900), (3, 5000), (40, 5000), (5000, 30_000)])
def test_decayed_mean_equals_the_one_over_all_rows(spark, span, n):
    random = np.random.default_rng(span)
    x = pd.Series(1e3 + random.normal(size=n))
    x[random.random(n) < 0.3] = np.nan
    x[n // 3 : n // 3 + min(n // 2, 300 * span)] = np.nan  # longer than a block where there is room
    x[:5] = np.nan
    both = pd.concat([pd.DataFrame({"k": k, "pos": range(n), "x": v}) for k, v in (("a", x), ("b", -x[::-1].reset_index(drop=True)))])
    df = spark.createDataFrame(both).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    nowhere = spark.createDataFrame([("a", None, 1.0), ("a", None, None)], "k string, pos long, x double")
    got = scan.decayed_mean(df.unionByName(nowhere), ["k"], "x", 1 - 2 / (span + 1), "e")
    rows = got.toPandas()
    assert rows[rows.pos.isna()].e.isna().all() and len(rows) == 2 * n + 2
    for k, v in both.groupby("k").x:
        mine = rows[(rows.k == k) & rows.pos.notna()].sort_values("pos").e
        assert np.allclose(mine, v.ewm(span=span).mean(), rtol=1e-11, equal_nan=True)


def test_decayed_mean_copies_no_rows(spark):
    df = spark.range(50_000).selectExpr("'a' as k", "id as pos", "cast(id as double) as x")
    plan = scan.decayed_mean(df, ["k"], "x", 1 - 2 / 5001, "e")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
