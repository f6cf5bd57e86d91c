from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewalk.functions import normal_quantile
from curvewalk.operators import curve, features, samples
from curvewalk.operators.curve import COEFFICIENTS, TENOR_NAMES, TENORS
from curvewalk.operators.panel import describe, with_positions


def test_fit_recovers_coefficients_on_the_grid(spark):
    rows = [("a", 0.03, -0.02, 0.02, 0.5), ("b", 0.05, -0.01, -0.03, 1.25), ("c", 0.02, 0.01, 0.04, 0.435)]
    df = spark.createDataFrame(rows, "id string, beta0 double, beta1 double, beta2 double, lambda_ double")
    points = df.withColumn("t", F.explode(curve.tenors())).select(
        "id",
        F.col("t.maturity").alias("maturity"),
        curve.nelson_siegel(F.col("t.maturity"), *[F.col(c) for c in COEFFICIENTS]).alias("y"),
    )
    got = {r.id: r for r in curve.fit_curves(points, ["id"]).collect()}
    for id_, *want in rows:
        assert np.allclose([got[id_][c] for c in COEFFICIENTS], want, atol=1e-6)


def test_curve_value_matches_the_formula(spark):
    df = spark.createDataFrame([(0.03, -0.02, 0.02, 0.5)], "beta0 double, beta1 double, beta2 double, lambda_ double")
    got = df.select(*curve.yields_percent()).head()
    for name, m in TENORS:
        slope = (1 - math.exp(-0.5 * m)) / (0.5 * m)
        assert math.isclose(got[name], 100 * (0.03 - 0.02 * slope + 0.02 * (slope - math.exp(-0.5 * m))))


def test_percentiles_agree_with_and_without_a_group_bound(spark):
    rng = random.Random(4)
    rows = [(g, rng.randint(-5, 5) / 3) for g in ("x", "y") for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    a = curve.percentile_ranks(df, ["g"], "v", 1000).groupBy("g", "v").agg(F.max("percentile").alias("p"))
    b = curve.percentile_ranks(df, ["g"], "v", None).groupBy("g", "v").agg(F.min("percentile").alias("p"))
    left, right = a.orderBy("g", "v").toPandas(), b.orderBy("g", "v").toPandas()
    assert np.allclose(left["p"], right["p"])
    whole = curve.percentile_ranks(df, ["g"], "v", None)
    assert whole.count() == 400
    assert np.isclose(whole.filter("g = 'x'").agg(F.avg("percentile")).head()[0], 201 / 400)


def test_draws_do_not_depend_on_partitioning(spark):
    rows = [(f"s{i}", 0.1 * i, 0.01) for i in range(6)]
    df = spark.createDataFrame(rows, "series_id string, prediction_beta0 double, std_beta0 double")

    def drawn(part):
        out = samples.draw_samples(df.repartition(part), ["beta0"], ["series_id"], 50)
        return sorted(map(tuple, out.collect()))

    assert drawn(1) == drawn(5)
    z = samples.draw_table(spark, ["beta0", "beta1"], 4000).agg(
        F.avg("z_beta0"), F.stddev("z_beta0"), F.corr("z_beta0", "z_beta1")
    ).head()
    assert abs(z[0]) < 0.05 and abs(z[1] - 1) < 0.05 and abs(z[2]) < 0.05


def test_normal_quantile(spark):
    # Standard normal quantiles.
    known = {0.001: -3.090232306, 0.025: -1.959963985, 0.5: 0.0, 0.8: 0.841621234, 0.999: 3.090232306}
    df = spark.createDataFrame([(p,) for p in [*known, 0.0, 1.0]], "p double")
    got = {r.p: r.q for r in df.select("p", normal_quantile(F.col("p")).alias("q")).collect()}
    for p, q in known.items():
        assert abs(got[p] - q) < 1e-7
    assert got[0.0] is None and got[1.0] is None


def test_derivations_against_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=90)
    rows = [("a", f"2021-{1 + i // 28:02d}-{1 + i % 28:02d}", float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, date string, x double").withColumn("date", F.col("date").cast("date"))
    got = features.derive(
        with_positions(df),
        {
            "ma": features.moving_average("x", 10),
            "ema": features.exponential_average("x", 4),
            "lag": features.lag("x"),
            "label": features.future("x", 7),
            "spread": features.average_spread("x", 3, 10),
        },
    ).orderBy("pos").toPandas()
    import pandas as pd

    s = pd.Series(x)
    assert np.allclose(got["ma"], s.rolling(10).mean(), equal_nan=True)
    assert np.allclose(got["lag"], s.shift(), equal_nan=True)
    assert np.allclose(got["label"], s.shift(-7), equal_nan=True)
    assert np.allclose(got["spread"], s.rolling(3).mean() - s.rolling(10).mean(), equal_nan=True)
    assert np.allclose(got["ema"], s.ewm(span=4).mean(), atol=1e-12)


def test_exponential_average_across_blocks_and_gaps(spark):
    import pandas as pd

    rng = np.random.default_rng(8)
    x = pd.Series(rng.normal(size=3000))
    x[rng.random(3000) < 0.1] = np.nan
    pdf = pd.DataFrame({"series_id": "a", "pos": range(3000), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = features.derive(df, {"e": features.exponential_average("x", 3)}).orderBy("pos").toPandas()
    assert np.allclose(got["e"], x.ewm(span=3).mean(), atol=1e-12, equal_nan=True)


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(7)
    values = np.round(rng.normal(size=101), 1)
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(values)], "a double, b double")
    got = {r.column_name: r for r in describe(df, ["a", "b"]).collect()}
    import pandas as pd

    want = pd.Series(values).describe()
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert np.isclose(got["a"][ours], want[theirs])
    assert got["b"]["q50"] == 50.0


def test_wide_sample_yields(spark):
    rows = [("s", "d", i, 0.02 + i / 1e3, -0.01, 0.01, 0.5) for i in range(4)]
    df = spark.createDataFrame(rows, "series_id string, date string, sample_id int, beta0 double, beta1 double, beta2 double, lambda_ double")
    wide = curve.sample_yields_wide(df, ["series_id", "date"], 4)
    got = wide.orderBy("sample_id").toPandas()
    assert got["DGS10_percentile"].tolist() == [0.25, 0.5, 0.75, 1.0]
    assert set(TENOR_NAMES) <= set(got.columns)


@pytest.mark.parametrize("bound", [40, None])
def test_ranks_of_draws_with_ties_gaps_and_missing_groups(spark, bound):
    random = np.random.default_rng(6)
    rows = []
    for g in (1, 2, None):
        for i in range(30):
            betas = [float(v) for v in random.integers(0, 3, 3) / 100]
            rows.append((g, i, *betas, None if i == 4 else 0.0 if i == 5 else 0.5))
    df = spark.createDataFrame(rows, "g int, sample_id int, beta0 double, beta1 double, beta2 double, lambda_ double")
    long = curve.sample_yields(df, ["g"], bound).toPandas()
    wide = curve.sample_yields_wide(df, ["g"], bound).toPandas()
    assert len(long) == 90 * 11 and len(wide) == 90 and long.percentile[long.g.isna()].isna().all()
    placed = long[long.g.notna()].copy()
    placed["want"] = placed.groupby(["g", "tenor"]).yield_pct.rank(pct=True)
    assert np.allclose(placed.percentile, placed.want, equal_nan=True) and placed.percentile.isna().sum() == 2 * 2 * 11
    merged = placed.pivot(index=["g", "sample_id"], columns="tenor", values="percentile").sort_index()
    own = wide[wide.g.notna()].set_index(["g", "sample_id"]).sort_index()
    for t in curve.TENOR_NAMES:
        assert np.allclose(own[f"{t}_percentile"], merged[t], equal_nan=True)


def test_a_group_beyond_its_bound_raises(spark):
    df = spark.range(5).selectExpr("1 as g", "id as sample_id", "0.1D as beta0", "0.1D as beta1", "0.1D as beta2", "0.5D as lambda_")
    with pytest.raises(Exception, match="max_group"):
        curve.sample_yields(df, ["g"], 4).collect()
