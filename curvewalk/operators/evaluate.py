"""Forecast evaluation: every metric is an aggregate over (y_true, y_pred, y_std) by any keys.

Metrics that only need sums are one map-side combined groupBy. Those that look at the previous
row or at half positions share one ordered scan. Distribution distances and normality use value
scans. Groups with too few rows give NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewalk.functions import EXACT_KS, clean, exact_kolmogorov_p, kolmogorov_p, normal_quantile, ratio, shapiro_francia_p
from curvewalk.operators.scan import expand_runs, ordered_scan, value_runs
from curvewalk.operators.selection import largest_gap

def _y() -> Column:
    return F.col("y_true")


def _p() -> Column:
    return F.col("y_pred")


def _s() -> Column:
    return F.col("y_std")


def prepare(df: DataFrame) -> DataFrame:
    """Clean the three inputs; a forecast without standard deviations gets a NULL ``y_std``."""
    std = clean("y_std") if "y_std" in df.columns else F.lit(None).cast("double")
    return df.withColumns({"y_true": clean("y_true"), "y_pred": clean("y_pred"), "y_std": std})


def _valid() -> Column:
    return _y().isNotNull() & _p().isNotNull()


def _residual() -> Column:
    return F.when(_valid(), _y() - _p())


def _enough(n: int, column: Column) -> Column:
    return F.when(F.count(_residual()) >= n, column)


def basic_columns() -> dict[str, Column]:
    e = _residual()
    y = F.when(_valid(), _y())
    n = F.count(e)
    return {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": 1 - ratio(F.sum(e * e), F.var_pop(y) * n),
        "n_samples": n,
    }


def percentage_columns() -> dict[str, Column]:
    usable = _valid() & (_y() != 0)
    apart = F.abs(_y() - _p())
    return {
        "mape": F.avg(F.when(usable, F.abs(ratio(_y() - _p(), _y())))) * 100,
        "smape": F.avg(F.when(usable, ratio(2 * apart, F.abs(_p()) + F.abs(_y())))) * 100,
    }


def directional_columns() -> dict[str, Column]:
    """Needs ``previous`` = struct(y_true, y_pred) of the row before."""
    step, guess = _y() - F.col("previous.y_true"), _p() - F.col("previous.y_pred")
    known = step.isNotNull() & guess.isNotNull()
    up, guess_up = step > 0, guess > 0
    hit = F.when(up == guess_up, 100.0).otherwise(0.0)
    return {
        "directional_accuracy": F.avg(F.when(known, hit)),
        "up_accuracy": F.avg(F.when(known & up, hit)),
        "down_accuracy": F.avg(F.when(known & ~up, hit)),
        "n_up_movements": F.count_if(known & up),
        "n_down_movements": F.count_if(known & ~up),
    }


def distribution_columns() -> dict[str, Column]:
    y, p = F.when(_valid(), _y()), F.when(_valid(), _p())
    bias = F.avg(p) - F.avg(y)
    columns = {
        "bias": bias,
        "relative_bias": ratio(bias, F.avg(y)),
        "true_mean": F.avg(y),
        "pred_mean": F.avg(p),
        "true_std": F.stddev_pop(y),
        "pred_std": F.stddev_pop(p),
        "std_ratio": ratio(F.stddev_pop(p), F.stddev_pop(y)),
    }
    return {k: _enough(3, c) for k, c in columns.items()}


def uncertainty_columns() -> dict[str, Column]:
    usable = _valid() & _s().isNotNull()

    def coverage(width: float) -> Column:
        inside = (_y() >= _p() - width * _s()) & (_y() <= _p() + width * _s())
        return F.avg(F.when(usable, F.when(inside, 100.0).otherwise(0.0)))

    def breadth(width: float) -> Column:
        return F.avg(F.when(usable, (_p() + width * _s()) - (_p() - width * _s())))

    return {
        "coverage_95": coverage(1.96),
        "coverage_68": coverage(1.0),
        "avg_interval_width_95": breadth(1.96),
        "avg_interval_width_68": breadth(1.0),
        "avg_prediction_std": F.avg(F.when(usable, _s())),
    }


def residual_columns() -> dict[str, Column]:
    e = _residual()
    n = F.count(e)
    jb = n / 6.0 * (F.pow(F.skewness(e), 2) + F.pow(F.kurtosis(e), 2) / 4.0)
    columns = {
        "residual_mean": F.avg(e),
        "residual_std": F.stddev_pop(e),
        "residual_skewness": F.skewness(e),
        "residual_kurtosis": F.kurtosis(e),
        "residual_min": F.min(e),
        "residual_max": F.max(e),
        "jarque_bera_statistic": jb,
        "jarque_bera_pvalue": F.exp(-jb / 2.0),
    }
    return {k: _enough(3, c) for k, c in columns.items()}


def autocorrelation_columns() -> dict[str, Column]:
    """Needs ``earlier`` = struct(e) of the previous valid row."""
    now = F.when(F.col("earlier").isNotNull(), _residual())
    before = F.when(now.isNotNull(), F.col("earlier.e"))
    corr = ratio(F.covar_pop(now, before), F.stddev_pop(now) * F.stddev_pop(before))
    return {"autocorr_lag1": _enough(3, corr)}


def variance_ratio_columns() -> dict[str, Column]:
    """Needs ``vpos`` and ``vpos_total``: positions among valid rows."""
    middle = F.floor(F.col("vpos_total") / 2)
    e = _residual()
    first = F.var_pop(F.when(F.col("vpos") < middle, e))
    second = F.var_pop(F.when(F.col("vpos") >= middle, e))
    return {"variance_ratio": _enough(3, ratio(second, first))}


def sequence_columns(
    df: DataFrame, keys: list[str], order: list[str], granules: list[Column]
) -> DataFrame:
    """One scan for everything that depends on row order: neighbours and positions."""
    return ordered_scan(
        prepare(df),
        keys,
        order,
        granules,
        sums={"pos": F.lit(1), "vpos": F.when(_valid(), 1).otherwise(0)},
        carries={
            "previous": (F.struct("y_true", "y_pred"), F.lit(True)),
            "earlier": (F.struct((_y() - _p()).alias("e")), _valid()),
        },
    )


def metrics(df: DataFrame, keys: list[str], *groups: dict[str, Column]) -> DataFrame:
    """Flat metric columns by key."""
    named = {k: c for g in groups for k, c in g.items()}
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in named.items()])


def ks_two_sample(df: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of actuals and predictions; p is exact up to EXACT_KS rows, asymptotic beyond."""
    valid = prepare(df).filter(_valid())
    pairs = F.array(
        F.struct(F.lit(True).alias("actual"), _y().alias("value")),
        F.struct(F.lit(False).alias("actual"), _p().alias("value")),
    )
    both = valid.select(*keys, F.explode(pairs).alias("o")).select(*keys, "o.actual", "o.value")
    out = largest_gap(both, keys, "value", F.col("actual")).select(*keys, F.col("gap").alias("d"), F.col("n_first").alias("n"))
    far = kolmogorov_p(F.col("d"), F.col("n").cast("double"), F.col("n").cast("double"))
    p = F.when(F.col("n") <= EXACT_KS, exact_kolmogorov_p(F.col("d"), F.col("n"))).otherwise(far)
    enough = F.col("n") >= 3
    return out.select(
        *keys, F.when(enough, F.col("d")).alias("ks_statistic"), F.when(enough, p).alias("ks_pvalue")
    )


def residual_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    valid = prepare(df).filter(_valid()).select(*keys, (_y() - _p()).alias("value"))
    return value_runs(valid, keys, "value")


def shapiro_francia(df: DataFrame, keys: list[str]) -> DataFrame:
    """W' = squared correlation of ordered residuals with Blom normal scores, and the p-value of normality."""
    ranked = expand_runs(residual_runs(df, keys))
    score = normal_quantile((F.col("rank") + 1 - 0.375) / (F.col("n_total") + 0.25))
    scored = ranked.select(*keys, "value", score.alias("m"))
    covered = F.covar_pop("value", "m")
    w = ratio(covered * covered, F.var_pop("value") * F.var_pop("m"))
    found = scored.groupBy(*keys).agg(F.when(F.count("value") >= 3, w).alias("shapiro_francia_w"), F.count("value").alias("n"))
    p = shapiro_francia_p(F.col("shapiro_francia_w"), F.col("n"))
    return found.select(*keys, "shapiro_francia_w", p.alias("shapiro_francia_p"))


def all_metrics(
    df: DataFrame, keys: list[str], order: list[str], granules: list[Column]
) -> DataFrame:
    """All six metric groups as one row of structs per key."""
    flat = metrics(
        sequence_columns(df, keys, order, granules),
        keys,
        basic := basic_columns(),
        percentage := percentage_columns(),
        directional := directional_columns(),
        distribution := distribution_columns(),
        uncertainty := uncertainty_columns(),
        residual := residual_columns() | autocorrelation_columns() | variance_ratio_columns(),
    )
    joined = flat.join(ks_two_sample(df, keys), keys, "left").join(shapiro_francia(df, keys), keys, "left")
    return joined.select(
        *keys,
        F.struct(*basic).alias("basic"),
        F.struct(*percentage).alias("percentage"),
        F.struct(*directional).alias("directional"),
        F.struct("ks_statistic", "ks_pvalue", *distribution).alias("distribution"),
        F.struct(*uncertainty).alias("uncertainty"),
        F.struct(*residual, "shapiro_francia_w", "shapiro_francia_p").alias("residual"),
    )


def metrics_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    """Seven (metric, value) rows per key."""
    # Report row names.
    rows = {
        "MAE": "basic.mae",
        "RMSE": "basic.rmse",
        "R²": "basic.r2",
        "MAPE (%)": "percentage.mape",
        "Directional Accuracy (%)": "directional.directional_accuracy",
        "Coverage 95% (%)": "uncertainty.coverage_95",
        "Bias": "distribution.bias",
    }
    items = F.array(
        *[F.struct(F.lit(k).alias("metric"), F.col(c).alias("value")) for k, c in rows.items()]
    )
    return report.select(*keys, F.inline(items))


def compare_models(df: DataFrame, keys: list[str], order: list[str], granules: list[Column]) -> DataFrame:
    """One row per model with the six headline metrics; ``keys`` name the model."""
    scanned = sequence_columns(df, keys, order, granules)
    wide = metrics(
        scanned, keys, basic_columns(), percentage_columns(), directional_columns(), uncertainty_columns()
    )
    return wide.select(*keys, "mae", "rmse", "r2", "mape", "directional_accuracy", "coverage_95")


def metrics_json(report: DataFrame, keys: list[str]) -> DataFrame:
    """The nested metrics as JSON text, missing metrics kept as null."""
    groups = [c for c in report.columns if c not in keys]
    body = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    return report.select(*keys, body.alias("metrics_json"))
