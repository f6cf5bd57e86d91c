"""The tables behind the forecast charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvewalk.functions import clean, normal_quantile, ratio
from curvewalk.operators.evaluate import prepare, residual_runs
from curvewalk.operators.scan import attach, expand_runs, over_blocks


def forecast_band(df: DataFrame, kept: list[str], width: float = 1.96) -> DataFrame:
    """Actual, prediction and the interval ``prediction ± width * std``."""
    p, s = F.col("y_pred"), F.col("y_std")
    return prepare(df).select(
        *kept, "y_true", "y_pred", (p - width * s).alias("lower"), (p + width * s).alias("upper")
    )


def rolling_mean(df: DataFrame, keys: list[str], column: str, rows: int = 30) -> DataFrame:
    """Trailing mean over ``rows`` values, NULL until all are present; needs ``pos``."""

    def build(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))

    value = clean(column)
    return over_blocks(df, keys, {f"rolling_{column}": build}, back=rows - 1)


def residual_table(df: DataFrame, kept: list[str]) -> DataFrame:
    """Fitted value, residual and time index; needs ``pos``."""
    return df.select(
        *kept,
        F.col("pos").alias("time_index"),
        F.col("y_pred").alias("fitted"),
        (F.col("y_true") - F.col("y_pred")).alias("residual"),
    )


def residual_histogram(df: DataFrame, keys: list[str], bins: int = 30) -> DataFrame:
    """Equal-width density histogram of residuals, the last bin closed.

    Residuals of one single value fall in a unit-wide range around it. Empty bins are rows with 0.
    """
    rows = (
        prepare(df)
        .select(*keys, (F.col("y_true") - F.col("y_pred")).alias("e"))
        .filter(F.col("e").isNotNull())
    )
    ends = rows.groupBy(*keys).agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.count("e").alias("n"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        *keys,
        "n",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.least(F.lit(bins - 1), F.floor((F.col("e") - F.col("lo")) / width)).cast("int")
    counted = attach(rows, ends, keys).groupBy(*keys, bin_no.alias("bin")).agg(F.count("e").alias("_rows"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = every.join(counted, [*keys, "bin"], "left").withColumn("rows", F.coalesce("_rows", F.lit(0)))
    return filled.select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        "rows",
        ratio(F.col("rows"), F.col("n") * width).alias("density"),
    )


def normal_qq(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered residuals against normal quantiles at Filliben's median positions."""
    ranked = expand_runs(residual_runs(df, keys))
    n, i = F.col("n_total"), F.col("rank") + 1
    last = F.pow(F.lit(0.5), 1.0 / n)
    spot = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    return ranked.select(
        *keys, i.alias("ordinal"), normal_quantile(spot).alias("quantile"), F.col("value").alias("residual")
    )


def qq_line(qq: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares line through the Q-Q points with its correlation."""
    q, e = F.col("quantile"), F.col("residual")
    slope = ratio(F.covar_pop(q, e), F.var_pop(q))
    return qq.groupBy(*keys).agg(
        slope.alias("slope"),
        (F.avg(e) - slope * F.avg(q)).alias("intercept"),
        ratio(F.covar_pop(q, e), F.stddev_pop(q) * F.stddev_pop(e)).alias("r"),
    )


def metric_matrix(comparison: DataFrame, keys: list[str], model: str | None = None, models: list[str] | None = None) -> DataFrame:
    """Metric by model: one row per metric and key, or with ``model`` one column for each of ``models``."""
    # Compared metrics.
    rows = {"MAE": "mae", "RMSE": "rmse", "MAPE": "mape", "Directional_Accuracy": "directional_accuracy"}
    items = F.array(
        *[F.struct(F.lit(k).alias("metric"), F.col(c).alias("value")) for k, c in rows.items()]
    )
    if model is None:
        return comparison.select(*keys, F.inline(items))
    long = comparison.select(*keys, F.col(model).alias("_model"), F.inline(items))
    return long.groupBy(*[k for k in keys if k != model], "metric").pivot("_model", models).agg(F.first("value"))


def score_share(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Each candidate's score and its share of the fold's total."""
    whole = F.sum(score).over(W.partitionBy(*keys))
    return scores.select(*keys, "candidate", score, ratio(F.col(score), whole).alias("share"))


def summary_report(results: DataFrame, key: str) -> DataFrame:
    """One line per series with the report's own column names; missing values stay visible."""
    # Report column names.
    columns = {
        "MAE": "double",
        "RMSE": "double",
        "MAPE": "double",
        "Directional_Accuracy": "double",
        "Best_Kernel": "string",
        "Training_Time": "double",
        "Predictions_Count": "bigint",
    }
    have = {c.lower(): c for c in results.columns}

    def pick(name: str, kind: str):
        found = have.get(name.lower())
        value = F.col(found).cast(kind) if found else F.lit(None).cast(kind)
        if kind == "double":
            value = clean(value)
        return (F.coalesce(value, F.lit("Unknown")) if name == "Best_Kernel" else value).alias(name)

    return results.select(
        F.col(key).cast("string").alias("Bond_Index"), *[pick(n, k) for n, k in columns.items()]
    )
