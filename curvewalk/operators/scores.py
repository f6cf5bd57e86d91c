"""Multi-output training scores and the choice of the best candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvewalk.functions import clean, dot, ratio, total

# Selection metrics and whether larger is better.
METRICS = {
    "cosine_similarity": True,
    "euclidean_rmse": False,
    "r2_avg": True,
    "r2_flat": True,
}


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; metrics are {sorted(METRICS)}")


def _mean_if_whole(column: Column) -> Column:
    """Mean that is NULL as soon as one row has no value."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.avg(column))


def score_columns(actual: list[Column], predicted: list[Column]) -> dict[str, Column]:
    """The four scores as single-pass aggregates over rows of target vectors."""
    inner = total([a * b for a, b in zip(actual, predicted)])
    lengths = F.sqrt(total([a * a for a in actual])) * F.sqrt(total([b * b for b in predicted]))
    squares = [(a - b) * (a - b) for a, b in zip(actual, predicted)]
    n = F.count(F.lit(1))
    spread = [F.var_pop(a) * n for a in actual]
    r2 = total([1 - ratio(F.sum(e), v) for e, v in zip(squares, spread)]) / len(actual)
    means = [F.avg(a) for a in actual]
    middle = total(means) / len(actual)
    flat = total([v + n * (m - middle) * (m - middle) for v, m in zip(spread, means)])
    return {
        "n_train": n,
        "cosine_similarity": _mean_if_whole(ratio(inner, lengths)),
        "euclidean_rmse": F.sqrt(F.avg(total(squares))),
        "r2_avg": r2,
        "r2_flat": 1 - ratio(F.sum(total(squares)), flat),
    }


def score_rows(df: DataFrame, keys: list[str], actual: list[Column], predicted: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in score_columns(actual, predicted).items()])


def vector_scores(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Cosine similarity and euclidean RMSE for array columns of any length."""
    x, y = F.col(a), F.col(b)
    apart = F.zip_with(x, y, lambda u, v: u - v)
    return df.groupBy(*keys).agg(
        _mean_if_whole(ratio(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))).alias("cosine_similarity"),
        F.sqrt(F.avg(dot(apart, apart))).alias("euclidean_rmse"),
    )


def candidate_rank(metric: str) -> Column:
    """Sort value of a candidate: metric, then cosine similarity, then place in the grid; NaN is missing."""
    check_metric(metric)
    value = clean(metric) if METRICS[metric] else -clean(metric)
    return F.struct(value.alias("v"), clean("cosine_similarity").alias("c"), (-F.col("ordinal")).alias("o"))


def best_candidates(scores: DataFrame, keys: list[str], metric: str = "cosine_similarity") -> DataFrame:
    """The winning row per key; a missing score never wins against a present one."""
    others = [c for c in scores.columns if c not in keys]
    won = scores.groupBy(*keys).agg(F.max_by(F.struct(*others), candidate_rank(metric)).alias("won"))
    return won.select(*keys, "won.*")


def top_features(importance: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k most important features per key, ties by name."""
    order = W.partitionBy(*keys).orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
